"""Voice activity: where a sound is loud enough to be speech, and the segments that lie there."""

import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueforge.operators.overlaps import overlapping


def levels(sounds: DataFrame, window: float = 0.03) -> DataFrame:
    """sounds(video_id, path) of WAV files with one channel of 16 bits -> (video_id, n, level): the mean square of the samples in the n-th window. A file is read a minute at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                with wave.open(path, "rb") as sound:
                    if (sound.getnchannels(), sound.getsampwidth()) != (1, 2):
                        raise ValueError(f"not one channel of 16 bits: {path}")
                    size, n = max(1, round(window * sound.getframerate())), 0
                    while data := sound.readframes(size * max(1, int(60 / window))):
                        x = np.frombuffer(data, "<i2").astype(np.int64)
                        starts = np.arange(0, len(x), size)
                        mean = np.add.reduceat(x * x, starts) // np.diff(np.r_[starts, len(x)])
                        yield pd.DataFrame({"video_id": video, "n": np.arange(n, n + len(mean)), "level": mean})
                        n += len(mean)

    kind = sounds.schema["video_id"].dataType.simpleString()
    return sounds.select("video_id", "path").mapInPandas(run, f"video_id {kind}, n long, level long")


def _islands(runs: DataFrame, keys: list[str], hang: int) -> DataFrame:
    """runs(keys, first, last) -> those of a key put together where `hang` windows or fewer lie between."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("opens", (before.isNull() | (F.col("first") - before > hang + 1)).cast("int"))
    numbered = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def voiced(windows: DataFrame, hang: int = 10, least: int = 3, loud: tuple[int, int] = (3, 2), floor: int = 0, chunk: int = 4096) -> DataFrame:
    """windows(video_id, n, level) -> (video_id, first, last): runs of windows with speech, both ends in it.

    A window is loud where its level is above `floor` and above loud[0] / loud[1] of the video's mean. Pauses of `hang`
    windows or fewer belong to the speech around them; what is left of fewer than `least` windows is no speech. Runs are
    made within `chunk` windows and then joined up, so a very long video is many tasks' work.
    """
    mean = windows.groupBy("video_id").agg(F.sum("level").alias("total"), F.count("level").alias("windows"))
    above = (F.col("level") > floor) & (F.col("level") * loud[1] * F.col("windows") > F.col("total") * loud[0])
    heard = windows.join(mean, "video_id").filter(above)
    ones = heard.select("video_id", F.floor(F.col("n") / chunk).alias("chunk"), F.col("n").alias("first"), F.col("n").alias("last"))
    runs = _islands(_islands(ones, ["video_id", "chunk"], hang).drop("chunk"), ["video_id"], hang)
    return runs.filter(F.col("last") - F.col("first") + 1 >= least)


def only_voiced(segments: DataFrame, runs: DataFrame, window: float = 0.03) -> DataFrame:
    """segments(video_id, idx, start, end, text) that overlap speech; runs as voiced gives them."""
    spoken = runs.select("video_id", F.col("first").alias("idx"), (F.col("first") * window).alias("start"), ((F.col("last") + 1) * window).alias("end"), F.lit("").alias("text"))
    heard = overlapping(segments, spoken).select("video_id", F.col("spoken_idx").alias("idx")).distinct()
    return segments.join(heard, ["video_id", "idx"], "left_semi")
