"""Segments: numbers, intervals, frames, transcripts, durations. Every positional step has an explicit index."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions import text as X


def numbered(segments: DataFrame) -> DataFrame:
    """With `number` from 1 within a video, by idx."""
    return segments.withColumn("number", F.row_number().over(Window.partitionBy("video_id").orderBy("idx")))


def even_spacing(frames: DataFrame) -> DataFrame:
    """frames(video_id, file, duration) -> with idx by file name and t, idx times duration by the count, to a thousandth."""
    by_video = Window.partitionBy("video_id")
    n = F.count("*").over(by_video)
    idx = F.row_number().over(by_video.orderBy("file")) - 1
    return frames.withColumns({"n": n, "idx": idx}).withColumn("t", X.thousandth(F.col("idx") * (F.col("duration") / F.col("n"))))


def intervals(frames: DataFrame, interval: float) -> DataFrame:
    """frames(video_id, idx, t) -> start and end: a frame lasts until the next one, the last for `interval`."""
    following = F.lead("t").over(Window.partitionBy("video_id").orderBy("idx"))
    return frames.withColumns({"start": F.col("t"), "end": F.coalesce(following, F.col("t") + interval)})


def lines(segments: DataFrame) -> DataFrame:
    return segments.select("video_id", "idx", F.concat(F.lit("["), X.mmss(F.col("start")), F.lit("] "), "text").alias("line"))


def joined(rows: DataFrame, key: str, order: str, value: str, separator: str, name: str) -> DataFrame:
    """One text for each key, its values in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p[value]), separator).alias(name))


def transcript(segments: DataFrame, limit: int | None = None) -> DataFrame:
    """(video_id, raw_text): lines `[mm:ss] text` in order. With a limit, its first characters: lines whose separator lies after them are dropped before they are gathered, so a long video gathers no more than a short one."""
    rows = lines(segments)
    if limit is not None:
        before = Window.partitionBy("video_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).filter(F.col("at") <= limit)
    out = joined(rows, "video_id", "idx", "line", "\n", "raw_text")
    return out if limit is None else out.withColumn("raw_text", F.substring("raw_text", 1, limit))


def summaries(segments: DataFrame) -> DataFrame:
    """(video_id, raw_text, duration, n_segments) of videos with segments, by one aggregation."""
    rows = segments.select("video_id", "idx", "end", F.concat(F.lit("["), X.mmss(F.col("start")), F.lit("] "), "text").alias("line"))
    own = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("lines"), F.max_by("end", "idx").alias("duration"), F.count("*").alias("n_segments"))
    return own.select("video_id", F.array_join(F.transform("lines", lambda p: p["line"]), "\n").alias("raw_text"), "duration", "n_segments")


def durations(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, duration, n_segments): the end of the last segment by idx, not the greatest end; 0 without segments."""
    last = segments.groupBy("video_id").agg(F.max_by("end", "idx").alias("last"), F.count("*").alias("n"))
    return videos.select("video_id").join(last, "video_id", "left").select("video_id", F.coalesce("last", F.lit(0.0)).alias("duration"), F.coalesce("n", F.lit(0)).alias("n_segments"))
