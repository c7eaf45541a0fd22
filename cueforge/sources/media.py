"""Frames and audio of videos, by tools on the executors; these are not part of this repository and injected by name."""

import hashlib
import json
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[[list[str]], str]


def run(command: list[str]) -> str:
    return subprocess.run(command, capture_output=True, text=True, check=True).stdout


def probe_command(path: str) -> list[str]:
    return ["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "json", path]


def frames_command(path: str, folder: str, interval: float, fps: float | None) -> list[str]:
    """fps, where given, stands above interval. Names have six digits."""
    rate = f"fps={fps}" if fps else f"fps=1/{interval}"
    return ["ffmpeg", "-y", "-i", path, "-vf", rate, "-q:v", "3", f"{folder}/frame_%06d.jpg"]


def audio_command(path: str, target: str) -> list[str]:
    return ["ffmpeg", "-y", "-i", path, "-vn", "-ac", "1", "-ar", "16000", target]


def _owned(root: str, video) -> str:
    """A folder under root that belongs to one video alone; what an earlier try left there goes."""
    folder = f"{root}/{hashlib.sha256(str(video).encode()).hexdigest()[:24]}"
    shutil.rmtree(folder, ignore_errors=True)
    os.makedirs(folder)
    return folder


def _each(videos: DataFrame, made: Callable, schema: str) -> DataFrame:
    """Rows that `made` gives for each (video, path), where the task of the video runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for video, path in zip(batch["video_id"], batch["path"], strict=True) for r in made(video, path)], columns=names)

    return videos.select("video_id", "path").mapInPandas(run, schema)


def extracted_frames(videos: DataFrame, root: str, interval: float = 2.0, fps: float | None = None, runner: Runner = run) -> DataFrame:
    """videos(video_id, path) -> (video_id, file, duration), a row a frame; files lie in root, a folder that all executors share. segments.even_spacing gives them their times."""

    def made(video, path):
        folder = _owned(root, video)
        runner(frames_command(path, folder, interval, fps))
        duration = float(json.loads(runner(probe_command(path)))["format"]["duration"])
        return [(video, f"{folder}/{f}", duration) for f in sorted(os.listdir(folder))]

    return _each(videos, made, f"video_id {videos.schema['video_id'].dataType.simpleString()}, file string, duration double")


def extracted_audio(videos: DataFrame, root: str, runner: Runner = run) -> DataFrame:
    """videos(video_id, path) -> (video_id, path) of sound files in root, one channel at 16 kHz."""

    def made(video, path):
        target = f"{_owned(root, video)}/audio_16k.wav"
        runner(audio_command(path, target))
        return [(video, target)]

    return _each(videos, made, f"video_id {videos.schema['video_id'].dataType.simpleString()}, path string")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of image files under path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "content")


def manifests(frames: DataFrame, videos: DataFrame, interval: float, fps: float | None) -> DataFrame:
    """frames(video_id, idx, file, t) and videos(video_id, path) -> (video_id, document), a JSON object a video; one without frames has none in it."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "file", "t"))), lambda f: F.struct(f["file"].alias("file"), f["t"].alias("t")))
    own = frames.groupBy("video_id").agg(listed.alias("frames"))
    none = F.array().cast("array<struct<file:string,t:double>>")
    rows = videos.select("video_id", "path").join(own, "video_id", "left").withColumn("frames", F.coalesce("frames", none))
    whole = F.struct(F.col("path").alias("video"), F.lit(float(interval)).alias("interval"), F.lit(fps).cast("double").alias("fps"), F.size("frames").alias("count"), "frames")
    return rows.select("video_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))


def durations(videos: DataFrame, runner: Runner = run) -> DataFrame:
    """videos(video_id, path) -> (video_id, duration, error): each probed where its task runs."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                try:
                    rows.append((video, float(json.loads(runner(probe_command(path)))["format"]["duration"]), None))
                except (OSError, KeyError, ValueError, subprocess.SubprocessError) as e:
                    rows.append((video, None, str(e)))
            yield pd.DataFrame(rows, columns=["video_id", "duration", "error"])

    return videos.select("video_id", "path").mapInPandas(probe, "video_id string, duration double, error string")
