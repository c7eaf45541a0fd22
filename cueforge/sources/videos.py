"""Videos under a folder, as a data source: a partition a video, and no tool is started for what a query does not ask."""

import fnmatch
import json
import os
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from cueforge.sources.media import probe_command

_PUSHED = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Video(InputPartition):
    video_id: str
    path: str


def _holds(f: Filter, video: Video) -> bool:
    value = getattr(video, f.attribute[0])
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value)


class VideoReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.path = schema.fieldNames(), options["path"]
        self.pattern, self.probe = options.get("pattern", "*"), options.get("probe", "ffprobe")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Those on video_id and path, by equality, membership, prefix and suffix, choose videos before any is opened; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute in (("video_id",), ("path",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Video]:
        found = []
        for folder, _, names in os.walk(self.path):
            found += [Video(os.path.splitext(n)[0], os.path.join(folder, n)) for n in names if fnmatch.fnmatch(n, self.pattern)]
        return sorted((v for v in found if all(_holds(f, v) for f in self.filters)), key=lambda v: v.path)

    def read(self, video: Video) -> Iterator[tuple]:
        row = {"video_id": video.video_id, "path": video.path, "size": None, "duration": None, "error": None}
        if "size" in self.columns:
            row["size"] = os.path.getsize(video.path)
        if {"duration", "error"} & set(self.columns):
            try:
                told = subprocess.run([self.probe, *probe_command(video.path)[1:]], capture_output=True, text=True, check=True).stdout
                row["duration"] = float(json.loads(told)["format"]["duration"])
            except (OSError, KeyError, ValueError, subprocess.SubprocessError) as e:
                row["error"] = str(e)
        yield tuple(row[c] for c in self.columns)


class Videos(DataSource):
    """format("videos"): (video_id, path, size, duration, error) of the files under a path that all executors share. Options: pattern of names, probe (the tool that tells durations). A schema that leaves out duration and error starts no tool."""

    @classmethod
    def name(cls) -> str:
        return "videos"

    def schema(self) -> str:
        return "video_id string, path string, size long, duration double, error string"

    def reader(self, schema: StructType) -> VideoReader:
        return VideoReader(schema, dict(self.options))


def read_videos(spark: SparkSession, path: str, columns: str = "video_id string, path string, size long, duration double, error string", **options: str):
    """Videos under path with the columns asked for; filters on video_id and path reach the source."""
    spark.conf.set(_PUSHED, "true")
    spark.dataSource.register(Videos)
    return spark.read.format("videos").schema(columns).options(**options).load(path)
