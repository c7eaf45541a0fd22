"""Files of each video, as a data source that is written in two phases.

A task writes the files of its rows into a folder of its own attempt under `_pending-<run>` and tells the driver which list
it left there. Only when every task has ended does the driver write the run's journal; then what the lists name is moved into
place. A run that fails, in a task or before its journal, leaves nothing behind. One that stopped after its journal is
finished by the next write to the folder, as moves may be repeated. write_files moves in tasks, a list at a time; a plain
write of the format in the driver's commit.
"""

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cueforge.operators.metrics import RunMetrics

_PENDING, _JOURNAL = "_pending-", "journal.json"


@dataclass
class Written(WriterCommitMessage):
    """Where an attempt lists its files, and how many they are."""

    listed: str
    files: int


def folder_of(video) -> str:
    """The name of a video's folder."""
    return quote(str(video), safe=" ")


class VideoFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, names: dict[str, str], run: str, move: bool):
        self.folder, self.names, self.move, self.pending = folder, names, move, os.path.join(folder, _PENDING + run)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own = os.path.join(self.pending, uuid.uuid4().hex)
        os.mkdir(own)  # fails where the run was given up meanwhile
        files, made = 0, set()
        with open(own + ".list", "w", encoding="utf-8") as listed:
            for batch in iterator:
                columns = {c: batch.column(c).to_pylist() for c in ("video_id", *self.names)}
                for i, video in enumerate(columns["video_id"]):
                    at = os.path.join(own, folder_of(video))
                    if at not in made:
                        os.mkdir(at)
                        made.add(at)
                    for c, name in self.names.items():
                        if columns[c][i] is None:
                            continue
                        value = columns[c][i]
                        with open(os.path.join(at, name), "wb") as f:
                            f.write(value if isinstance(value, bytes) else value.encode())
                        listed.write(json.dumps([folder_of(video), name]) + "\n")
                        files += 1
        return Written(own + ".list", files)

    def commit(self, messages: list[Written]) -> None:
        told = [m for m in messages if m is not None]
        part = os.path.join(self.pending, _JOURNAL + ".part")
        with open(part, "w", encoding="utf-8") as f:
            json.dump([m.listed for m in told], f)
        os.replace(part, os.path.join(self.pending, _JOURNAL))
        if self.move:
            for m in told:
                place(m.listed)
            shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[Written]) -> None:
        given_up = os.path.join(self.folder, "_aborted-" + uuid.uuid4().hex)
        os.rename(self.pending, given_up)  # tasks that still run find no place to write to
        shutil.rmtree(given_up, ignore_errors=True)


def place(listed: str) -> int:
    """Move what an attempt lists into place; what is not there any more was moved before. Gives the number of its lines."""
    folder, n = os.path.dirname(os.path.dirname(listed)), 0
    with open(listed, encoding="utf-8") as f:
        for line in f:
            video, name = json.loads(line)
            source = os.path.join(listed.removesuffix(".list"), video, name)
            if os.path.exists(source):
                os.makedirs(os.path.join(folder, video), exist_ok=True)
                os.replace(source, os.path.join(folder, video, name))
            n += 1
    return n


def finish(spark: SparkSession, folder: str) -> None:
    """Place the files of all runs that got as far as their journal. Others may still be at work and are left alone."""
    for run in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        journal = os.path.join(folder, run, _JOURNAL)
        if not run.startswith(_PENDING) or not os.path.exists(journal):
            continue
        with open(journal, encoding="utf-8") as f:
            lists = [(x,) for x in json.load(f)]  # one for each task of the run
        if lists:
            spark.createDataFrame(lists, "listed string").repartition(len(lists)).mapInArrow(_placed, "n long").agg(F.sum("n")).first()
        shutil.rmtree(os.path.join(folder, run), ignore_errors=True)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([place(x) for x in batch.column("listed").to_pylist()], pa.int64())], ["n"])


class VideoFiles(DataSource):
    """format("video_files"): a column `video_id`, and a file for each other column (a text or binary), by option("names", JSON of column -> file name). The path is a folder that the driver and all executors share. A null makes no file."""

    @classmethod
    def name(cls) -> str:
        return "video_files"

    def writer(self, schema, overwrite: bool) -> VideoFilesWriter:
        names = json.loads(self.options["names"])
        missing = {"video_id", *names} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"no such columns: {', '.join(sorted(missing))}")
        own = VideoFilesWriter(self.options["path"], names, uuid.uuid4().hex, self.options.get("move", "commit") == "commit")
        os.makedirs(own.pending)
        return own


def write_files(documents: DataFrame, folder: str, names: dict[str, str]) -> int:
    """For each row of documents(video_id, ...) a folder under `folder` with a file for each column in names (column -> file name): all files of all rows, or none. A column's null makes no file; files of earlier runs that have other names stay. Gives the number of files, counted as they are written."""
    documents.sparkSession.dataSource.register(VideoFiles)
    finish(documents.sparkSession, folder)
    metrics = RunMetrics()
    rows = metrics.watch(documents.select("video_id", *names), **{c: F.col(c).isNotNull() for c in names})
    rows.write.format("video_files").mode("append").option("names", json.dumps(names)).option("move", "tasks").save(os.path.abspath(folder))
    finish(documents.sparkSession, folder)
    return sum(metrics.told().values())
