"""Notes merged into a deck that exists: an upsert by guid, and a table of notes with versions."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "deck_id long, model_id long, guid string, fields array<string>"


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing(deck_id, model_id, guid, fields) and incoming (the same, and ord) -> the notes of both, one for each deck and guid.

    What comes in stands above what is there; of incoming notes with one guid the last by ord does. One aggregation, whose
    partial results leave a note a task, so a guid of very many rows is no group in one place.
    """
    note = F.struct("model_id", "fields")
    rows = existing.select("deck_id", "guid", note.alias("note"), F.struct(F.lit(0).alias("since"), F.lit(-1).cast("long").alias("ord"), "fields").alias("rank"))
    new = incoming.select("deck_id", "guid", note.alias("note"), F.struct(F.lit(1).alias("since"), F.col("ord").cast("long").alias("ord"), "fields").alias("rank"))
    return rows.unionByName(new).groupBy("deck_id", "guid").agg(F.max_by("note", "rank").alias("note")).select("deck_id", "note.model_id", "guid", "note.fields")


class StaleVersion(RuntimeError):
    """Another merge came first; merge again."""


class NoteTable:
    """Notes under a folder. Each merge writes a version of its own, and becomes visible by one rename that fails where that version exists: readers see a whole version, a merge that failed is as if it had never been, and of two at a time one is refused."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, the latest last."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _at(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}"

    def read(self, version: int | None = None) -> DataFrame:
        """The notes of a version, or of the latest; none where there is none."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], NOTES)
        return self.spark.read.schema(NOTES).parquet(self._at(known[-1] if version is None else version))

    def merge(self, incoming: DataFrame) -> int:
        """Merge notes (with ord) into the latest version; gives the new one's number. Merging the same notes again changes nothing but the number."""
        latest = (self.versions() or [0])[-1]
        pending = f"{self.folder}/_pending-{uuid.uuid4().hex}"
        merged(self.read(), incoming).write.parquet(pending)
        if self._fs.exists(self._path(self._at(latest + 1))) or not self._fs.rename(self._path(pending), self._path(self._at(latest + 1))):
            self._fs.delete(self._path(pending), True)
            raise StaleVersion(f"version {latest + 1} of {self.folder} was written meanwhile")
        if self._fs.exists(self._path(f"{self._at(latest + 1)}/{pending.rsplit('/', 1)[1]}")):  # renamed into a folder that came between
            self._fs.delete(self._path(f"{self._at(latest + 1)}/{pending.rsplit('/', 1)[1]}"), True)
            raise StaleVersion(f"version {latest + 1} of {self.folder} was written meanwhile")
        return latest + 1

    def forget(self, keep: int = 2) -> None:
        """Delete all versions but the latest ones."""
        for version in self.versions()[:-keep]:
            self._fs.delete(self._path(self._at(version)), True)
