"""Deck packages: a zip that holds a collection of notes and cards as an SQLite file, put together where the deck's rows are."""

import hashlib
import json
import os
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cueforge.operators.render import BACK, CARD_STYLE, FRONT

FIELDS = ("Question", "Answer", "Tags", "Timestamp", "Source")
# The tables of a collection, version 11, by name and columns; integers unless named as texts.
_TABLES = {
    "col": "id crt mod scm ver dty usn ls conf models decks dconf tags",
    "notes": "id guid mid mod usn tags flds sfld csum flags data",
    "cards": "id nid did ord mod usn type queue due ivl factor reps lapses left odue odid flags data",
    "revlog": "id cid usn ease ivl lastIvl factor time type",
    "graves": "usn oid type",
}
_TEXTS = {"conf", "models", "decks", "dconf", "guid", "flds", "sfld", "data"}
_INDEXES = ("notes(usn)", "cards(usn)", "revlog(usn)", "cards(nid)", "cards(did, queue, due)", "revlog(cid)", "notes(csum)")


def _model(model_id: int, deck_id: int, now: int) -> dict:
    fields = [{"name": n, "ord": i, "font": "Arial", "size": 20, "media": [], "rtl": False, "sticky": False} for i, n in enumerate(FIELDS)]
    face = {"name": "Card", "ord": 0, "qfmt": FRONT, "afmt": BACK, "bqfmt": "", "bafmt": "", "did": None}
    return {"id": str(model_id), "name": "Knowledge card", "type": 0, "mod": now, "usn": -1, "sortf": 0, "did": deck_id, "tmpls": [face], "flds": fields, "css": CARD_STYLE, "latexPre": "", "latexPost": "", "tags": [], "vers": [], "req": [[0, "any", [0, 3]]]}


def _deck(deck_id: int, name: str, now: int) -> dict:
    none = [0, 0]
    return {"id": deck_id, "name": name, "desc": "", "mod": now, "usn": -1, "conf": 1, "dyn": 0, "collapsed": False, "extendNew": 0, "extendRev": 50, "newToday": none, "revToday": none, "lrnToday": none, "timeToday": none}


class Package:
    """One deck while its notes come in; `close` gives the package's bytes."""

    def __init__(self, deck_id: int, name: str, now: int):
        self.deck_id, self.name, self.now, self.notes, self.model_id = deck_id, name, now, 0, None
        self.folder = tempfile.TemporaryDirectory()  # of this task alone
        self.db = sqlite3.connect(os.path.join(self.folder.name, "collection.anki2"))
        for table, columns in _TABLES.items():
            typed = [f"{c} {'text' if c in _TEXTS or c == 'tags' else 'integer primary key' if c == 'id' else 'integer'}" for c in columns.split()]
            self.db.execute(f"CREATE TABLE {table} ({', '.join(typed)})")

    def _put(self, table: str, *row) -> None:
        self.db.execute(f"INSERT INTO {table} VALUES ({', '.join('?' * len(row))})", row)

    def add(self, model_id: int, guid: str, fields: list[str]) -> None:
        own = 10**12 + self.deck_id % 10**6 * 10**6 + self.notes
        check = int(hashlib.sha1(fields[0].encode()).hexdigest()[:8], 16)
        tags = f" {fields[2].strip()} " if fields[2].strip() else ""
        self._put("notes", own, guid, model_id, self.now, -1, tags, "\x1f".join(fields), fields[0], check, 0, "")
        self._put("cards", own, own, self.deck_id, 0, self.now, -1, 0, 0, self.notes, 0, 0, 0, 0, 0, 0, 0, 0, "")
        self.notes, self.model_id = self.notes + 1, model_id

    def close(self) -> bytes:
        decks = {str(i): _deck(i, n, self.now) for i, n in ((1, "Default"), (self.deck_id, self.name))}
        models = {str(self.model_id): _model(self.model_id, self.deck_id, self.now)} if self.notes else {}
        conf = {"activeDecks": [1], "curDeck": 1, "newSpread": 0, "collapseTime": 1200, "timeLim": 0, "estTimes": True, "dueCounts": True, "curModel": None, "nextPos": 1, "sortType": "noteFld", "sortBackwards": False, "addToCur": True}
        steps = {"id": 1, "name": "Default", "mod": 0, "usn": 0, "maxTaken": 60, "autoplay": True, "timer": 0, "replayq": True, "dyn": False, "new": {"delays": [1, 10], "ints": [1, 4, 7], "initialFactor": 2500, "order": 1, "perDay": 20, "bury": True, "separate": True}, "rev": {"perDay": 100, "ease4": 1.3, "fuzz": 0.05, "ivlFct": 1, "maxIvl": 36500, "bury": True, "minSpace": 1}, "lapse": {"delays": [10], "mult": 0, "minInt": 1, "leechFails": 8, "leechAction": 0}}
        self._put("col", 1, self.now, self.now * 1000, self.now * 1000, 11, 0, 0, 0, json.dumps(conf), json.dumps(models), json.dumps(decks), json.dumps({"1": steps}), "{}")
        for i, of in enumerate(_INDEXES):
            self.db.execute(f"CREATE INDEX ix_{i} ON {of}")
        self.db.commit()
        self.db.close()
        whole = os.path.join(self.folder.name, "deck.apkg")
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
            z.write(os.path.join(self.folder.name, "collection.anki2"), "collection.anki2")
            z.writestr("media", "{}")
        with open(whole, "rb") as f:
            data = f.read()
        self.folder.cleanup()
        return data


def packages(notes: DataFrame, now: int) -> DataFrame:
    """notes(video_id, deck, ord, deck_id, model_id, guid, fields) -> (video_id, package binary, notes long): a deck a video, its notes by ord. A deck's rows pass through one task one after the other, as they make one file; decks are spread over all tasks. now: seconds, the time of change that packages carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, own = None, None

        def done() -> pa.RecordBatch:
            n = own.notes
            return pa.RecordBatch.from_arrays([pa.array([video], kind), pa.array([own.close()], pa.binary()), pa.array([n], pa.int64())], ["video_id", "package", "notes"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("video_id").type
            for row in batch.to_pylist():
                if own is None or row["video_id"] != video:
                    if own is not None:
                        yield done()
                    video, own = row["video_id"], Package(row["deck_id"], row["deck"], now)
                own.add(row["model_id"], row["guid"], row["fields"])
        if own is not None:
            yield done()

    kind = notes.schema["video_id"].dataType.simpleString()
    rows = notes.select("video_id", "deck", "ord", "deck_id", "model_id", "guid", "fields").repartition("video_id").sortWithinPartitions("video_id", "ord", "guid")
    return rows.mapInArrow(run, f"video_id {kind}, package binary, notes long")


def write_package(notes: DataFrame, path: str, now: int) -> int:
    """All notes, of one deck, as one package at path, which executors share; gives their number. It is written by a task, beside the path first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("package").to_pylist():
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("notes")], ["notes"])

    return sum(r.notes for r in packages(notes, now).mapInArrow(run, "notes long").collect())
