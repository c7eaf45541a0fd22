"""Repair of conversations' structure by weighted finite-state composition.

Three automata are composed lazily: an acceptor of a conversation's rows, a transducer of edits (keep, rerole, delete,
insert), and an acceptor of the roles' grammar, `(s?(ua)+)?` over their initials. States of the composition are (rows read,
inserts in a row, grammar state); rows and inserts only grow, which is the topological order, and two inserts in a row are
enough, as a third would come back to a grammar state at a cost. The shortest path is over (cost, label string) weights.
Minimising prefixes is right although strings alone would not allow it: labels of the same rows that cost the same hold as
many row edits, so one that is a proper prefix of the other would lack an insert, which costs; hence neither is.

A conversation may be of any length: rows are range-partitioned in order and cut into fragments; a fragment's shortest paths from
each grammar state to each other one are its matrix, and matrices of a conversation are multiplied in pairs, as a balanced tree.
Texts take no part in this; they pass by once at the end, where a conversation's repaired rows follow its label string.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

#: The grammar's states: nothing yet, after s, after u, after a; and where it may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
RENAMED = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_FRAGMENT, _CACHED = 512, 24
_BLANK = "[^\\x20\\x09-\\x0D]"

Weight = tuple[int, str]
Matrix = dict[int, dict[int, Weight]]


def arcs(symbol: str) -> list[tuple[str, str, int]]:
    """(label, role initial that is written or none, cost) of the edits of a row: `x` must go; others are the initial of their role (`o`: neither s, u nor a), in capitals where the text is truncated."""
    if symbol == "x":
        return [("D", "", DELETE)]
    more = TRUNCATED if symbol.isupper() else 0
    return [("D", "", DELETE), ("K", symbol.lower(), KEEP + more), ("R", "u", REROLE + more), ("R", "a", REROLE + more)]


def _relax(states: dict, key, weight: Weight) -> None:
    if key not in states or weight < states[key]:
        states[key] = weight


def _with_inserts(states: dict[tuple[int, int], Weight]) -> dict[tuple[int, int], Weight]:
    for inserts in (0, 1):
        for (_, g), (cost, label) in [x for x in states.items() if x[0][0] == inserts]:
            for initial in RENAMED:
                if initial in GRAMMAR[g]:
                    _relax(states, (inserts + 1, GRAMMAR[g][initial]), (cost + INSERT, label + "I"))
    return states


def shortest(symbols: str, start: int) -> dict[int, Weight]:
    """The best (cost, label) from grammar state start over all rows to each grammar state that can be reached."""
    states = _with_inserts({(0, start): (0, "")})
    for symbol in symbols:
        after: dict[tuple[int, int], Weight] = {}
        for (_, g), (cost, label) in states.items():
            for edit, initial, price in arcs(symbol):
                to = GRAMMAR[g].get(initial) if initial else g
                if to is not None:
                    _relax(after, (0, to), (cost + price, label + edit))
        states = _with_inserts(after)
    best: dict[int, Weight] = {}
    for (_, g), weight in states.items():
        _relax(best, g, weight)
    return best


_remembered = lru_cache(1 << 16)(shortest)


def matrix(symbols: str, starts: tuple[int, ...]) -> Matrix:
    return {s: (_remembered if len(symbols) <= _CACHED else shortest)(symbols, s) for s in starts}


def product(one: Matrix, two: Matrix) -> Matrix:
    """Paths through both; strings are joined only where costs tie."""
    out: Matrix = {}
    for start, row in one.items():
        least: dict[int, int] = {}
        for via, (cost, _) in row.items():
            for end, (more, _) in two[via].items():
                least[end] = min(cost + more, least.get(end, cost + more))
        out[start] = {end: (c, min(label + two[via][end][1] for via, (cost, label) in row.items() if end in two[via] and cost + two[via][end][0] == c)) for end, c in least.items()}
    return out


def damaged(conversations: DataFrame, every: int = 20) -> DataFrame:
    """conversations(conv_id, turn, role, text) with planted faults, by crc32(`conv_id:turn`) modulo `every`: 0 drops a row, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats it, 4 makes its role `user`. Nulls count as one space, in the key too."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % every
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


_ORDER = ("turn", "role", "digest")
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_FRAGMENTS = "conv_id long, at long, whole_start boolean, head string, tail string, first_turn long, last_turn long, least long, most long, blank long, duplicate long, truncated long, illegal long, turns long, start array<int>, end array<int>, cost array<long>, label array<string>"
_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Fragment:
    """Rows of one conversation on end, and what is counted in them."""

    def __init__(self, conv, at: int, whole_start: bool):
        self.conv, self.at, self.whole_start = conv, at, whole_start
        self.symbols: list[str] = []
        self.head = self.tail = self.first = self.last = self.least = self.most = None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, turn, role: str, fault: str) -> None:
        initial = role[:1]
        if self.symbols:
            self.counts["illegal"] += self.tail + initial not in ("su", "ua", "au")
        else:
            self.head, self.first = initial, turn
        if turn is not None:
            self.counts["turns"] += turn != self.last or self.least is None
            self.least = turn if self.least is None else min(turn, self.least)
            self.most = turn if self.most is None else max(turn, self.most)
        self.tail, self.last = initial, turn
        if fault:
            self.counts[fault] += 1
        kept = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append("x" if fault in ("blank", "duplicate") else kept.upper() if fault else kept)

    def row(self) -> tuple:
        paths = matrix("".join(self.symbols), (0,) if self.whole_start else tuple(range(len(GRAMMAR))))
        cells = [(s, e, *w) for s, row in paths.items() for e, w in row.items()]
        return (self.conv, self.at, self.whole_start, self.head, self.tail, self.first, self.last, self.least, self.most, *self.counts.values(), *map(list, zip(*cells, strict=True)))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def fragments(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, digest, blank, truncated) -> fragments of conversations, in order of `at`.

    A row is a duplicate unless it is the first with its role and text: the least turn of each of these is sent along as a mark
    that sorts right before that row, so no task needs more than its own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, mark, open_, done = TaskContext.get().partitionId() << 32, 0, None, None, []
        for batch in batches:
            for conv, turn, role, digest, kind, blank, truncated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *_ORDER, "kind", "blank", "truncated")), strict=True):
                key = (conv, turn, role, digest)
                if not kind:
                    mark = key
                    continue
                if open_ is None or conv != open_.conv or len(open_.symbols) == _FRAGMENT:
                    starts = open_ is not None and conv != open_.conv
                    if open_ is not None:
                        done.append(open_.row())
                    open_, seen = Fragment(conv, part + seen, starts), seen + 1
                fault = "blank" if blank else "" if key == mark else "duplicate"
                mark = None if key == mark else mark
                open_.add(turn, role, fault or ("truncated" if truncated else ""))
                if len(done) >= 2000:
                    yield _batch(done, _FRAGMENTS)
                    done = []
        if open_ is not None:
            yield _batch([*done, open_.row()], _FRAGMENTS)

    first = rows.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    marks = first.select("conv_id", F.col("least.turn").alias("turn"), "role", "digest", F.lit(0).alias("kind"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"))
    both = marks.unionByName(rows.withColumn("kind", F.lit(1)))
    ordered = both.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER, "kind")
    return ordered.mapInArrow(run, _FRAGMENTS)


class Conversation:
    """Fragments of one conversation put together."""

    def __init__(self, conv):
        self.conv, self.stack = conv, []
        self.tail = self.last = self.least = self.most = None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, f: dict) -> None:
        for c in _COUNTS:
            self.counts[c] += f[c]
        if self.stack:
            self.counts["illegal"] += self.tail + f["head"] not in ("su", "ua", "au")
            self.counts["turns"] -= f["first_turn"] is not None and f["first_turn"] == self.last
        self.tail, self.last = f["tail"], f["last_turn"]
        for name, of in (("least", min), ("most", max)):
            both = [x for x in (getattr(self, name), f[name]) if x is not None]
            setattr(self, name, of(both) if both else None)
        own: Matrix = {}
        for s, e, cost, label in zip(f["start"], f["end"], f["cost"], f["label"], strict=True):
            own.setdefault(s, {})[e] = (cost, label)
        level = 0
        while self.stack and self.stack[-1][0] == level:  # as carries of a binary counter
            own, level = product(self.stack.pop()[1], own), level + 1
        self.stack.append((level, own))

    def row(self) -> tuple:
        whole = self.stack.pop()[1]
        while self.stack:
            whole = product(self.stack.pop()[1], whole)
        cost, audit = min(w for e, w in whole[0].items() if e in FINAL)
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.counts["turns"]
        return (self.conv, gaps, *(self.counts[c] for c in _COUNTS[:-1]), cost, audit)


def summaries(parts: DataFrame) -> DataFrame:
    """fragments -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []
        for batch in batches:
            for f in batch.to_pylist():
                if open_ is None or open_.conv != f["conv_id"]:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = Conversation(f["conv_id"])
                open_.add(f)
            if len(done) >= 2000:
                yield _batch(done, _SUMMARY)
                done = []
        if open_ is not None:
            yield _batch([*done, open_.row()], _SUMMARY)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, _SUMMARY)


class _Walk:
    """Follows a conversation's label string: what each row becomes, and the rows that are put in."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.state = conv, audit, 0, 0

    def _next(self) -> str:
        return "a" if self.state == 2 else "u"

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            initial = self._next()
            self.at, self.state = self.at + 1, GRAMMAR[self.state][initial]
            yield self.conv, "I", RENAMED[initial], ""

    def row(self, role: str, text: str) -> tuple:
        edit, self.at = self.audit[self.at], self.at + 1
        role = RENAMED[self._next()] if edit == "R" else role
        self.state = self.state if edit == "D" else GRAMMAR[self.state][role[:1]]
        return self.conv, edit, role, text


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Per batch (conv_id, edit, role, text) of all rows in order; an edit `D` has no place in the repaired conversation, a null one ends it."""
    walk = None
    for batch in batches:
        out: list[tuple] = []
        for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if walk is not None:
                out += walk.inserts()
            if audit is None:
                out.append(walk.row(role, text))
                continue
            if walk is not None:
                out.append((walk.conv, None, None, None))
            walk = _Walk(conv, audit)
        yield out
    if walk is not None:
        yield [*walk.inserts(), (walk.conv, None, None, None)]


def _meeting(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Each conversation's label, then its rows in order."""
    labels = summary.select("conv_id", F.lit(0).alias("kind"), "audit")
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text")
    return labels.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER).select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """(conv_id, place from 0, edit, role, text): the rows of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for out in _walked(batches):
            kept = []
            for conv, edit, role, text in out:
                if edit is None:
                    place = 0
                elif edit != "D":
                    kept.append((conv, place, edit, role, text))
                    place += 1
            if kept:
                yield _batch(kept, "conv_id long, place long, edit string, role string, text string")

    return _meeting(rows, summary).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired conversations, their rows as `role:text`, joined by newlines. A hash goes over its rows one after the other, so a conversation streams through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, between = hashlib.sha256(), b""
        for out in _walked(batches):
            done = []
            for conv, edit, role, text in out:
                if edit is None:
                    done.append((conv, own.hexdigest()))
                    own, between = hashlib.sha256(), b""
                elif edit != "D":
                    own.update(between + role.encode() + b":" + text.encode())
                    between = b"\n"
            if done:
                yield _batch(done, "conv_id long, repaired_sha256 string")

    return _meeting(rows, summary).mapInArrow(run, "conv_id long, repaired_sha256 string")


def summarised(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit); see repair."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    light = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), (~F.col("text").rlike(_BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    return summaries(staged(fragments(staged(light, "turns")), "fragments"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations(conv_id, turn, role, text, ...) -> (per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; the repaired rows: conv_id, place, edit, role, text).

    Rows go by turn, nulls first; of equal turns by role and the text's SHA-256. A row's first fault counts: blank, a
    duplicate of a row before (role and text), truncated (its last character that isn't white space is none of `.!?`).
    illegal: neighbours whose role initials are not su, ua or au. gaps: turns between the least and the greatest that
    no row has. audit: the initials of the cheapest edits, of equally cheap ones the least by ASCII; Keep costs 0, Rerole
    3, Delete 4, Insert 3, and 3 more is paid for a truncated row that stays; blank rows and duplicates must go.
    Null roles and texts count as one space. A null conv_id is a conversation of its own; repeated rows are rows, all but
    the first duplicates. Other columns are ignored; an empty table gives empty ones.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    summary = staged(summarised(rows), "summaries")
    return summary, repaired(rows, summary)


def audited(conversations: DataFrame) -> DataFrame:
    """conversations -> what repair finds in damaged(conversations), with repaired_sha256; a row for each conv_id of conversations. One whose rows were all dropped has zeros, an empty audit and the hash of nothing."""
    rows = damaged(conversations)
    summary = staged(summarised(rows), "summaries")
    hashes = digests(rows, summary).withColumnRenamed("conv_id", "own_id")
    both = summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("own_id"))).drop("own_id")
    every = conversations.select(F.col("conv_id").cast("long").alias("every_id")).distinct()
    out = every.join(both, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("every_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
