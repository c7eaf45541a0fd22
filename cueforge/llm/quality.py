"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are single words and pairs of neighbours, of the words themselves and of their shapes (upper case, lower case,
digits and signs, with runs taken as one), each hashed into 2**bits weights. A text's score is one sparse dot product:
the mean weight of its n-grams.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Block, blocks, mix, powers

_SHAPE = np.arange(256, dtype=np.int64)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97
_SCALE = 20.0


def _shape_hashes(block: Block) -> np.ndarray:
    """A hash of each word's shape: 'WORD!!' and 'AB!' are alike."""
    kind = _SHAPE[block.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[block.starts] = True
    at = np.cumsum(keep) - 1
    p, inverse = powers(len(kind) + 1, 0)
    sums = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum(np.where(keep, (kind + 1).astype(np.uint64) * p[at], np.uint64(0)), out=sums[1:])
    return mix((sums[block.ends] - sums[block.starts]) * inverse[at[block.starts]]) if len(block.starts) else np.zeros(0, np.uint64)


def features(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every n-gram, rows ascending within each kind."""
    row = block.row_of_word()
    pair = row[1:] == row[:-1]
    rows, found = [], []
    for k, h in enumerate((block.hashes(), _shape_hashes(block))):
        two = mix(h[:-1] * np.uint64(3) + h[1:] + np.uint64(k + 1))[pair] if len(h) else h
        for n, values in enumerate((h, two)):
            rows.append(row if n == 0 else row[1:][pair])
            found.append((mix(values + np.uint64(7 * k + n)) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int, passes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights by FTRL-proximal from (indices, values, label); the last weight is the bias. Classes count alike."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    share = max(1e-9, sum(y for *_, y in examples) / max(1, len(examples)))
    order = np.random.Generator(np.random.PCG64(5))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(passes):
        for e in order.permutation(len(examples)):
            i, x, y = examples[e]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x * (0.5 / share if y else 0.5 / max(1e-9, 1 - share))
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, keep, per_class: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of the labelled rows that `keep` allows; of each class the first by hash, as many as stated. A doc_id that docs repeat gives its least text alone, so the sample is bounded whatever repeats."""
    rows = labels.filter(keep).filter(F.col(column).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    parts = [rows.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in per_class.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most the sum of per_class rows
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def one_task(rows: DataFrame, made: Callable[[pa.Table], list[np.ndarray]]) -> list[np.ndarray]:
    """What `made` gives of rows, a sample of bounded size, ordered by doc_id, text and label, in one task of an executor; only its arrays come to the driver."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending"), ("text", "ascending"), ("label", "ascending")])
            found = made(table)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([x.dtype.str for x in found]), pa.array([x.tobytes() for x in found], pa.binary())], ["place", "kind", "data"])

    got = rows.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "place int, kind string, data binary").collect()
    if not got:
        none = pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})
        return made(none.select(names))
    return [np.frombuffer(r.data, r.kind) for r in sorted(got, key=lambda r: r.place)]


def fit(docs: DataFrame, labels: DataFrame, keep, bits: int = 20, per_class: int = 2000, passes: int = 3) -> np.ndarray:
    """Weights learnt, in one task, from at most per_class labelled rows of each class for which `keep`, a condition on doc_id, holds."""

    def learnt(rows: pa.Table) -> list[np.ndarray]:
        examples = []
        for block in blocks(rows["text"]):
            row, index = features(block, bits)
            key, count = np.unique(row * np.int64(1 << 32) + index, return_counts=True)
            cut = np.searchsorted(key >> np.int64(32), np.arange(block.hi - block.lo + 1))
            for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                i, c = (key[a:b] & np.int64(0xFFFFFFFF)).astype(np.int32), count[a:b]
                examples.append((np.r_[i, np.int32(1 << bits)], np.r_[c * (_SCALE / max(1, c.sum())), 1.0].astype(np.float32), rows["label"][block.lo + k].as_py()))
        return [train(sorted(examples, key=lambda e: (e[2], e[0].tobytes())), bits, passes)]

    return one_task(labelled_sample(docs, labels, "quality", keep, {0: per_class, 1: per_class}), learnt)[0]


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs -> the same rows and columns with `score`, the chance of label 1. Null, empty and blank texts get the bias's score."""
    bits = int(len(weights) - 1).bit_length() - 1
    used = np.flatnonzero(weights).astype(np.int32)
    values = weights[used]
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << bits) + 1, np.float32)
        weights[used] = values
        for batch in batches:
            z = []
            for block in blocks(pc.struct_field(batch.column("row"), "text")):
                row, index = features(block, bits)
                n = block.hi - block.lo
                total = np.bincount(row, minlength=n)
                z.append(_SCALE * np.bincount(row, weights[index], n) / np.maximum(1, total))
            p = 1 / (1 + np.exp(-np.clip((np.concatenate(z) if z else np.zeros(0)) + float(weights[-1]), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p)], ["row", "score"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(run, schema).select("row.*", "score")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) and labels(doc_id, quality) -> (doc_id, held_out, score, predicted), one row a row of docs.

    Rows whose crc32(doc_id as text) mod `folds` is `held` are held out: their labels are not read. A null doc_id is held
    out. Null labels and labels other than 0 and 1 are not learnt from; without any example the score is 0.5. Repeated
    rows are scored alike; clashing extra columns in either table are ignored; an empty table gives an empty one.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(True))
    weights = fit(docs, labels, ~fold)
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
