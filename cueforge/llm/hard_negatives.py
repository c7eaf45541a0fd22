"""Hard-negative mining by norm-bucketed search over whole-numbered vectors.

Candidates are dealt by hash into slabs that fit a task. A slab is sorted by norm and cut into buckets; an anchor walks them
from the longest vectors down. By Cauchy-Schwarz no candidate of a bucket scores above |anchor| times the bucket's greatest
norm, so a bucket is passed over by every anchor for which that is below the lower limit of each of its windows, or below
the running k-th score there; and as norms fall, so are all buckets after it. What a slab finds are its own first k, and
the first k of all slabs are the answer. Anchors travel to slabs in blocks; neither table is ever whole in a task.

Scores are whole numbers and exact: sums below 2**52 in floating point, others in 64-bit integers.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, staged

_BUCKET, _BLOCK = 256, 32
_SLAB_BYTES, _SLAB_ROWS = 64 << 20, 512


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """embeddings(vec_id, embedding, label, ...) -> (vec_id, label, v array<int>, square long: of the norm, mark: hash of the row); see mine for what takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding")
            offs = np.asarray(x.offsets)
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.floor(256 * x.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                sums = np.r_[0.0, np.cumsum(np.where(np.abs(v) < 2.0**31, 0.0, 1.0))]
                good = np.diff(sums[offs - offs[0]]) == 0
                v = np.where(np.abs(v) < 2.0**31, v, 0).astype(np.int64)
            lengths, owner = np.diff(offs), np.repeat(np.arange(len(x)), np.diff(offs))
            rough = np.bincount(owner, v.astype(float) ** 2, len(x))
            good &= rough < 2.0**61.9
            keep = good[owner]
            total = np.zeros(len(x), np.int64)
            np.add.at(total, owner[keep], v[keep] ** 2)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths[good])], pa.int32()), pa.array(v[keep].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), batch.column("label").filter(pa.array(good)), lists, pa.array(total[good])], ["vec_id", "label", "v", "square"])

    whole = F.forall("embedding", lambda x: x.isNotNull())
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label long, v array<int>, square long").withColumn("mark", F.xxhash64("vec_id", "label", "v"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists as rows, with zeros where they are shorter than `width` (the longest, if not told); what is beyond it goes."""
    offs = np.asarray(column.offsets)
    size = np.diff(offs)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width), np.int64)
    row, at = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


class Slab:
    """Candidates by falling norm, repeats of a row once."""

    def __init__(self, parts: list[pa.Table]):
        table = pa.concat_tables(parts).combine_chunks()
        self.ids, self.labels, mark, square = (table.column(c).to_numpy() for c in ("vec_id", "label", "mark", "square"))
        once = np.r_[True, (self.ids[1:] != self.ids[:-1]) | (mark[1:] != mark[:-1])][: len(mark)]
        self.ids, self.labels, square = self.ids[once], self.labels[once], square[once]
        self.v = _matrix(table.column("v").combine_chunks())[once]
        self.norms = np.sqrt(square.astype(np.float64))
        self.floating = self.v.astype(np.float64)

    def buckets(self, anchors: np.ndarray, lengths: np.ndarray, needed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, anchors that a bucket may still serve, their scores with it), until none is left. needed, which the caller raises meanwhile: the least score of use to each anchor."""
        width = self.v.shape[1]
        for at in range(0, len(self.ids), _BUCKET):
            reach = lengths * self.norms[at]
            live = np.flatnonzero(reach * (1 + 1e-9) + 1 >= needed)
            if not len(live):
                return
            rows = slice(at, at + _BUCKET)
            if reach[live].max() < 2.0**52:
                yield at, live, np.rint(anchors[live].astype(np.float64) @ self.floating[rows].T).astype(np.int64)
            else:
                yield at, live, anchors[live, :width] @ self.v[rows].T


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _positives(slab: Slab, block: pa.StructArray, k: int) -> list[tuple]:
    """(anchor, mark, place, score, id) of the first k candidates with each anchor's label in the slab."""
    ids, marks, labels = (block.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "mark", "label"))
    a = _matrix(block.field("v"), slab.v.shape[1])
    lengths = np.sqrt(block.field("square").to_numpy(zero_copy_only=False).astype(np.float64))
    needed = np.full(len(ids), -np.inf)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
    for at, live, scores in slab.buckets(a, lengths, needed):
        cid, label = slab.ids[at : at + _BUCKET], slab.labels[at : at + _BUCKET]
        for i, s in zip(live.tolist(), scores, strict=True):
            hit = np.flatnonzero((label == labels[i]) & (cid != ids[i]) & (s >= needed[i]))
            if len(hit):
                s, c = np.r_[best[i][0], s[hit]], np.r_[best[i][1], cid[hit]]
                top = _first(s, c, k)
                best[i] = s[top], c[top]
                if len(top) == k:
                    needed[i] = s[top[-1]]
    return [(ids[i], marks[i], 0, s, c) for i, (x, y) in enumerate(best) for s, c in zip(x.tolist(), y.tolist(), strict=True)]


def _negatives(slab: Slab, block: pa.StructArray, k: int, low: int, high: int) -> list[tuple]:
    """(anchor, mark, place of the positive, score, id) of the first k candidates with other labels in each window of each anchor."""
    ids, marks, labels = (block.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "mark", "label"))
    a = _matrix(block.field("v"), slab.v.shape[1])
    lengths = np.sqrt(block.field("square").to_numpy(zero_copy_only=False).astype(np.float64))
    windows = [[(-(-low * w["score"] // 100), high * w["score"] // 100) for w in ws] for ws in block.field("windows").to_pylist()]
    floors = [[lo for lo, _ in ws] for ws in windows]
    least = lambda i: min((f for f, (lo, hi) in zip(floors[i], windows[i], strict=True) if lo <= hi), default=np.inf)
    needed = np.array([least(i) for i in range(len(ids))], float)
    ceiling = [max((hi for lo, hi in ws if lo <= hi), default=0) for ws in windows]
    best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ws] for ws in windows]
    for at, live, scores in slab.buckets(a, lengths, needed):
        cid, label = slab.ids[at : at + _BUCKET], slab.labels[at : at + _BUCKET]
        for i, s in zip(live.tolist(), scores, strict=True):
            hit = np.flatnonzero((label != labels[i]) & (s >= needed[i]) & (s <= ceiling[i]))
            if not len(hit):
                continue
            s, c = s[hit], cid[hit]
            for w, (lo, hi) in enumerate(windows[i]):
                inside = (s >= floors[i][w]) & (s <= hi)
                if lo <= hi and inside.any():
                    x, y = np.r_[best[i][w][0], s[inside]], np.r_[best[i][w][1], c[inside]]
                    top = _first(x, y, k)
                    best[i][w] = x[top], y[top]
                    if len(top) == k:
                        floors[i][w] = int(x[top[-1]])
            needed[i] = least(i)
    return [(ids[i], marks[i], w, s, c) for i, ws in enumerate(best) for w, (x, y) in enumerate(ws) for s, c in zip(x.tolist(), y.tolist(), strict=True)]


_FOUND = "anchor long, mark long, place int, score long, id long"


def _searched(vectors: DataFrame, anchors: DataFrame, slabs: int, found: Callable[[Slab, pa.StructArray], list[tuple]], k: int) -> DataFrame:
    """(anchor, mark, place, rank, score, id): the first k of what `found` gives over all slabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, slab = None, [], None
        for batch in batches:
            own, kind = batch.column("slab").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (kind[1:] != kind[:-1]), True][: len(own) + 1]) if len(own) else np.zeros(0, int)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if own[lo] != number:
                    number, parts, slab = own[lo], [], None
                rows = batch.slice(lo, hi - lo)
                if not kind[lo]:
                    parts.append(pa.Table.from_batches([rows]))
                    continue
                if parts:
                    slab, parts = Slab(parts), []
                if slab is None:
                    continue  # a slab without candidates
                blocks = rows.column("anchors")
                for j in range(len(blocks)):
                    got = found(slab, blocks[j].values)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "mark", "place", "score", "id"])

    columns = ["vec_id", "mark", "label", "square", "v"] + (["windows"] if "windows" in anchors.columns else [])
    total = anchors.count()
    block = F.pmod(F.xxhash64("mark"), F.lit(-(-total // _BLOCK) or 1))
    blocks = anchors.groupBy(block.alias("block")).agg(F.collect_list(F.struct(*columns)).alias("anchors"))  # _BLOCK on average, by hash
    of = F.pmod(F.col("mark"), F.lit(slabs)).cast("int")
    candidates = vectors.select(of.alias("slab"), F.lit(0).alias("kind"), (-F.col("square")).alias("place"), "vec_id", "label", "mark", "square", "v")
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.lit(1).alias("kind"), F.col("block").cast("long").alias("place"), "anchors")
    both = candidates.unionByName(asked, allowMissingColumns=True)
    rows = both.repartition(slabs, "slab").sortWithinPartitions("slab", "kind", "place", "vec_id", "mark").mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor", "mark", "place").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """embeddings(vec_id, embedding, label, ...) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's vector is floor(256 x) of its components, a score the inner product of two of them. Anchors are the rows
    whose vec_id is divisible by anchor_every; an anchor's positives are its first `positives` other rows of its label, by
    falling score, ties by smaller vec_id. For each of them come the first `negatives` rows of other labels whose score is
    within low and high hundredths of the positive's, ends included; none where that is negative.
    Rows with a null vec_id, label or vector, with a null or non-finite component, or too long for their scores to fit 64 bits (a
    squared norm of 2**61.9 or more) take no part. Where vectors differ in length, what is missing counts as zero. Repeats
    of a whole row are one row; rows that share a vec_id only are rows of their own, yet never each other's positive.
    Other columns are ignored; an empty table gives an empty one.
    """
    vectors = staged(whole_vectors(embeddings), "vectors")
    n, size = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    partitions = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slabs = max(1, -(-8 * size // _SLAB_BYTES), min(partitions, -(-n // _SLAB_ROWS)))
    anchors = vectors.filter(F.col("vec_id") % anchor_every == 0).dropDuplicates(["vec_id", "mark"])
    near = staged(_searched(vectors, anchors, slabs, lambda s, b: _positives(s, b, positives), positives), "positives")
    windows = near.groupBy(F.col("anchor").alias("vec_id"), "mark").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("windows"))
    placed = staged(anchors.join(windows, ["vec_id", "mark"]), "anchors")
    far = _searched(vectors, placed, slabs, lambda s, b: _negatives(s, b, negatives, low, high), negatives)
    own = near.select("anchor", "mark", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(own, ["anchor", "mark", "place"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """embeddings with the label of every row whose vec_id is divisible by `every` moved on by one, modulo `labels`."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return embeddings.withColumn("label", moved)


#: What mine gives of relabelled embeddings.
ORACLE_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a CROSS JOIN v c WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
