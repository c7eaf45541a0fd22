"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by k-means with oversized clusters split, and kept in memory with a graph of
their neighbours. Every vector goes into the list of its nearest centroid; one near a boundary is replicated into the
lists of further centroids about as near, unless these lie much nearer to a list already chosen than to the vector. A query
searches the graph for its nearest centroids and reads the lists whose distance is within a ratio of the nearest one's, and
at least as many as reach the recall asked for: how many that takes is found against brute force over the whole table.
Lists are cut into parts of bounded size, which are the groups that tasks work on.
"""

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged
from .words import whole_groups


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1))


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means; after each round the centroids of the smallest clusters move into the largest ones where these hold over twice the mean."""
    rng = np.random.Generator(np.random.PCG64(3))
    distinct = np.unique(x, axis=0)
    lists = max(1, min(lists, len(distinct)))
    c = distinct[rng.permutation(len(distinct))[:lists]].astype(np.float64)
    for turn in range(rounds):
        own = np.concatenate([_squared(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], c)
        if turn < rounds - 3:
            large, small = np.argsort(-size), np.argsort(size)
            for big, little in zip(large, small, strict=True):
                if size[big] <= 2 * len(x) / lists or size[little] >= len(x) / lists / 4:
                    break
                c[little] = x[rng.choice(np.flatnonzero(own == big))]
    return np.unique(c, axis=0)


class Graph:
    """Centroids, each linked to its nearest ones, to some far ones, and back."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.c = centroids
        n = len(centroids)
        near = [np.argsort(_squared(centroids[i : i + 1], centroids)[0], kind="stable")[1 : degree + 1] for i in range(n)]
        links = [set(x.tolist()) for x in near]
        for i in range(n):
            links[i].add((i * 7919 + 1) % n)
        for i, x in enumerate([*map(tuple, links)]):
            for j in x:
                links[j].add(i)
        self.links = [np.array(sorted(x - {i}), np.int64) for i, x in enumerate(links)]
        self.start = int(_squared(centroids.mean(axis=0)[None], centroids)[0].argmin()) if n else 0

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids nearest to q and their distances, ascending, by best-first search over the graph."""
        seen = np.zeros(len(self.c), bool)
        seen[self.start] = True
        d = float(((self.c[self.start] - q) ** 2).sum())
        todo, found = [(d, self.start)], [(-d, self.start)]
        while todo:
            d, at = heappop(todo)
            if len(found) >= beam and d > -found[0][0]:
                break
            new = self.links[at][~seen[self.links[at]]]
            seen[new] = True
            for e, j in zip(((self.c[new] - q) ** 2).sum(axis=1).tolist(), new.tolist(), strict=True):
                if len(found) < beam or e < -found[0][0]:
                    heappush(todo, (e, j))
                    heappush(found, (-e, j))
                    if len(found) > beam:
                        heappop(found)
        best = sorted((-d, j) for d, j in found)
        return np.array([j for _, j in best]), np.sqrt([d for d, _ in best])


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query; a repeated id counts once."""
    order = np.lexsort((score, ids, query))
    order = order[np.r_[True, (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])][: len(order)]]
    order = order[np.lexsort((ids[order], score[order], query[order]))]
    new = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]][: len(order)])
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
    return order[rank < k]


def truth(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> pa.Table:
    """(query: place in `ids`, vec_id, embedding): the exact k nearest of each query over all of rows. A task passes on k rows a query."""
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, i, s, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                x, own = _vectors(piece.column("embedding"), dim), piece.column("vec_id").to_numpy()
                d = _squared(queries, x)
                d[ids[:, None] == own[None]] = np.inf
                n = min(2 * k, len(x))
                near = np.argpartition(d, n - 1, axis=1)[:, :n].ravel()
                which = np.repeat(np.arange(len(ids)), n)
                ok = np.isfinite(d[which, near])
                which, near = which[ok], near[ok]
                q, i, s, v = np.r_[q, which], np.r_[i, own[near]], np.r_[s, d[which, near]], np.r_[v, x[near]]
                best = _best(q, i, s, k)
                q, i, s, v = q[best], i[best], s[best], v[best]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float64()))], ["query", "vec_id", "score", "embedding"])

    near = rows.mapInArrow(run, "query long, vec_id long, score double, embedding array<double>")
    near = near.groupBy("query", "vec_id").agg(F.min(F.struct("score", "embedding")).alias("of"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("of.score", "vec_id"))
    return near.withColumn("place", place).filter(F.col("place") <= k).select("query", "vec_id", F.col("of.embedding").alias("embedding")).toArrow()


def lists_of(x: np.ndarray, centroids: np.ndarray, closure: float, replicas: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """The lists that each row of x goes into, nearest first, and which of these columns hold."""
    d = np.sqrt(_squared(x, centroids))
    take = min(replicas, d.shape[1])
    near = np.argpartition(d, take - 1, axis=1)[:, :take]
    near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(axis=1, kind="stable"), 1)
    dist = np.take_along_axis(d, near, 1)
    keep = dist <= dist[:, :1] * (1 + closure)
    for j in range(1, take):
        for i in range(j):
            apart = np.sqrt(((centroids[near[:, j]] - centroids[near[:, i]]) ** 2).sum(axis=1))
            keep[:, j] &= ~keep[:, i] | (apart >= spread * dist[:, j])
    keep[:, 0] = True
    return near, keep


def lists_needed(graph: Graph, queries: np.ndarray, query: np.ndarray, near: np.ndarray, keep: np.ndarray, target: float, beam: int) -> int:
    """How many lists a query reads so that the share `target` of the true neighbours lie in them. query: of each neighbour; near, keep: the neighbour's lists."""
    n = len(graph.c)
    if not len(query):
        return 1
    rank = _squared(queries, graph.c).argsort(axis=1, kind="stable").argsort(axis=1)
    first = np.where(keep, rank[query[:, None], near], n).min(axis=1)
    need = int(np.sort(first)[max(0, int(np.ceil(target * len(first))) - 1)]) + 1
    while 4 * need < n:  # the graph is searched: what it misses counts too
        seen = np.zeros((len(queries), n), bool)
        for i, q in enumerate(queries):
            seen[i, graph.nearest(q, max(beam, need))[0][:need]] = True
        if (seen[query[:, None], near] & keep).any(axis=1).mean() >= target:
            break
        need = 2 * need
    return min(need, n)


def search(vectors: DataFrame, every: int = 100, k: int = 10, list_size: int = 128, sample: int = 40_000, most_lists: int = 8192, closure: float = 0.3, replicas: int = 6, ratio: float = 0.3, least: int = 16, beam: int = 96, part: int = 256, spread: float = 0.8, target: float = 0.99, trials: int = 256) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`, among all other rows, by Euclidean distance in double precision; ties to the smaller vec_id.

    Centroids: one for `list_size` vectors, `most_lists` at most, from the first `sample` vectors by hash; all vectors
    are indexed, of equal ones those that some query can find. Beyond most_lists * list_size vectors lists grow with the
    table; they are then cut into parts of `part` vectors, which are what tasks work on, and a query reads all parts of
    its lists. closure, replicas: how much farther a further list of a vector may be, and how many it has at most.
    spread: a further list is left out where it is nearer to one already chosen than this part of its distance to the
    vector. target, trials: as many lists are read as hold this share of the true neighbours of so many queries, which
    are compared with the whole table; vectors without structure take most of the lists for 0.99.
    ratio: lists within (1 + ratio) of the nearest list's distance are read, `least` of them at least (a query close to a
    centroid would read one alone), among the `beam` nearest (or as many as the recall needs, if these are more), and as
    many more as hold k vectors. The search of the graph keeps `beam` candidates. Vectors
    that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null
    vec_ids. Rows that repeat a vec_id and its vector count once, and with different vectors the nearer one counts.
    Fewer candidates than k give them all; no rows give none.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & e.isNotNull()).filter(fine)
    shape = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = shape
    rows = rows.filter(F.size("embedding") == dim)
    # the first `sample` rows by hash lie below this one, so a task passes on its share of twice as many, not `sample` rows
    below = min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, 2 * sample / total)))
    low = rows.filter(F.xxhash64("vec_id") <= below)
    first = low.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    x = _vectors(first["embedding"].combine_chunks(), dim)
    graph = Graph(balanced_centroids(x, min(most_lists, max(1, len(x) // 4), -(-total // list_size))))
    centroids = graph.c

    tried = rows.filter(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(trials).toArrow()
    asking = _vectors(tried["embedding"].combine_chunks(), dim)
    need = 1
    if len(asking):
        exact = truth(rows, tried["vec_id"].to_numpy(), asking, k)
        need = lists_needed(graph, asking, exact["query"].to_numpy(), *lists_of(_vectors(exact["embedding"].combine_chunks(), dim), centroids, closure, replicas, spread), target, beam)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                near, keep = lists_of(_vectors(piece.column("embedding"), dim), centroids, closure, replicas, spread)
                r, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(near[r, j].astype(np.int32)), pa.array(j == 0), piece.column("vec_id").take(pa.array(r)), piece.column("embedding").take(pa.array(r))], ["list", "own", "vec_id", "embedding"])

    element = rows.schema["embedding"].dataType.simpleString()
    # of equal vectors no query can find more than those of the k + 1 smallest ids (one may be its own); the rest need no place
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.withColumn("copy", F.dense_rank().over(alike)).filter(F.col("copy") <= k + 1).drop("copy")
    postings = staged(indexed.mapInArrow(assign, f"list int, own boolean, vec_id long, embedding {element}"), "postings")
    sizes = {r["list"]: (r["n"], r["own"]) for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("own")).collect()}
    parts = np.array([max(1, -(-sizes.get(i, (0, 0))[0] // part)) for i in range(len(centroids))])
    own = np.array([sizes.get(i, (0, 0))[1] for i in range(len(centroids))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, where = [], []
            for i, q in enumerate(_vectors(batch.column("embedding"), dim)):
                if 4 * need < len(centroids):
                    lists, d = graph.nearest(q, max(beam, need))
                else:
                    all_d = np.sqrt(_squared(q[None], centroids)[0])
                    lists = np.argsort(all_d, kind="stable")[: max(beam, need)]
                    d = all_d[lists]
                n = max(int((d[:beam] <= d[0] * (1 + ratio)).sum()), min(max(least, need), len(lists)))
                while own[lists[:n]].sum() <= k and n < len(centroids):
                    if n == len(lists):
                        lists, d = graph.nearest(q, 2 * len(lists)) if len(lists) < len(centroids) // 2 else (np.argsort(_squared(q[None], centroids)[0], kind="stable"), d)
                    n += 1
                for c in lists[:n].tolist():
                    which += [i] * int(parts[c])
                    where += [(c << 32) + p for p in range(int(parts[c]))]
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(np.zeros(len(which), np.int32)), batch.column("vec_id").take(at), batch.column("embedding").take(at)], ["place", "kind", "id", "embedding"])

    placed = f"place long, kind int, id long, embedding {element}"
    counts = F.array(*[F.lit(int(p)) for p in parts]) if len(parts) <= 256 else None
    if counts is None:
        table = spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(parts), dtype=np.int32)), "parts": pa.array(parts.astype(np.int32))}))
        sized = postings.join(F.broadcast(table), "list")  # most_lists rows at most
    else:
        sized = postings.withColumn("parts", counts[F.col("list")])
    held = sized.select((F.shiftleft(F.col("list").cast("long"), 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long"))).alias("place"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "embedding")
    asked = rows.filter(F.col("vec_id") % every == 0).mapInArrow(probe, placed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        merged = lambda: [np.concatenate([o[i] for o in out]) for i in range(3)]
        batch_of = lambda o: pa.RecordBatch.from_arrays([*map(pa.array, o)], ["query_id", "vec_id", "score"])
        for table in whole_groups(batches, "place"):
            place, kind, ids = (table.column(c).to_numpy() for c in ("place", "kind", "id"))
            v = _vectors(table.column("embedding").combine_chunks(), dim)
            cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                mid = lo + int((kind[lo:hi] == 0).sum())
                for q in range(lo, mid):
                    score = np.sqrt(((v[mid:hi] - v[q]) ** 2).sum(axis=1))
                    ok = ids[mid:hi] != ids[q]
                    best = np.lexsort((ids[mid:hi][ok], score[ok]))[:k]
                    out.append((np.full(len(best), ids[q]), ids[mid:hi][ok][best], score[ok][best]))
            if sum(len(o[0]) for o in out) > 500_000:  # one query's lists in this task are merged; what many queries fill is passed on
                q, i, score = merged()
                best = _best(q, i, score, k)
                out = [(q[best], i[best], score[best])]
                if len(best) > 250_000:
                    yield batch_of(out[0])
                    out = []
        if out:
            q, i, score = merged()
            best = _best(q, i, score, k)
            yield batch_of((q[best], i[best], score[best]))

    found = held.unionByName(asked).repartition("place").sortWithinPartitions("place", "kind").mapInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
