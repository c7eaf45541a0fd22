"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint is cut into bytes; two fingerprints that differ in d bits share at least (bytes - d) positional bytes.
The index is keyed by several positional bytes together, as a single byte has only 256 values and its posting lists would
grow with the square of the corpus. Positions are dealt into d + 2 groups and two groups make a key, so whichever d bytes
differ, some key is left whole: six keys of four bytes each for 64 bits and d = 2. In a posting list the shared positional
bytes of a pair are tallied over all positions; pairs below the guaranteed minimum fall, the rest is verified by its
differing bits, and a spanning forest of verified links is passed on, never all pairs. Lists that are too long for one task are
keyed anew, by all sets of as many positions as the minimum; what such a key leaves open is d bytes, so its lists hold
256 ** d fingerprints at most.

Where a similarity of shingle sets is asked for, byte positions guarantee nothing: two sets of a Jaccard similarity of
0.8 differ in 15 % of their bits on average, and a shared byte is certain below one bit in eight only. So candidates come
from the sets there: two sets of n and m shingles and a similarity t share ceil(t * max(n, m)) at least, hence in any
common order of all shingles they share one among the first n - ceil(t * n) + 1 and m - ceil(t * m) + 1. These prefixes are
indexed; the order puts what is frequent in a sample last, which keeps lists short and has no part in what is found. In
a list, what is far apart is told by sketches: how many of a set's shingles fall into each of some bins, one for five of
them. Two sets share at most the sum of the lesser counts, so a pair for which that is too little is no candidate, and no
link is lost. What the rest connects is a group, in which every link is verified on the sets.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, staged
from .words import LOWER, Block, blocks, lists, mix, whole_groups

_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of lower-cased words joined by one space, and the first shingle of each row. Texts with fewer words give one shingle, those with none give none."""
    out: list[int] = []
    count = np.zeros(block.hi - block.lo + 1, np.int64)
    digest = xxhash.xxh64_intdigest
    data = LOWER[block.data]
    for row in range(block.hi - block.lo):
        parts = data[block.offs[row] : block.offs[row + 1]].tobytes().split()
        n = len(parts)
        if not n:
            continue
        text = b" ".join(parts)
        if n <= words:
            out.append(digest(text, 42))
            count[row + 1] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
        starts = np.zeros(n, np.int64)
        starts[1:] = ends[:-1] + 1
        m = n - words + 1
        out += [digest(text[a:b], 42) for a, b in zip(starts[:m].tolist(), ends[words - 1 :].tolist(), strict=True)]
        count[row + 1] = m
    return np.array(out, np.uint64), np.cumsum(count)


def shingle_sets(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's distinct shingles of lower-cased words, ascending, and the first of each row. Texts with fewer words have one shingle, those with none have none."""
    h, row, count = block.hashes(LOWER[block.data]), block.row_of_word(), block.counts
    whole, ok = block.windows(h, words)
    found, rows = [whole[ok]], [row[ok]]
    for n in range(1, words):
        at = np.flatnonzero(count == n)
        found.append(block.windows(h, n)[0][block.first[at]] if len(at) else h[:0])
        rows.append(at)
    h, row = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
    return h[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the 64 bits that are set in over half of its hashes."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # lanes of 8 bits hold up to 255 additions
    pieces = -(-n[full] // 255)
    at = np.repeat(first[full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    rows = np.cumsum(pieces) - pieces
    raw = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[raw[:, j]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes = np.add.reduceat(lanes, rows, axis=0) * 2 > n[full][:, None]
        out[full] |= (votes.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * j)
    return out


def _prints(h: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    return np.stack([majority(h if k == 0 else mix(h + np.uint64(_GOLDEN * k % 2**64)), first) for k in range(hashes)], axis=1)


def _listed(prints: np.ndarray) -> pa.ListArray:
    n, k = prints.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(prints.reshape(-1).view(np.int64)))


def fingerprints(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, mark: xxhash64 of the text, fp array<long> of `hashes` times 64 bits). Null and empty texts have all bits zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                own = _listed(_prints(*shingle_hashes(block, words), hashes))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(block.lo, len(own)) for c in ("doc_id", "mark")] + [own], ["doc_id", "mark", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, fp array<long>")


def byte_keys(positions: int, differing: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which one is whole, whichever `differing` positions are not: two groups of differing + 2, or where there are not as many positions, each alone."""
    if differing + 2 > positions:
        return [(p,) for p in range(positions)]
    groups = [tuple(range(g, positions, differing + 2)) for g in range(differing + 2)]
    return [tuple(sorted(a + b)) for a, b in combinations(groups, 2)]


def finer_keys(positions: int, differing: int, key: tuple[int, ...]) -> list[tuple[int, ...]]:
    """All sets of as many positions as two fingerprints are sure to share that hold those of key."""
    rest = [p for p in range(positions) if p not in key]
    return [tuple(sorted((*key, *more))) for more in combinations(rest, max(0, positions - differing - len(key)))]


def _key(positions: tuple[int, ...]):
    parts = [F.lit(sum(1 << p for p in positions))]
    for word in sorted({p // 8 for p in positions}):
        mask = sum(0xFF << (8 * (p % 8)) for p in positions if p // 8 == word)
        parts.append(F.col("fp")[word].bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask)))
    return F.xxhash64(*parts)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Edges (least node of a component, node) of the graph over 0 ... n-1 whose links `near(one, others)` tells; each node found is compared with those not yet reached only."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        todo = [root]
        while todo and len(left):
            at = todo.pop()
            hit = near(at, left)
            found = left[hit]
            edges += [(root, x) for x in found.tolist()]
            todo += found.tolist()
            left = left[~hit]
    return np.array(edges, np.int64).reshape(-1, 2)


def tallied(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Spanning edges of the graph that links rows of fp (n x words) at max_bits differing bits or fewer. The equal positional bytes of a pair are tallied first: fewer than the guaranteed minimum rule it out."""
    minimum = 8 * fp.shape[1] - max_bits

    def near(at: int, others: np.ndarray) -> np.ndarray:
        differ = fp[others] ^ fp[at]
        hit = (differ.view(np.uint8).reshape(len(others), -1) == 0).sum(axis=1) >= minimum
        hit[hit] = np.bitwise_count(differ[hit]).sum(axis=1, dtype=np.int64) <= max_bits
        return hit

    return forest(len(fp), near)


def _cuts(table: pa.Table, keys: tuple[str, ...] = ("key",)) -> np.ndarray:
    """Where each list of a sorted table begins, and its end."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for c in keys:
        key = table.column(c).to_numpy()
        new |= key[1:] != key[:-1]
    return np.flatnonzero(np.r_[True, new, True])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def links(nodes: DataFrame, hashes: int, max_bits: int, long: int = 10_000) -> DataFrame:
    """nodes(node long, fp), one row a fingerprint -> (a, b), edges that connect what links of max_bits differing bits or fewer connect. Lists of over `long` nodes are keyed anew."""
    positions = 8 * hashes
    if max_bits >= positions:
        raise ValueError("byte positions guarantee a match for fewer differing bits than bytes only")
    chosen = byte_keys(positions, max_bits)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            node, cut = table.column("node").to_numpy(), _cuts(table)
            fp = table.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, hashes)
            edges = [lo + tallied(fp[lo:hi], max_bits) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if hi - lo > 1]
            if edges:
                edges = np.concatenate(edges)
                yield _pairs(node[edges[:, 0]], node[edges[:, 1]])

    def met(postings: DataFrame) -> DataFrame:
        return postings.select("node", "fp", "key").repartition("key").sortWithinPartitions("key", "node").mapInArrow(grouped, "a long, b long")

    keyed = F.array(*[F.struct(_key(c).alias("key"), F.lit(i).alias("number")) for i, c in enumerate(chosen)])
    postings = nodes.select("node", "fp", F.inline(keyed))
    hot = staged(postings.groupBy("key").count().filter(F.col("count") > long).select("key"), "hot")
    if not hot.count():
        return met(postings).distinct()
    finer = F.when(F.lit(False), F.array().cast("array<long>"))
    for i, c in enumerate(chosen):
        finer = finer.when(F.col("number") == i, F.array(*[_key(x) for x in finer_keys(positions, max_bits, c)]))
    parted = postings.join(hot, "key", "left_semi").select("node", "fp", F.explode(finer).alias("key"))
    return met(postings.join(hot, "key", "left_anti")).union(met(parted)).distinct()


def frequent(docs: DataFrame, words: int, sample: int, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, that at least three of about `sample` texts have, and in how many; `most` of them."""
    rate = max(1, docs.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(block, words)[0].view(np.int64))], ["key"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rate)) == 0).select("text")
    counts = some.mapInArrow(run, "key long").groupBy("key").count().filter("count >= 3")
    table = counts.orderBy(F.desc("count"), "key").limit(most).toArrow()
    keys, n = table["key"].to_numpy().view(np.uint64), table["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefixes(docs: DataFrame, words: int, hashes: int, similarity: float, sample: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, mark, node: hash of the set of distinct shingles, n: how many, fp: of these, sketch binary, prefix array<long>)."""
    known, often = frequent(docs, words, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                h, first = shingle_sets(block, words)
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                node = np.zeros(len(n), np.uint64)
                if len(h):
                    node[n > 0] = mix(np.add.reduceat(mix(h), first[:-1][n > 0]) + n[n > 0].astype(np.uint64))
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                times = np.where(known[at] == h, often[at], 0) if len(known) else np.zeros(len(h), np.int64)
                order = np.lexsort((h, times, row))
                take = np.arange(len(h)) - first[row] <= (n - np.ceil(similarity * n - 1e-6).astype(np.int64))[row]
                prefix = lists(h[order][take].view(np.int64), row[take], len(n), pa.int64())
                doc, mark = (batch.column(c).slice(block.lo, len(n)) for c in ("doc_id", "mark"))
                yield pa.RecordBatch.from_arrays([doc, mark, pa.array(node.view(np.int64)), pa.array(n), _listed(_prints(h, first, hashes)), sketches(h, first), prefix], ["doc_id", "mark", "node", "n", "fp", "sketch", "prefix"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(run, "doc_id long, mark long, node long, n long, fp array<long>, sketch binary, prefix array<long>")


def shared_lists(nodes: DataFrame) -> DataFrame:
    """nodes(node, prefix) -> (key, node): the lists that hold two nodes at least. Lists of the same nodes get the same key and so are one, with its rows repeated."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            node, cut = table.column("node").to_numpy(), _cuts(table)
            n = np.diff(cut)
            members = mix(np.add.reduceat(mix(node.view(np.uint64)), cut[:-1]) + n.astype(np.uint64))
            _, once = np.unique(members, return_index=True)  # once from here
            keep = np.zeros(len(n), bool)
            keep[once] = n[once] > 1
            keep = np.repeat(keep, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(members, n)[keep].view(np.int64)), pa.array(node[keep])], ["key", "node"])

    postings = nodes.select("node", F.explode("prefix").alias("key"))
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, node long")


_FULL = 15  # the greatest count of a bin that is kept; it stands for as many or more


def sketches(h: np.ndarray, first: np.ndarray) -> pa.BinaryArray:
    """For each row how many of its hashes fall into each of B bins, two bins a byte; B is a power of two near a fifth of their number, 16 at least and 2048 at most."""
    n = np.diff(first)
    log = np.clip(np.rint(np.log2(np.maximum(n, 1) / 5)), 4, 11).astype(np.int64)
    at = np.r_[0, np.cumsum(1 << log)]
    row = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(at[row] + (h >> (64 - log[row]).astype(np.uint64)).astype(np.int64), minlength=int(at[-1]))
    counts = np.minimum(counts, _FULL).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 2).astype(np.int32)), pa.py_buffer(counts[::2] | counts[1::2] << 4)])


class Sketches:
    """Sketches of many sets, to be compared; each also at half its bins, as sets of like sizes may have twice as many."""

    def __init__(self, column: pa.BinaryArray):
        offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(column) else np.zeros(0, np.uint8)
        own = np.empty(2 * len(raw), np.int16)
        own[::2], own[1::2] = raw & 15, raw >> 4
        own[own == _FULL] = 1000
        self.bins, self.own = 2 * np.diff(offs), 2 * (offs[:-1] - offs[0])
        self.half = len(own) + self.own // 2
        self.flat = np.r_[own, own[::2] + own[1::2]]

    def most_shared(self, a: np.ndarray, b: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
        """How many members the sets a and b (pair by pair) share at most; where both are full in a bin, nothing is known."""
        out = np.full(len(a), np.inf)
        level = np.minimum(self.bins[a], self.bins[b])
        near = np.maximum(self.bins[a], self.bins[b]) <= 2 * level
        for bins in np.unique(level[near]).tolist():
            pairs = np.flatnonzero(near & (level == bins))
            for lo in range(0, len(pairs), max(1, chunk // bins)):
                some = pairs[lo : lo + max(1, chunk // bins)]
                x, y = (self.flat[np.where(self.bins[z[some]] == bins, self.own[z[some]], self.half[z[some]])[:, None] + np.arange(bins)] for z in (a, b))
                least = np.minimum(x, y)
                out[some] = np.where((least >= 1000).any(axis=1), np.inf, least.sum(axis=1, dtype=np.int64))
        return out


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes(node, n, sketch, prefix) -> (a, b), edges that connect at least what sets of this similarity connect: nodes of one list whose sizes and sketches allow it."""

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            node = table.column("node").to_numpy()
            table = table.take(pa.array(_cuts(table, ("key", "node"))[:-1]))
            node, n, cut = table.column("node").to_numpy(), table.column("n").to_numpy(), _cuts(table)
            sketch = table.column("sketch").combine_chunks()
            sketch = Sketches(sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch)

            def like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                # a similarity s of sets of n and m members is s / (1 + s) * (n + m) members shared
                needed = similarity / (1 + similarity) * (n[a] + n[b]) - 1e-6
                hit = np.minimum(n[a], n[b]) >= needed
                hit[hit] = sketch.most_shared(a[hit], b[hit]) >= needed[hit]
                return hit

            two = cut[:-1][np.diff(cut) == 2]
            hit = two[like(two, two + 1)]
            edges = [np.c_[hit, hit + 1]]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo > 2:
                    edges.append(lo + forest(hi - lo, lambda at, others, lo=lo: like(np.full(len(others), lo + at), lo + others)))
            edges = np.concatenate(edges)
            if len(edges):
                yield _pairs(node[edges[:, 0]], node[edges[:, 1]])

    listed = shared_lists(nodes).join(nodes.select("node", "n", "sketch"), "node")
    return listed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(screened, "a long, b long").distinct()


def set_forest(flat: np.ndarray, offs: np.ndarray, similarity: float) -> np.ndarray:
    """Edges (least node of a component, node) of the graph that links sets (flat[offs[i]:offs[i + 1]]) of this Jaccard similarity or more; each set found is compared with those not yet reached only."""
    sizes = np.diff(offs)
    _, token = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    by = np.argsort(token, kind="stable")
    holders, tokens = owner[by], token[by]
    start = np.searchsorted(tokens, np.arange(tokens[-1] + 2 if len(tokens) else 1))
    open_, indexed, edges = np.ones(len(sizes), bool), len(sizes), []
    for seed in range(len(sizes)):
        if not open_[seed]:
            continue
        todo, open_[seed] = [seed], False
        while todo:
            remain = int(open_.sum())
            if not remain:
                break
            if 2 * remain < indexed:  # only what is not reached stays in the index
                keep = open_[holders]
                holders, tokens, indexed = holders[keep], tokens[keep], remain
                start = np.searchsorted(tokens, np.arange(len(start)))
            at = todo.pop()
            mine = token[offs[at] : offs[at + 1]]
            lo, n = start[mine], start[mine + 1] - start[mine]
            place = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            shared = np.bincount(holders[place], minlength=len(sizes))
            found = np.flatnonzero(open_ & (shared > 0) & (shared >= similarity * (sizes[at] + sizes - shared) - 1e-9))
            edges += [(seed, x) for x in found.tolist()]
            open_[found] = False
            todo += found.tolist()
    return np.array(edges, np.int64).reshape(-1, 2)


def similar(nodes: DataFrame, docs: DataFrame, words: int, similarity: float, together: tuple[int, int] = (20_000, 4_000_000)) -> DataFrame:
    """nodes(node, n, some, sketch, prefix) -> (node, root): the components of the graph that links sets of this similarity or more; nodes without a link have no row.

    some: doc_id and mark of a text of the node. What candidates connect is a group. A group of no more nodes and
    shingles than `together` is settled in one task, each of its texts sent once. A larger one goes list by list: the texts
    of a list are sent to its task, and the links found there are joined up.
    """

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            table = table.take(pa.array(_cuts(table, ("key", "node"))[:-1]))  # a text that rows repeat counts once
            node, cut = table.column("node").to_numpy(), _cuts(table)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                flat, sizes = [], []
                for block in blocks(table.column("text").slice(lo, hi - lo)):
                    h, first = shingle_sets(block, words)
                    flat.append(h)
                    sizes.append(np.diff(first))
                edges = lo + set_forest(np.concatenate(flat), np.r_[0, np.cumsum(np.concatenate(sizes))], similarity)
                if len(edges):
                    yield _pairs(node[edges[:, 0]], node[edges[:, 1]])

    def forests(keyed: DataFrame) -> DataFrame:
        return keyed.select("key", "node", "text").repartition("key").sortWithinPartitions("key", "node").mapInArrow(spanned, "a long, b long")

    edges = staged(candidates(nodes, similarity), "candidates")
    groups = staged(components(edges).join(nodes.select("node", "n", "some"), "node"), "groups")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    same = F.col("some.doc_id").eqNullSafe(F.col("doc_id")) & F.col("some.mark").eqNullSafe(F.col("mark"))
    sizes = groups.groupBy("root").agg((F.count("*") > together[0]).alias("many"), (F.sum("n") > together[1]).alias("wide"))
    large = staged(sizes.filter("many or wide").select("root"), "large")
    some = large.count() > 0
    whole = groups.join(large, "root", "left_anti") if some else groups
    found = forests(whole.join(marked, same).select(F.col("root").alias("key"), "node", "text"))
    # a group in one task gives the least node of each of its components with every other
    rooted = staged(found, "found")
    out = rooted.select(F.col("b").alias("node"), F.col("a").alias("root")).union(rooted.select(F.col("a"), F.col("a")).distinct())
    if some:
        rest = groups.join(large, "root", "left_semi")
        texts = staged(rest.join(marked, same).select("node", "text"), "texts")
        listed = shared_lists(nodes.join(rest.select("node"), "node", "left_semi")).join(texts, "node")
        out = out.union(components(forests(listed)))
    discard(edges)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, hashes: int = 4, similarity: float | None = 0.8, max_bits: int = 2, sample: int = 20_000) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, mark, fp array<long>, root, component_id): one row a row of docs.

    words: of a shingle. root is a component's own number, component_id the smallest doc_id that links reach; mark is
    xxhash64 of the text. With a similarity, texts link whose sets of distinct shingles (by 64-bit hashes) have that Jaccard
    similarity or more, and fp is made of the distinct shingles; sample: of about so many texts frequent shingles are
    counted. Without one, fingerprints of 64 x hashes bits, in which repeated shingles count, link at max_bits differing bits
    or fewer, all of them.
    Equal sets, or fingerprints, are one node, so copies cost one index entry. Null text: as empty; texts without words
    are equal to each other. Null doc_id: its row stays, and it never names a component unless all of it has none (then null).
    Repeated rows stay repeated. Other columns are ignored. Empty tables give empty tables.
    """
    if similarity is None:
        fps = fingerprints(docs, words, hashes)
        fps = staged(fps.withColumn("node", F.col("fp")[0] if hashes == 1 else F.xxhash64("fp")), "fingerprints")
        nodes = staged(fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "nodes")
        roots = components(links(nodes, hashes, max_bits))
    else:
        sets = staged(prefixes(docs, words, hashes, similarity, sample), "sets")
        first = [F.first(c).alias(c) for c in ("n", "sketch", "prefix")]
        nodes = staged(sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("some"), *first), "nodes")
        fps = sets.select("doc_id", "mark", "fp", "node")
        roots = staged(similar(nodes, docs, words, similarity), "roots")
    linked = roots.join(nodes.select("node", "least"), "node")
    names = linked.groupBy("root").agg(F.min("least").alias("named"))
    named = roots.join(names, "root").select("node", "root", "named")
    classes = nodes.select("node", "least").join(named, "node", "left")
    # both sides are read from tables, so a fingerprint of very many rows is split by the engine's skew join
    classes = staged(classes.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("named", "least").alias("component_id")), "classes")
    return fps.join(classes, "node").select("doc_id", "mark", "fp", "root", "component_id")
