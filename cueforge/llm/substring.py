"""Substring dedup by level-wise doubling.

Level 1 takes windows of `start` words and asks which repeat in another document; windows repeated at one length alone
are extended to twice that length, until the asked length is reached or no candidate survives. At level 1 each window of
twice the length is stood for by the least-hashed of the `start` + 1 windows that it holds: copies hold the same one, so
none is lost, and neighbours mostly share it, so about a fourteenth of the rows is shuffled.
At the last level the least doc_id of each window decides who keeps it.

Before a shuffle every batch settles what repeats inside it and sends one row a window, so a passage in a third of all
documents sends a row of 24 bytes a batch. Candidates are windows of equal 64-bit hashes; at the last level, which decides
what is removed, windows are compared by BLAKE2b digests (128 bits) of their words themselves.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged
from .words import Block, blocks, lists, whole_groups

_LAST = np.iinfo(np.int64).max


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of the `span` values from each on; at the end, of those there are."""
    low, size, n = h >> np.uint64(1), 1, len(h)
    while size * 2 <= span:
        low[: max(n - size, 0)] = np.minimum(low[: max(n - size, 0)], low[size:])
        size *= 2
    rest = span - size
    if rest and n > rest:
        low[: n - rest] = np.minimum(low[: n - rest], low[rest:])
    return low


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _settle(h: np.ndarray, second: np.ndarray, row: np.ndarray, ids: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (window, row) pairs, a window being (h, second): (h, second, row) to ask all other batches about, and (h, row) settled here: repeated in another document, or if `last` in one with a smaller id."""
    # rows without an id come last and are no document for others
    order = np.lexsort((row, ids[row], second, h))
    h, second, row = h[order], second[order], row[order]
    keep = _changes(h, second, row)
    h, second, row = h[keep], second[keep], row[keep]
    new = _changes(h, second)
    group = np.cumsum(new) - 1
    later = ids[row] > ids[row][new][group]
    yes = later if last or not len(h) else np.maximum.reduceat(later, np.flatnonzero(new))[group]
    return h[new], second[new], row[new], h[yes], row[yes]


def _asked(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows (h, second, doc_id) sorted by h: the answers that are yes."""
    for table in whole_groups(batches, "h"):
        h, doc = (table.column(c).to_numpy() for c in ("h", "doc_id"))
        second = table.column("second").to_numpy() if last else np.zeros(len(h), np.int64)
        order = np.lexsort((doc, second, h))
        h, second, doc = h[order], second[order], doc[order]
        keep = _changes(h, second, doc)
        h, second, doc = h[keep], second[keep], doc[keep]
        new = _changes(h, second)
        group = np.cumsum(new) - 1
        later = doc > doc[new][group]
        yes = later if last else np.maximum.reduceat(later, np.flatnonzero(new))[group]
        if yes.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[yes]), pa.array(doc[yes])], ["h", "doc_id"])


def _answers(state: DataFrame, last: bool) -> DataFrame:
    """(doc_id, found): the windows of each document that repeat elsewhere."""
    windows = state.filter("doc_id is not null")
    if last:
        asked = windows.select("doc_id", F.explode(F.arrays_zip("ask", "second")).alias("w")).select("doc_id", F.col("w.ask").alias("h"), "w.second")
    else:
        asked = windows.select("doc_id", F.explode("ask").alias("h"))
    yes = asked.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _asked(it, last), "h long, doc_id long")
    return yes.groupBy("doc_id").agg(F.collect_list("h").alias("found"))


def _joined(state: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of state with any repeated window; known: settled within a batch or found among all."""
    none = F.array().cast("array<long>")
    return state.join(found, "doc_id", "left").withColumn("known", F.concat("known", F.coalesce("found", none))).filter("size(known) > 0").select(*columns)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _gather(parts: list[tuple[np.ndarray, ...]], columns: int) -> list[np.ndarray]:
    kinds = [np.uint64] * (columns - 1) + [np.int64]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def _as_lists(h: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(row, kind="stable")
    return lists(h[order].view(np.int64), row[order], n, pa.int64())


def _first_level(batches: Iterator[pa.RecordBatch], start: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, parts, count, sha = batch.num_rows, [], [], []
        for block in blocks(batch.column("text")):
            words = block.hashes()
            _, ok = block.windows(words, 2 * start)
            h, row = _least(block.windows(words, start)[0], start + 1)[ok], block.row_of_word()[ok]
            new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
            parts.append((h[new], row[new] + block.lo))
            count.append(block.counts)
            sha += [hashlib.sha256(b" ".join(block.word_bytes(r))).hexdigest() for r in range(block.hi - block.lo)]
        h, row = _gather(parts, 2)
        ask_h, _, ask_row, yes_h, yes_row = _settle(h, np.zeros(len(h), np.uint64), row, _ids(batch), False)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("mark"), pa.array(np.concatenate(count) if count else [], pa.int64()), pa.array(sha, pa.string()), _as_lists(ask_h, ask_row, n), _as_lists(yes_h, yes_row, n)], ["doc_id", "mark", "n_words", "kept_sha256", "ask", "known"])


def _repeated(batch: pa.RecordBatch, column: str, block: Block, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the windows h, standing in `rows`, are in the list that their row has."""
    col = batch.column(column).slice(block.lo, block.hi - block.lo)
    have = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    size = np.diff(np.asarray(col.offsets)) if not col.null_count else np.array([len(x) if x is not None else 0 for x in col])
    owner = np.repeat(np.arange(len(col)), size)
    number = np.unique(np.r_[h, have], return_inverse=True)[1] * np.int64(len(col) + 1)
    return np.isin(number[: len(h)] + rows, number[len(h) :] + owner)


def _next_level(batches: Iterator[pa.RecordBatch], size: int, start: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with the windows of `size` words that repeat: windows of twice the length that rest on these alone."""
    for batch in batches:
        n, parts = batch.num_rows, []
        for block in blocks(batch.column("text")):
            words, row = block.hashes(), block.row_of_word()
            longer, ok = block.windows(words, 2 * size)
            h, _ = block.windows(words, size)
            if size == start:
                ok[ok] = _repeated(batch, "known", block, _least(h, size + 1)[ok], row[ok])
            else:
                yes = _repeated(batch, "known", block, h, row)
                ok[: len(h) - size] &= yes[: len(h) - size] & yes[size:]
            if last:
                digest = block.digests(np.flatnonzero(ok), 2 * size)
                parts.append((digest[:, 0], digest[:, 1], row[ok] + block.lo))
            else:
                parts.append((longer[ok], longer[ok], row[ok] + block.lo))
        h, second, row = _gather(parts, 3)
        ask_h, ask_second, ask_row, yes_h, yes_row = _settle(h, second, row, _ids(batch), last)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("mark"), batch.column("text"), _as_lists(ask_h, ask_row, n), _as_lists(ask_second, ask_row, n), _as_lists(yes_h, yes_row, n)], ["doc_id", "mark", "text", "ask", "second", "known"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept, sha = [], [], []
        for block in blocks(batch.column("text")):
            row = block.row_of_word()
            ok = np.repeat(block.first[1:], block.counts) - np.arange(len(row)) >= window
            hit = ok.copy()
            hit[ok] = _repeated(batch, "known", block, block.digests(np.flatnonzero(ok), window)[:, 0], row[ok])
            seen = np.cumsum(hit)
            seen[window:] -= seen[:-window].copy()
            gone = seen > 0
            for r in range(block.hi - block.lo):
                lo, hi = block.first[r], block.first[r + 1]
                left = b" ".join([w for w, g in zip(block.word_bytes(r), gone[lo:hi].tolist(), strict=True) if not g])
                removed.append(int(gone[lo:hi].sum()))
                kept.append(left.decode())
                sha.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("mark"), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["doc_id", "mark", "n_removed", "kept_text", "kept_sha256"])


_STATE = "doc_id long, mark long, text string, ask array<long>, second array<long>, known array<long>"


def remove_repeats(docs: DataFrame, window: int = 50, start: int = 25) -> tuple[DataFrame, DataFrame]:
    """Remove each word covered by a window of `window` words whose words also start a window in a document with a smaller doc_id.

    docs(doc_id, text, ...) -> (per row: doc_id, mark, n_words, n_removed, kept_sha256; per row that loses words: doc_id,
    mark, n_removed, kept_text, kept_sha256). mark, xxhash64 of the text, tells rows of one doc_id apart. window must be
    start times a power of two. Windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`; kept words are joined
    by one space. Null and empty texts have no words. Rows with a null doc_id are kept whole and take words from no
    other. Rows that share a doc_id are one document: they take nothing from each other. Other columns are ignored;
    empty tables give empty tables.
    """
    if window < 2 * start or window % start or (window // start) & (window // start - 1):
        raise ValueError("window must be start times two, four, eight ...")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"), "text")
    first = staged(docs.mapInArrow(lambda it: _first_level(it, start), "doc_id long, mark long, n_words long, kept_sha256 string, ask array<long>, known array<long>"), "level")
    base = staged(first.select("doc_id", "mark", "n_words", "kept_sha256"), "whole")
    state, size = first, start
    while size < window:
        known = _joined(state, _answers(state, False), ["doc_id", "mark", "known"]).dropDuplicates(["doc_id", "mark"])
        texts = docs if size == start else state.select("doc_id", "mark", "text").distinct()
        joined = texts.join(known, ["doc_id", "mark"]).select("doc_id", "mark", "text", "known")
        after = staged(joined.mapInArrow(lambda it, s=size: _next_level(it, s, start, 2 * s == window), _STATE), "level")
        discard(state)
        state, size = after, 2 * size
    lost = _joined(state, _answers(state, True), ["doc_id", "mark", "text", "known"])
    cut = staged(lost.mapInArrow(lambda it: _cut(it, window), "doc_id long, mark long, n_removed long, kept_text string, kept_sha256 string").filter("n_removed > 0"), "cut").dropDuplicates(["doc_id", "mark"])
    discard(state)
    slim = cut.select("doc_id", "mark", "n_removed", F.col("kept_sha256").alias("cut_sha256"))
    out = base.join(slim, ["doc_id", "mark"], "left")
    return out.select("doc_id", "mark", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256")), cut
