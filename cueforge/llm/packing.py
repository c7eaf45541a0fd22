"""Best-fit packing by bin completion over the histogram of lengths.

Documents are tokenized and cut where they lie. What is packed is the histogram of piece lengths, which has `capacity`
entries at most at any corpus size: a filling (a multiset of lengths around the largest one left) is used as often as
the counts allow, so a solution is a short list of (filling, times). Best-fit decreasing gives the incumbent and the
volume bound the target; as long as they differ, undominated fillings are enumerated around the largest length and cut
by the waste that an improvement may still have. Pieces then look their place up by length and rank.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .caches import Remembered
from .storage import staged
from .words import text_bytes

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


_SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

# byte-level tokenizers write a byte that is no printable Latin-1 character as the next free one from U+0100 on
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class Words(Remembered):
    """Token ids of a word as little-endian bytes."""

    def __init__(self, model: str, most: int = 48 << 20):
        from tokenizers import Tokenizer

        super().__init__(most)
        self.tokenizer = Tokenizer.from_str(model)
        self.merges = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(_SIGNS)
        if not core.isalpha() or not (core.isascii() or max(core) < "\u0100"):
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        elif (low := core.lower()) != text:
            # letters are lower-cased, and signs after them are words of their own to the tokenizer
            found = self[low.encode()] + (self[word[len(core.encode()) :]] if len(core) < len(text) else b"")
            if len(word) > 8:
                return found  # seldom the same again; its parts are kept
        else:
            # nothing to normalize or to split: the merges alone, on the byte alphabet, give the same ids
            ids = [t.id for t in self.merges.tokenize(text if text.isascii() else word.decode("latin-1").translate(_BYTE_LETTERS))]
            found = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
        self.keep(word, found)
        return found

    def of(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8. The tokenizer drops white space and never joins over it, so words between plain white space are encoded one by one."""
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[bytes, Words] = {}


def words_of(model: str) -> Words:
    """One a worker and tokenizer, known by a digest of its file."""
    key = hashlib.sha256(model.encode()).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Words(model)
    return _loaded[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, rows: int = 10_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32), in batches of `rows` at most and the pieces of one text. The tokenizer file is read by the driver (its size is fixed) and sent along."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        doc, k, start, length, crc = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, made = words_of(model), []
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            data, offs = memoryview(data), offs.tolist()
            for doc, at, end in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), offs, offs[1:], strict=False):
                raw = words.of(bytes(data[at:end])) + b"\0\0\0\0"
                made += [(doc, k, at // 4, min(4 * capacity, len(raw) - at) // 4, zlib.crc32(raw[at : at + 4 * capacity])) for k, at in enumerate(range(0, len(raw), 4 * capacity))]
                if len(made) >= rows:
                    yield batch_of(made)
                    made = []
        if made:
            yield batch_of(made)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by volume, or by what is too long to share with pieces of at least k tokens."""
    lengths = np.arange(capacity + 1)
    volume, number = counts * lengths, counts
    best = -(-int(volume.sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = int(number[capacity - k + 1 :].sum())
        half = slice(capacity // 2 + 1, capacity - k + 1)
        small = slice(k, capacity // 2 + 1)
        room = int(number[half].sum()) * capacity - int(volume[half].sum())
        best = max(best, alone + int(number[half].sum()) + max(0, -(-(int(volume[small].sum()) - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing with bins of equal content kept as one."""
    open_bins: dict[int, list[list]] = {}  # room left -> [filling, times]
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for room in sorted(r for r in open_bins if r >= length):
            if not left:
                break
            for group in open_bins.pop(room):
                fit = min(room // length, left) if left else 0
                if not fit:
                    open_bins.setdefault(room, []).append(group)
                    continue
                full = left // fit if fit == room // length else 1
                take = min(group[1], full)
                open_bins.setdefault(room - fit * length, []).append([group[0] + ((length, fit),), take])
                left -= take * fit
                if group[1] > take:
                    rest = group[1] - take
                    if 0 < left < fit:
                        open_bins.setdefault(room - left * length, []).append([group[0] + ((length, left),), 1])
                        left, rest = 0, rest - 1
                    if rest:
                        open_bins.setdefault(room, []).append([group[0], rest])
        each = capacity // length
        if left >= each:
            open_bins.setdefault(capacity - each * length, []).append([((length, each),), left // each])
        if left % each:
            open_bins.setdefault(capacity - left % each * length, []).append([((length, left % each),), 1])
    return [(tuple(f), n) for groups in open_bins.values() for f, n in groups]


def fillings(largest: int, counts: np.ndarray, capacity: int, waste: int, most: int = 64, nodes: int = 4000) -> tuple[list[Filling], int]:
    """Undominated fillings around `largest` that waste no more than `waste`, least waste first, then fewest pieces; and the steps taken.

    Dominated: another piece still fits, or a longer piece that is left could take one piece's place. The enumeration
    goes longest first and ends after `nodes` steps.
    """
    have = np.flatnonzero(counts)
    found: list[tuple[int, int, list[int]]] = []
    steps = 0

    def longest(room: int, cap: int, used: list[int]) -> int:
        i = int(np.searchsorted(have, min(room, cap), "right")) - 1
        while i >= 0 and counts[have[i]] <= used.count(int(have[i])):
            i -= 1
        return int(have[i]) if i >= 0 else 0

    def grow(room: int, cap: int, used: list[int]) -> None:
        nonlocal steps
        first = True
        while steps < nodes and len(found) < most:
            steps += 1
            item = longest(room, cap, used)
            if not item:
                if first and not longest(room, room, used) and room <= waste:
                    found.append((room, len(used), used))
                return
            grow(room - item, item, [*used, item])
            if found and found[-1][0] == 0 and len(found[-1][2]) <= len(used) + 1:
                return  # filled to the brim by this piece: all that start shorter are dominated
            cap, first = item - 1, False

    grow(capacity - largest, capacity - largest, [largest])
    out = []
    for _, _, used in sorted(found, key=lambda f: f[:2]):
        out.append(tuple((x, used.count(x)) for x in sorted(set(used), reverse=True)))
    return out, steps


def exhaust(counts: np.ndarray, capacity: int, bins: int, budget: list[int]) -> list[tuple[Filling, int]] | None:
    """A packing of fewer than `bins` sequences by depth-first search over the undominated fillings around the largest length, each used as often as it can be first; none if there is none, or none within the budget of places and of steps of the enumerations, from which it takes what it uses."""
    found, lengths, left = None, np.arange(capacity + 1), counts.copy()

    def ways(waste: int) -> Iterator[tuple[Filling, int]]:
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        some, steps = fillings(largest, left, capacity, waste, most=1 << 20, nodes=min(1 << 16, budget[1]))
        left[largest] += 1
        budget[1] -= steps
        for way in some:
            lost, times = capacity - sum(x * k for x, k in way), min(int(left[x]) // k for x, k in way)
            for n in range(min(times, waste // lost) if lost else times, 0, -1):
                yield way, n

    def put(way: Filling, n: int) -> None:
        for x, k in way:
            left[x] -= k * n

    volume, used, plan = int((left * lengths).sum()), 0, []
    if not volume or volume > (bins - 1) * capacity:
        return None
    open_ = [ways((bins - 1) * capacity - volume)]
    while open_ and min(budget) > 0:
        if len(plan) == len(open_):  # back from below
            way, n = plan.pop()
            put(way, -n)
            used, volume = used - n, volume + n * sum(x * k for x, k in way)
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
            continue
        way, n = step
        budget[0] -= 1
        plan.append(step)
        put(way, n)
        used, volume = used + n, volume - n * sum(x * k for x, k in way)
        if not volume and used < bins:
            found, bins = list(plan), used
        waste = (bins - 1 - used) * capacity - volume
        if volume and waste >= 0:
            open_.append(ways(waste))
    return found


def loosest(plan: list[tuple[Filling, int]], capacity: int, pieces: int = 400) -> tuple[list[tuple[Filling, int]], list[tuple[Filling, int]]]:
    """The sequences of a plan that waste most, as many as hold so many pieces, and the others."""
    some, rest = [], []
    for way, times in sorted(plan, key=lambda p: sum(x * k for x, k in p[0])):
        each = sum(k for _, k in way)
        take = min(times, pieces // each)
        pieces = pieces - take * each if take == times else 0
        some += [(way, take)] if take else []
        rest += [(way, times - take)] if take < times else []
    return some, rest


def complete(counts: np.ndarray, capacity: int, dives: int = 6) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used. Branch and bound: each dive follows the best fillings around the largest length left; where a dive ends without reaching the bound, the next one departs from it at the place with the most waste.

    Where that ends above the lower bound, the sequences that waste most, of 400 pieces together, are packed anew by `exhaust`,
    as long as this saves one; all of them, if they hold no more. The limits: `dives`; 64 fillings and 4,000 steps for a largest
    length; then 5,000 places and two million steps over all fillings. They are the same for any number of pieces. Where they
    end the search above the bound, the packing is the best found so far.
    """
    target, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    total = int((counts * np.arange(capacity + 1)).sum())
    detour: dict[int, int] = {}  # step -> which of its fillings
    for _ in range(dives):
        if bins <= target:
            break
        left, waste, now, used, wasted = counts.copy(), (bins - 1) * capacity - total, [], 0, []
        while used < bins - 1:
            have = np.flatnonzero(left)
            if not len(have):
                break
            largest = int(have[-1])
            left[largest] -= 1
            ways, _ = fillings(largest, left, capacity, waste)
            left[largest] += 1
            if not ways:
                break
            way = ways[min(detour.get(len(now), 0), len(ways) - 1)]
            lost = capacity - sum(x * k for x, k in way)
            times = min(int(left[x]) // k for x, k in way)
            if lost:
                times = max(1, min(times, waste // lost))
            for x, k in way:
                left[x] -= k * times
            now.append((way, times))
            used, waste = used + times, waste - lost * times
            wasted.append((lost * times, len(now) - 1, len(ways)))
        if not left.any():
            best, bins = now, used
            detour = {}
        else:
            open_steps = [w for w in wasted if w[2] > detour.get(w[1], 0) + 1]
            if not open_steps:
                break
            step = max(open_steps)[1]
            detour = {k: v for k, v in detour.items() if k < step} | {step: detour.get(step, 0) + 1}
    budget = [5000, 2_000_000]
    while bins > target:
        some, rest = loosest(best, capacity)
        again = np.zeros_like(counts)
        for way, times in some:
            for x, k in way:
                again[x] += k * times
        fewer = exhaust(again, capacity, sum(n for _, n in some), budget)
        if not fewer:
            break
        best = rest + fewer
        bins = sum(n for _, n in best)
    return best


def places(plan: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), by length and rank."""
    rows, sequence, rank = [], 0, {}
    for filling, times in plan:
        at = 0
        merged: dict[int, int] = {}
        for length, k in filling:
            merged[length] = merged.get(length, 0) + k
        for length, k in merged.items():
            rows.append((length, rank.get(length, 0), k, sequence, at))
            rank[length] = rank.get(length, 0) + k * times
            at += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece.

    A document is its token ids and then id 0; only what is longer than capacity is cut. Null text: as empty, one piece
    of length 1. Null and repeated doc_ids and repeated rows are packed like any other. Other columns are ignored; an
    empty table gives an empty one. The driver sees counts by length, `capacity` of them at most.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer_path, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
    table = places(complete(counts, capacity))
    # ranks within a length: dealt over parts, so that a length that many pieces have is no single group
    parts = max(64, int(counts.sum()) // 100_000)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.row_number().over(own) - 1)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << np.int64(48)
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, first, each, sequence, at = table[np.searchsorted(keys, length * wide + rank, "right") - 1].T
            k = rank - first
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence + k // each), pa.array(at + k % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if not len(table):
        return spark.createDataFrame([], columns + ", sequence_id long, offset long")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(put, columns + ", sequence_id long, offset long")
