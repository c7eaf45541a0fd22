"""Words of whole texts as numpy arrays, hashed without a Python loop over words.

A block is a run of rows of one Arrow column. Words are what `[^\\x20\\x09-\\x0D]+` matches in the UTF-8 bytes.
Null texts have no words.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SEED, _ALL = np.uint64(0x5851F42D4C957F2D), np.uint64(2**64 - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 ... base**(n-1) modulo 2**64, and their inverses."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (_BASE[which], pow(_BASE[which], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[which] = (made[0], made[1])
    return have[0][:n], have[1][:n]


class Block:
    """Rows lo to hi of a batch. data: their bytes; offs: where each text starts; starts, ends: of the words; first: each text's first word."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs
        n = len(data)
        space = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        edge[0] = edge[n] = True
        before = edge[:n].copy()
        before[1:] |= space[: n - 1] if n else False
        after = edge[1:].copy()
        after[: max(n - 1, 0)] |= space[1:]
        word = ~space
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def numbers(self, data: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
        """The number of each word among the distinct ones, told apart by their bytes, and these."""
        data = self.data if data is None else data
        offs = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offs[1:])
        letters = np.ascontiguousarray(data[~SPACE[data]])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offs), pa.py_buffer(letters)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight at a time, mixed after each step; words of over 32 bytes by XXH3."""
        data = self.data if data is None else data
        size = self.ends - self.starts
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
        out = mix(size.astype(np.uint64) + _SEED)
        left = np.flatnonzero(size <= 32)
        for at in (0, 8, 16, 24):
            left = left[size[left] > at]
            if not len(left):
                break
            rest = np.minimum(size[left] - at, 8).astype(np.uint64)
            letters = np.ascontiguousarray(eight[self.starts[left] + at]).view("<u8").ravel() & (_ALL >> (np.uint64(64) - np.uint64(8) * rest))
            out[left] = mix(mix(out[left] ^ letters) + _SEED)
        for i in np.flatnonzero(size > 32).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[self.starts[i] : self.ends[i]].tobytes(), 7)
        return out

    def windows(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the `size` words from each word on, and which of these windows lie in one text.

        Short windows are mixed word by word. Longer ones are sums in powers of a base, which some orders of two words
        defeat: they tell candidates only, and what they call equal is compared by other means.
        """
        n = len(h)
        ok = np.zeros(n, bool)
        if n < size:
            return np.zeros(n, np.uint64), ok
        m = n - size + 1
        out = np.zeros(n, np.uint64)
        if size <= 8:
            out[:m] = h[:m]
            for k in range(1, size):
                out[:m] = mix(out[:m] * np.uint64(_BASE[1]) + h[k : k + m])
        else:
            p, inverse = powers(n + 1, 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(h * p[:-1], out=sums[1:])
            out[:m] = mix((sums[size:] - sums[:m]) * inverse[:m])
        ok[:m] = np.repeat(self.first[1:], self.counts)[:m] - np.arange(m) >= size
        return out, ok

    def digests(self, at: np.ndarray, size: int) -> np.ndarray:
        """BLAKE2b (128 bits, as two numbers) of the `size` words from each word of `at` on, joined by one space."""
        length = self.ends - self.starts
        begin = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length + 1, out=begin[1:])
        joined = np.full(int(begin[-1]), 32, np.uint8)
        joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = self.data[~SPACE[self.data]]
        text, digest = memoryview(joined.tobytes()), hashlib.blake2b
        found = [digest(text[a:b], digest_size=16).digest() for a, b in zip(begin[at].tolist(), (begin[at + size] - 1).tolist(), strict=True)]
        return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)

    def word_bytes(self, row: int) -> list[bytes]:
        return self.data[self.offs[row] : self.offs[row + 1]].tobytes().split()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and the offsets of each; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = 1 << 18) -> Iterator[Block]:
    """The batch in runs of rows of about `limit` bytes; a longer text is a block of its own."""
    data, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key, cut so that no group is in two tables."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if cut:
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held = []
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """A list for each of n rows; `row`, ascending, tells the row of each value."""
    offs = np.searchsorted(row, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
