"""Quality rules: counts that junk shows, and the divergence of a text from its language.

A document is described by two histograms: the classes of its characters, and its common words. Both are compared with
references of its language, gathered over the whole table, by the Jensen-Shannon distance (base 2, so 0 to 1). Word
histograms are over 65,536 hash bins, so that what is gathered is bounded whatever the vocabulary; a language's common words
are the bins that hold at least a five-hundredth of it (500 at most, nearly always one word each), and all others are one
bin more. Short texts have rough histograms by chance: below a number of words or characters a histogram isn't compared.
"""

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged
from .words import LOWER, SPACE, Block, blocks

BINS = 1 << 16
#: Small letters, capitals, digits, white space, marks of sentences, other ASCII signs, all else.
CLASSES = 7
_CLASS = np.full(256, 6, np.int64)
_CLASS[:128] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[SPACE] = 3
_CLASS[np.frombuffer(b".,;:?!'\"()-", np.uint8)] = 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UNIT = 1 << 20  # shares are summed as whole numbers, so that sums don't depend on their order


def _per_row(block: Block, yes: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(yes)][block.offs])


def repeated_words(block: Block, size: int = 3) -> np.ndarray:
    """How many words of each row lie in windows of `size` words that the row has twice or more; words are compared by their bytes."""
    n = len(block.starts)
    if n < size:
        return np.zeros(block.hi - block.lo, np.int64)
    word, row = block.numbers()[0].astype(np.int64), block.row_of_word()
    window = row
    for k in range(size):  # the number of (row, word, word ...) among all such
        window = np.unique(window[: n - size + 1] * np.int64(n) + word[k : n - size + 1 + k], return_inverse=True)[1]
    inside = row[: n - size + 1] == row[size - 1 :]
    often = np.bincount(window[inside], minlength=int(window.max()) + 1)
    hit = np.flatnonzero(inside & (often[window] > 1))
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[hit + k] = True
    return np.bincount(row[covered], minlength=block.hi - block.lo)


def counts(block: Block) -> dict[str, np.ndarray]:
    """The counts of each row."""
    repeats = []
    for a, b in zip(block.offs[:-1].tolist(), block.offs[1:].tolist(), strict=True):
        lines = [x for x in block.data[a:b].tobytes().split(b"\n") if x.strip()]
        repeats.append(len(lines) - len(set(lines)))
    return {
        "n_words": block.counts,
        "word_chars": _per_row(block, ~SPACE[block.data] & (block.data & 0xC0 != 0x80)),
        "n_symbols": _per_row(block, _SYMBOL[block.data]),
        "n_dup_lines": np.array(repeats, np.int64),
        "n_repeat_words": repeated_words(block),
    }


def classes(block: Block) -> np.ndarray:
    """Characters of each class, a row for each row."""
    first = block.data & 0xC0 != 0x80
    n = block.hi - block.lo
    row = np.repeat(np.arange(n), np.diff(block.offs))
    return np.bincount(row[first] * CLASSES + _CLASS[block.data[first]], minlength=n * CLASSES).reshape(n, CLASSES)


def word_bins(block: Block) -> np.ndarray:
    """The bin of each word, whose capitals A to Z count as small letters."""
    return (block.hashes(LOWER[block.data]) >> np.uint64(48)).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts p to the shares q; 0 for rows without any."""
    p = p / np.maximum(1, p.sum(axis=1, keepdims=True))
    m = (p + q) / 2

    def towards(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)

    return np.where(p.sum(axis=1) > 0, np.sqrt(np.clip((towards(p) + towards(np.broadcast_to(q, p.shape))) / 2, 0, 1)), 0.0)


def by_chance(q: np.ndarray, n: float) -> float:
    """The root of the mean Jensen-Shannon divergence between shares q and n draws from them, each count a Poisson variate."""
    total = 0.0
    for share in q[q > 0].tolist():
        mean = n * share
        x = np.arange(max(0, int(mean - 8 * np.sqrt(mean) - 10)), int(mean + 8 * np.sqrt(mean) + 10))
        log_p = x * np.log(mean) - mean - np.array([lgamma(k + 1) for k in x.tolist()])
        a = x / n
        m = (a + share) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(a > 0, a * np.log2(a / m), 0.0) + share * np.log2(share / m)
        total += float((np.exp(log_p) * part).sum()) / 2
    return float(np.sqrt(max(0.0, total)))


class Reference:
    """Shares of character classes and of common words in a language; the last word bin is all other words."""

    def __init__(self, classes: dict[int, int], words: dict[int, int], n: int, common: float):
        total = np.array([classes.get(k, 0) for k in range(CLASSES)], float)
        self.classes = total / max(1.0, total.sum())
        self.common = np.array(sorted(b for b, x in words.items() if x >= common * n * _UNIT), np.int64)
        own = np.array([words[b] for b in self.common.tolist()], float) / max(1, n * _UNIT)
        self.words = np.r_[own, max(0.0, 1 - own.sum())]
        self._lengths = 2.0 ** np.arange(5, 13.5, 0.5)
        self._chance = np.array([by_chance(self.words, x) for x in self._lengths])

    def chance(self, n: np.ndarray) -> np.ndarray:
        """The distance that n words drawn from this language have to it, about; it falls with the root of n in the end."""
        far = self._lengths[-1] / np.maximum(n, self._lengths[-1])
        return np.interp(np.log2(np.maximum(n, 1)), np.log2(self._lengths), self._chance) * np.sqrt(far)

    def word_counts(self, bins: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.common, bins), max(0, len(self.common) - 1))
        place = np.where(self.common[at] == bins, at, len(self.common)) if len(self.common) else np.zeros(len(bins), np.int64)
        width = len(self.words)
        return np.bincount(row * width + place, minlength=n * width).reshape(n, width)


def references(docs: DataFrame, words: int, common: float, languages: int, least: int) -> dict[str | None, Reference]:
    """The references of languages that at least `least` texts and one in `languages` of all are in; under None that of all texts. Each text of `words` words or more counts alike, whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            slots = CLASSES + BINS + 1
            key, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for block in blocks(batch.column("text")):
                own, n, row = code[block.lo : block.hi], block.counts, block.row_of_word()
                kinds = classes(block)
                share = kinds * _UNIT // np.maximum(1, kinds.sum(axis=1, keepdims=True))
                long = np.flatnonzero(n >= words)
                some = n[row] >= words
                pair, many = np.unique(row[some] * np.int64(BINS) + word_bins(block)[some], return_counts=True)
                of, bin_ = pair // BINS, pair % BINS
                key += [np.repeat(own[long] * slots, CLASSES) + np.tile(np.arange(CLASSES), len(long)), own[of] * slots + CLASSES + bin_, own[long] * slots + slots - 1]
                value += [share[long].ravel(), many * _UNIT // n[of], np.ones(len(long), np.int64)]
                if sum(map(len, key)) > 1 << 22:
                    key, value = _summed(key, value)
            key, value = _summed(key, value)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(key[0] // slots)), pa.array((key[0] % slots).astype(np.int32)), pa.array(value[0])], ["lang", "slot", "n"])

    # a null language is one of its own here; it has no reference but counts for that of all
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("lang"), "text")
    sums = rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    last = CLASSES + BINS
    sums = staged(sums, "shares")
    total = sums.filter(F.col("slot") == last).agg(F.sum("n")).first()[0] or 0
    enough = sums.filter((F.col("slot") == last) & (F.col("n") >= max(least, total / languages)) & (F.col("lang") != "")).select("lang", F.col("n").alias("texts"))
    # `languages` rows at most, and of each its classes and its common words: 1 / common at most
    own = sums.join(F.broadcast(enough), "lang").filter((F.col("slot") < CLASSES) | (F.col("n") >= common * F.col("texts") * _UNIT)).select("lang", "slot", "n")
    whole = sums.groupBy("slot").agg(F.sum("n").alias("n")).filter((F.col("slot") < CLASSES) | (F.col("n") >= common * total * _UNIT)).select(F.lit(None).cast("string").alias("lang"), "slot", "n")
    found: dict[str | None, dict[int, int]] = {None: {}}
    for r in own.union(whole).collect():
        found.setdefault(r.lang, {})[r.slot] = r.n
    size = {r.lang: r.n for r in sums.filter(F.col("slot") == last).join(F.broadcast(enough.select("lang")), "lang").collect()} | {None: total}
    discard(sums)
    parted = {k: ({s: n for s, n in v.items() if s < CLASSES}, {s - CLASSES: n for s, n in v.items() if CLASSES <= s < last}) for k, v in found.items()}
    return {k and k[1:]: Reference(*v, size[k], common) for k, v in parted.items()}


def _summed(key: list[np.ndarray], value: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    one, at = np.unique(np.concatenate(key), return_inverse=True)
    total = np.zeros(len(one), np.int64)
    np.add.at(total, at, np.concatenate(value))
    return [one], [total]


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(docs: DataFrame, words: int = 50, characters: int = 200, class_limit: float = 0.2, word_words: int = 60, word_limit: float = 0.12, noise: float = 2.0, common: float = 0.002, languages: int = 200, least: int = 30) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance), one row a row of docs.

    base_failed: fewer than `words` words, or over half of the words in repeated windows of three. Of the rest, a text is
    not kept if its classes of characters are farther than class_limit from its language's, where it has `characters` or
    more; or its common words farther than word_limit, where it has word_words words or more. As chance alone sets a short text
    apart from its language, noise / sqrt(n) is added to the former limit, n being its characters, and to the latter the
    distance that as many words drawn from the reference have to it. Distances that the guards rule out are null. References are learnt from all texts of `words` words or more; a language in fewer than `least` texts, or
    than one in `languages` of all, and a null one, is compared with all texts together.
    Null text: empty. Repeated rows are judged alike. Other columns are ignored; an empty table gives an empty one.
    """
    known = references(docs, words, common, languages, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                own, n = counts(block), block.hi - block.lo
                bad = (own["n_words"] < words) | (100 * own["n_repeat_words"] > 50 * own["n_words"])
                langs = np.array([x if x in known else None for x in batch.column("lang").slice(block.lo, n).to_pylist()], object)
                kinds, bins, row = classes(block), word_bins(block), block.row_of_word()
                far, apart, chance = np.zeros(n), np.zeros(n), np.zeros(n)
                for lang in set(langs.tolist()):
                    here = np.flatnonzero(langs == lang)
                    place = np.full(n, -1)
                    place[here] = np.arange(len(here))
                    mine = place[row] >= 0
                    far[here] = distance(kinds[here], known[lang].classes)
                    apart[here] = distance(known[lang].word_counts(bins[mine], place[row][mine], len(here)), known[lang].words)
                    chance[here] = known[lang].chance(own["n_words"][here])
                classed, worded = kinds.sum(axis=1) >= characters, own["n_words"] >= word_words
                rough = noise / np.sqrt(np.maximum(1, kinds.sum(axis=1)))
                kept = ~bad & ~(classed & (far > class_limit + rough)) & ~(worded & (apart > word_limit + chance))
                columns = [batch.column("doc_id").slice(block.lo, n), *(pa.array(v.astype(np.int64)) for v in own.values()), pa.array(bad), pa.array(kept), pa.array(far, mask=~classed), pa.array(apart, mask=~worded)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, _RESULT)
