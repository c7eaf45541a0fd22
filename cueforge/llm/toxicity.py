"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks, trained on labelled sentences.

A word's vector holds its subsequences of four symbols, a mark for the word's start among them; each symbol skipped costs
a factor, a subsequence reaches over `_REACH` symbols at most, and the vector is scaled by the length of its weights. The
kernel of two words is the product of their vectors. Signs and digits take up room but match nothing, and single letters
in a row ("i d i o t") are one word. So an insult with letters or signs put in stays close to the plain one. A sentence is
as toxic as its most toxic word: the machine is a multiple-instance one. Labels are those of whole texts. All words of a
clean text's sentences are clean; a sentence of a toxic text is toxic by the words that toxic texts have far more often
than clean ones. The machine is linear in the landmarks' Nyström features, thus a weighted sum of kernels; as a
subsequence is a code of 20 bits, this sum is a table look-up for each subsequence. A text's score rests on its most toxic
sentence and on how many are toxic.
"""

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled_sample, one_task
from .words import Block, blocks

_REACH, _SKIP, _ORDER, _START = 7, 0.5, 4, 27
_OFFSETS = list(combinations(range(1, _REACH), _ORDER - 1))
_CODES = 1 << (5 * _ORDER)
_SENTENCE = 16  # words; a longer run without an end is so many sentences more
# letters of either case are 1 to 26; the last byte of another letter is one of four symbols; signs and digits are 0
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:192] = 28 + np.arange(64) % 4
_DROPPED = np.zeros(256, bool)  # what takes up no room: white space, and all but the last bytes of other letters
_DROPPED[[9, 10, 11, 12, 13, 32]] = _DROPPED[192:] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[[10, 13]] = True
_FULL_STOP = np.zeros(256, bool)
_FULL_STOP[[33, 46, 63]] = True


def coded(word: str) -> bytes:
    """A word's symbols, its start among them."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return bytes([_START, *_SYMBOL[raw[~_DROPPED[raw]]].tolist()])


class Sentences:
    """The words of a block as symbols: s, and where each word begins and ends in it; row of each sentence; sentence of each word."""

    def __init__(self, block: Block):
        keep = ~_DROPPED[block.data]
        at = np.r_[0, np.cumsum(keep)]
        first, row = at[block.starts], block.row_of_word()
        inner = _SYMBOL[block.data[keep]]
        single = at[block.ends] - first == 1
        single[single] = inner[first[single]] > 0
        lines = np.cumsum(_LINE_END[block.data])
        line = lines[block.starts] if len(first) else first
        stop = np.r_[True, _FULL_STOP[block.data[block.ends[:-1] - 1]]] if len(first) else np.zeros(0, bool)
        stop[1:] |= (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        run = np.flatnonzero(np.r_[True, (single[1:] != single[:-1]) | (row[1:] != row[:-1])][: len(single)])
        size = np.diff(np.r_[run, len(single)])
        joined = np.repeat(single[run] & (size >= 3), size)
        joined[run] = False
        first, row, stop = first[~joined], row[~joined], stop[~joined]
        place = np.arange(len(first))
        since = place - np.maximum.accumulate(np.where(stop, place, 0)) if len(first) else place
        stop |= since % _SENTENCE == 0
        self.s = np.insert(inner, first, _START)
        self.first = first + np.arange(len(first))
        self.ends = np.r_[self.first[1:], len(self.s)]
        self.sentence = np.cumsum(stop) - 1
        self.row = row[stop]

    @classmethod
    def of_words(cls, words: list[bytes]) -> "Sentences":
        """Each word, given as symbols, a sentence of its own."""
        out = object.__new__(cls)
        size = np.array([len(w) for w in words], np.int64)
        out.s, out.ends = np.frombuffer(b"".join(words), np.uint8).astype(np.int32), np.cumsum(size)
        out.first, out.sentence, out.row = out.ends - size, np.arange(len(size)), np.arange(len(size))
        return out

    def only(self, words: np.ndarray) -> "Sentences":
        """These words, each a sentence of its own."""
        return Sentences.of_words([self.s[a:b].astype(np.uint8).tobytes() for a, b in zip(self.first[words].tolist(), self.ends[words].tolist(), strict=True)])

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.float32]]:
        """(code, whether it is a subsequence of one word and free of signs, weight) by first symbol, for each pattern of skips."""
        left = np.repeat(self.ends, self.ends - self.first) - np.arange(len(self.s))  # symbols to the word's end
        for offsets in _OFFSETS:
            n = len(self.s) - offsets[-1]
            if n <= 0:
                continue
            code, ok = self.s[:n], (self.s[:n] > 0) & (left[:n] > offsets[-1])
            for o in offsets:
                code, ok = code * 32 + self.s[o : n + o], ok & (self.s[o : n + o] > 0)
            yield code, ok, np.float32(_SKIP ** (offsets[-1] - _ORDER + 1))

    def decisions(self, table: np.ndarray, bias: float) -> np.ndarray:
        """Of each sentence: that of its most toxic word."""
        if not len(self.first):
            return np.zeros(0)
        total, square = np.zeros(len(self.s), np.float32), np.zeros(len(self.s), np.float32)
        for code, ok, weight in self.parts():
            total[: len(code)] += table[code * ok] * ok * weight
            square[: len(code)] += ok * (weight * weight)
        word = np.add.reduceat(total, self.first, dtype=np.float64) / np.sqrt(np.maximum(np.add.reduceat(square, self.first, dtype=np.float64), 1e-9))
        return np.maximum.reduceat(word, np.flatnonzero(np.r_[True, self.sentence[1:] != self.sentence[:-1]])) + bias

    def vectors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, code, weight), words ascending: the words' vectors."""
        owner = np.repeat(np.arange(len(self.first)), self.ends - self.first)
        words, codes, weights = [], [], []
        for code, ok, weight in self.parts():
            hit = np.flatnonzero(ok)
            words.append(owner[hit])
            codes.append(code[hit])
            weights.append(np.full(len(hit), weight, np.float32))
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
        word, code, weight = np.concatenate(words), np.concatenate(codes), np.concatenate(weights)
        weight = (weight / np.sqrt(np.bincount(word, weight * weight, len(self.first)))[word]).astype(np.float32)
        order = np.lexsort((code, word))
        word, code, weight = word[order], code[order], weight[order]
        new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (code[1:] != code[:-1])][: len(code)])
        return word[new], code[new], np.add.reduceat(weight, new) if len(new) else weight


def _landmarks(words: Sentences, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, base: codes x landmarks, root of the landmarks' own kernel, which whitens features)."""
    owner, code, weight = words.only(chosen).vectors()
    codes = np.unique(code)
    base = np.zeros((len(codes), len(chosen)), np.float32)
    base[np.searchsorted(codes, code), owner] = weight
    value, vector = np.linalg.eigh((base.T @ base).astype(np.float64))
    return codes, base, (vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])).astype(np.float32)


def features(words: Sentences, codes: np.ndarray, base: np.ndarray, root: np.ndarray, chunk: int = 5_000) -> np.ndarray:
    """Nyström features of words: their kernels with the landmarks, whitened. Kept in half precision, as there are as many rows as distinct words."""
    column = np.full(_CODES, -1, np.int32)
    column[codes] = np.arange(len(codes))
    out = np.zeros((len(words.first), root.shape[1]), np.float16)
    for lo in range(0, len(words.first), chunk):
        owner, code, weight = words.only(np.arange(lo, min(lo + chunk, len(words.first)))).vectors()
        at = column[code]
        owner, at, weight = owner[at >= 0], at[at >= 0], weight[at >= 0]
        kernel = np.zeros((chunk, base.shape[1]), np.float32)
        for i in range(0, len(at), 50_000):
            own = owner[i : i + 50_000]
            new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            kernel[own[new]] += np.add.reduceat(base[at[i : i + 50_000]] * weight[i : i + 50_000, None], new, axis=0)
        out[lo : lo + chunk] = kernel[: len(out) - lo] @ root
    return out


def decisions(x: np.ndarray, w: np.ndarray, chunk: int = 5_000) -> np.ndarray:
    return np.concatenate([x[i : i + chunk].astype(np.float64) @ w[:-1] for i in range(0, len(x), chunk)] or [np.zeros(0)]) + w[-1]


def squared_hinge(parts: list[tuple[np.ndarray, int, np.ndarray]], penalty: float, chunk: int = 5_000) -> np.ndarray:
    """A linear machine with squared hinge loss over parts of (rows, their class 1 or -1, their weights), by Newton steps; the last weight is the bias."""
    w = np.zeros(parts[0][0].shape[1] + 1)
    ridge = np.eye(len(w)) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(len(w))
        for x, y, weight in parts:
            for i in range(0, len(x), chunk):
                a = np.c_[x[i : i + chunk].astype(np.float64), np.ones(len(x[i : i + chunk]))]
                inside = (y * (a @ w) < 1) & (weight[i : i + chunk] > 0)
                a = a[inside]
                b = a.T * weight[i : i + chunk][inside]
                left += b @ a
                right += y * b.sum(axis=1)
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


class Model:
    """table: decision of each subsequence code; bias; calibration of (evidence, 1)."""

    def __init__(self, table: np.ndarray, bias: float, calibration: np.ndarray):
        self.table, self.bias, self.calibration = table, bias, calibration

    def evidence(self, block: Block) -> np.ndarray:
        """For each row: the greatest decision over its sentences (no less than -1, no more than 2), the log of how many are above 0, and that of their number in a hundred."""
        n = block.hi - block.lo
        found = Sentences(block)
        d = found.decisions(self.table, self.bias)
        most = np.full(n, -1.0)
        np.maximum.at(most, found.row, np.minimum(d, 2.0))
        above = np.bincount(found.row, d > 0, n)
        return np.c_[most, np.log1p(above), np.log1p(100 * above / np.maximum(1, np.bincount(found.row, minlength=n)))]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[evidence, np.ones(len(evidence))] @ self.calibration, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
    return w


def distinct_words(found: list[Sentences]) -> tuple[Sentences, np.ndarray]:
    """The distinct words, and which of them each word is."""
    known: dict[bytes, int] = {}
    which = []
    for f in found:
        raw = f.s.astype(np.uint8).tobytes()
        which += [known.setdefault(raw[a:b], len(known)) for a, b in zip(f.first.tolist(), f.ends.tolist(), strict=True)]
    return Sentences.of_words(list(known)), np.array(which, np.int64)


_LETTERS = re.compile(r"[^\W\d_]{3,}")


def associated(texts: list[str], labels: np.ndarray) -> set[str]:
    """Words that toxic texts have far more often than clean ones, by themselves or by their beginnings."""
    # a word counts once for each pair of neighbours that it stands between, so copies of a text add nothing
    places: dict[int, set[tuple[str, ...]]] = {0: set(), 1: set()}
    for text, y in zip(texts, labels.tolist(), strict=True):
        words = ["", *(w.lower() for w in _LETTERS.findall(text or "")), ""]
        places[y].update(zip(words, words[1:], words[2:], strict=False))
    counts = []
    for y in (0, 1):
        whole, keys = Counter(w for _, w, _ in places[y]), Counter()
        for w, k in whole.items():
            for key in {w + "$", *(w[:n] for n in range(4, 9))}:
                keys[key] += k
        counts.append((whole, keys))
    (_, clean), (words, toxic) = counts
    n1, n0 = max(1, len(places[1])), max(1, len(places[0]))
    lift = {k: np.log((n / n1) / ((clean[k] + 0.5) / n0)) for k, n in toxic.items() if n >= 5}
    strong = {k for k, v in lift.items() if v > 2.5 and v * np.sqrt(toxic[k]) > 9}
    return {w for w in words if strong & {w + "$", *(w[:n] for n in range(4, 9))}}


def learn(texts: list[str | None], labels: list[int], landmarks: int = 480, turns: int = 2, penalty: float = 0.1, share: float = 0.015) -> Model:
    """A model from labelled texts, by their sentences; equal texts count once.

    Every word of a clean text's sentence is a clean example. A sentence of a toxic text that holds an associated word is
    toxic and stands by that word, its witness; the text's other sentences are of unknown kind and left out. Witnesses come
    with letters put apart by signs and with a letter put in, as readers still know them. In the second turn the clean words
    that look most toxic are among the landmarks. share: the weight of toxic examples, of that of clean ones.
    """
    seen = dict(zip(texts, labels, strict=True))
    texts, labels = list(seen), np.array(list(seen.values()), np.int64)
    none = Model(np.zeros(_CODES, np.float32), -1.0, np.array([0.0, 0.0, 0.0, np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 2))]))
    marked = {coded(w) for w in associated(texts, labels)}
    if not marked or labels.all():
        return none
    parsed = [(block.lo, Sentences(block)) for block in blocks(pa.array(texts, pa.large_string()))]
    text = np.concatenate([f.row[f.sentence] + lo for lo, f in parsed])
    words, which = distinct_words([f for _, f in parsed])
    n = len(words.first)
    raw = words.s.astype(np.uint8).tobytes()
    spelt = [raw[a:b] for a, b in zip(words.first.tolist(), words.ends.tolist(), strict=True)]
    witness = np.array([w.replace(b"\0", b"") in marked for w in spelt])

    def texts_with(rows: np.ndarray) -> np.ndarray:
        return np.bincount(np.unique(text[rows] * np.int64(n) + which[rows]) % n, minlength=n)

    bad = labels[text] == 1
    clean, toxic = texts_with(~bad), texts_with(bad & witness[which])
    if not toxic.any():
        return none
    often = np.argsort(-toxic, kind="stable")
    made = [v for i in often[toxic[often] > 0].tolist() for w in (spelt[i],) for v in (w[:1] + b"\0".join(bytes([c]) for c in w[1:]), *(w[:j] + bytes([24]) + w[j:] for j in range(3, len(w) - 1)))]
    spread = Sentences.of_words(made)
    held, near, good = words.only(np.flatnonzero(toxic)), np.zeros(n), (clean > 0).astype(float)
    for _ in range(turns):
        top = often[: landmarks // 2][toxic[often[: landmarks // 2]] > 0]
        common = np.setdiff1d(np.argsort(-clean, kind="stable")[: landmarks // 4], top)
        alike = np.setdiff1d(np.argsort(-near, kind="stable")[: landmarks // 4], np.r_[top, common])
        codes, base, root = _landmarks(words, np.r_[top, common, alike])
        x = features(words, codes, base, root)
        bad_x = np.concatenate([features(held, codes, base, root), features(spread, codes, base, root)])
        weight = np.r_[np.sqrt(toxic[toxic > 0]), np.ones(len(made))]
        w = squared_hinge([(bad_x, 1, weight * (share * good.sum() / weight.sum())), (x, -1, good)], penalty)
        near = np.where((toxic > 0) | (clean == 0), 0, decisions(x, w) + 2)
    table = np.zeros(_CODES, np.float32)
    table[codes] = base @ (root @ w[:-1])
    model = Model(table, float(w[-1]), np.zeros(4))
    evidence = np.concatenate([model.evidence(b) for b in blocks(pa.array(texts, pa.large_string()))])
    model.calibration = _logistic(evidence, labels.astype(float))
    return model


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, toxic: int = 1000, clean: int = 3000) -> DataFrame:
    """docs(doc_id, text, ...) and labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), one row a row of docs.

    The model is learnt, in one task, from at most `toxic` + `clean` labelled rows whose crc32(doc_id as text) mod `folds`
    is not `held`; of these rows all sentences are examples. A null doc_id is held out; null labels and labels other than
    0 and 1 are not learnt from; without a toxic example every score is low. Null, empty and blank texts have no evidence
    and get the score of that. Repeated rows are scored alike; extra columns with clashing names are ignored; an empty
    table gives an empty one.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(True))

    def fit(rows: pa.Table) -> list[np.ndarray]:
        model = learn(rows["text"].to_pylist(), rows["label"].to_pylist())
        return [model.table, np.array([model.bias]), model.calibration]

    table, bias, calibration = one_task(labelled_sample(docs, labels, "toxic", ~fold, {1: toxic, 0: clean}), fit)
    codes = np.flatnonzero(table)
    values = table[codes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(_CODES, np.float32)
        full[codes] = values
        own = Model(full, float(bias[0]), calibration)
        for batch in batches:
            found = [own.score(own.evidence(b)) for b in blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
