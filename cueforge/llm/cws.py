"""Document fingerprints by consistent weighted sampling.

Every sample takes, of a document's words weighted by their counts, the one of least a = c / (y exp r), where r and c are
gamma variates and y a quantized weight, all derived from the word and the sample's number alone. Two documents agree in
a sample with the probability of their generalised Jaccard similarity, sum of least over sum of greatest counts. A
sample is kept as 16 bits of a hash of the word and its quantum.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged
from .words import blocks, mix

_CHUNK = 1 << 20


def _uniforms(h: np.ndarray) -> list[np.ndarray]:
    """Three numbers in (0, 1) from each hash."""
    return [(((h >> np.uint64(s)) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 21) for s in (0, 21, 42)]


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, distinct (word, count) pairs as word and count, rows of them as (row, pair))."""
    for block in blocks(column, _CHUNK):
        h, row = block.hashes(), block.row_of_word()
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)])
        count = np.diff(np.r_[new, len(h)])
        yield block.lo, block.hi, h[new], count, row[new]


def sample(column: pa.Array, samples: int) -> np.ndarray:
    """Signatures (rows x samples, 16 bits each); a text without words has all zeros."""
    out = np.zeros((len(column), samples), np.uint16)
    salts = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for lo, _, word, count, row in _terms(column):
        if not len(word):
            continue
        terms, at = np.unique(word, return_inverse=True)
        pairs, pair_of = np.unique(at * np.int64(1 << 32) + count, return_inverse=True)
        term, weight = pairs >> np.int64(32), (pairs & np.int64(0xFFFFFFFF)).astype(np.float32)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        several = np.flatnonzero(weight > 1)
        log_weight = np.log(weight[several])
        size = np.diff(np.r_[starts, len(row)])
        owner = np.repeat(np.arange(len(starts)), size)
        position = np.arange(len(row))
        for k in range(samples):
            h = mix(terms ^ salts[k])
            u1, u2, u3 = _uniforms(h)
            v1, v2, _ = _uniforms(mix(h + np.uint64(0x632BE59BD9B4E019)))
            r, log_c = -np.log(u1 * u2), np.log(-np.log(v1 * v2))
            quantum = np.zeros(len(pairs), np.float32)
            quantum[several] = np.floor(log_weight / r[term[several]] + u3[term[several]])
            log_a = log_c[term] - r[term] * (quantum - u3[term] + 1)
            value = log_a[pair_of]
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == least[owner])
            first = np.full(len(starts), len(row))
            np.minimum.at(first, owner[hit], position[hit])
            chosen = pair_of[first]
            code = mix(terms[term[chosen]] + quantum[chosen].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            out[lo + row[starts], k] = (code >> np.uint64(48)).astype(np.uint16)
    return out


def edited(texts: list[str], following: list[str]) -> list[str]:
    """Each text with the last half of its code points replaced by as many of the next text's first."""
    return [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGE = "part int, first_id long, first_text string, last_id long, last_text string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}


def _named(schema: str) -> tuple[list[str], list[pa.DataType]]:
    fields = [f.split() for f in schema.split(", ")]
    return [n for n, _ in fields], [_KINDS[k] for _, k in fields]


def _signed(texts: list[str], samples: int) -> np.ndarray:
    return sample(pa.array(texts, pa.large_string()), samples)


def _results(ids: list, texts: list[str], own: np.ndarray, following: list[str], after: np.ndarray) -> list[pa.Array]:
    """own, after: signatures of texts and of those that follow."""
    new = edited(texts, following)
    changed = _signed(new, own.shape[1])
    raw = lambda s: pa.array([x.tobytes() for x in s.astype(">u2")], pa.binary())
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()), raw(own), raw(changed), pa.array((own == changed).mean(axis=1)), pa.array((own == after).mean(axis=1))]


def fingerprint_documents(docs: DataFrame, samples: int = 64) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    fingerprint: hexadecimal, four digits a sample; its likeness to another is the share of equal samples. The next
    document is by ascending doc_id (nulls first; equal doc_ids by text), the first after the last; an only document
    follows itself. Null text: empty; texts without words have the fingerprint of zeros and are alike. Repeated rows are
    documents of their own. Other columns are ignored; an empty table gives an empty one.
    Texts are range-partitioned once, and each is sampled once as itself, which also serves the one before, and once edited.
    The last of a partition needs the first of the next one: these rows, one a partition, are finished in a second step.
    Which partition is next is found by numbers alone; the texts then meet in as many tasks as there are such rows.
    """
    names, kinds = _named(_RESULT + ", " + _EDGE)
    n = len(_named(_RESULT)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, texts = part.column("doc_id").to_pylist(), pc.fill_null(part.column("text"), "").to_pylist()
                signs = _signed(texts, samples)
                first = first or (ids[0], texts[0])
                if held:
                    ids, texts, signs = [held[0], *ids], [held[1], *texts], np.r_[held[2], signs]
                held = (ids[-1], texts[-1], signs[-1:])
                if len(ids) > 1:
                    done = _results(ids[:-1], texts[:-1], signs[:-1], texts[1:], signs[1:])
                    yield pa.RecordBatch.from_arrays([*done, *(pa.nulls(len(ids) - 1, k) for k in kinds[n:])], names)
        if held:
            edge = (TaskContext.get().partitionId(), *first, *held[:2])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:n]), *(pa.array([v], k) for v, k in zip(edge, kinds[n:], strict=True))], names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column("last_text").to_pylist(), batch.column("next_text").to_pylist()
            done = _results(batch.column("last_id").to_pylist(), texts, _signed(texts, samples), following, _signed(following, samples))
            yield pa.RecordBatch.from_arrays(done, names[:n])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = staged(texts.mapInArrow(run, _RESULT + ", " + _EDGE), "fingerprints")
    line = Window.orderBy("first_id", "part")
    follows = made.filter("part is not null").select("part", F.coalesce(F.lead("part").over(line), F.first("part").over(line)).alias("next"))
    firsts = made.filter("part is not null").select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    edges = made.filter("part is not null").select("part", "last_id", "last_text").join(follows, "part").join(firsts, "next")
    rest = edges.select("last_id", "last_text", "next_text").mapInArrow(finish, _RESULT)
    out = made.filter("part is null").select(*names[:n]).union(rest)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
