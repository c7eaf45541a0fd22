"""Values over partition edges, repeated ids in labelled samples, long texts scored with real weights."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueforge.llm import cws, posting_lists, quality
from cueforge.llm.words import blocks


def alone(text, samples):
    """One text's samples in plain Python: of its words, each with its count, the one of least a."""
    words = Counter(text.encode().split())
    hashed = {w: next(blocks(pa.array([w.decode()]))).hashes()[0] for w in words}
    salts = cws.mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = []
    for salt in salts:
        best = None
        for w in sorted(words, key=lambda w: int(hashed[w])):
            h = cws.mix(np.array([hashed[w] ^ salt]))
            (u1, u2, u3), (v1, v2, _) = cws._uniforms(h), cws._uniforms(cws.mix(h + np.uint64(0x632BE59BD9B4E019)))
            r, log_c = -np.log(u1 * u2), np.log(-np.log(v1 * v2))
            quantum = np.floor(np.log(np.array([words[w]], np.float32)) / r + u3) if words[w] > 1 else np.zeros(1, np.float32)
            a = (log_c - r * (quantum - u3 + 1))[0]
            if best is None or a < best[0]:
                best = a, cws.mix(np.array([hashed[w]]) + quantum.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0]
        out.append(int(best[1] >> np.uint64(48)) if best else 0)
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_fingerprints_over_edges(spark, partitions):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(40)]
    rows = [(i // 2 if i % 5 == 0 else i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 25]))) or rng.choice([None, "", " "])) for i in range(40)]
    rows += [rows[3], rows[3], (None, "null id a b"), (None, None), (None, "null id a b")]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in ordered]
    signed = {t: alone(t, 16) for t in texts}
    want = Counter()
    for i, ((doc, _), t) in enumerate(zip(ordered, texts, strict=True)):
        following = texts[(i + 1) % len(texts)]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, changed, after = signed[t], alone(new, 16), signed[following]
        like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 16
        code = lambda s: "".join(f"{x:04x}" for x in s)
        want[doc, len(t), hashlib.sha256(new.encode()).hexdigest(), code(own), code(changed), like(own, changed), like(own, after)] += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3)
        got = Counter(tuple(r) for r in cws.fingerprint_documents(df, samples=16).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_labelled_samples_are_bounded(spark):
    docs = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(8, None), (9, "b")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0), (9, 1), (10, 1)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", F.lit(True), {0: 10, 1: 10}).collect()
    assert sorted(map(tuple, rows), key=repr) == [(7, "text 0", 1), (8, None, 0), (9, "b", 0), (9, "b", 1)]


def test_long_texts_are_scored_whole(spark):
    """What a text of half a million words gets is the mean weight of all its n-grams, to the last."""
    rng = random.Random(2)
    good, bad = [f"good{i}" for i in range(50)], [f"BAD!!{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    weights = quality.fit(docs, labels, F.lit(True))
    assert np.count_nonzero(weights) > 50
    texts = [" ".join(rng.choices(good, k=250_000)) + " " + " ".join(rng.choices(bad, k=250_000)), rows[0][1], rows[1][1], "", None]
    scored = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights)
    got = {r.doc_id: r.score for r in scored.collect()}
    for i, t in enumerate(texts):
        words, z = (t or "").split(), 0.0
        if words:
            index = quality.features(next(blocks(pa.array([t]), 1 << 30)), 20)[1]
            assert len(index) == 2 * (2 * len(words) - 1)
            z = 20 * sum(weights[index].astype(float).tolist()) / len(index)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(z + float(weights[-1])))), rel=1e-6)
    assert got[1] < 0.5 < got[2] and 0.02 < got[0] < 0.98


def test_lists_are_chosen_where_there_is_structure(spark):
    """Clustered vectors: the graph and the ratio leave most lists unread, and the recall against brute force holds."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16)) * 4
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    graphs, real = [], posting_lists.lists_needed

    def needed(graph, *rest):
        graphs.append((len(graph.c), real(graph, *rest)))
        return graphs[-1][1]

    posting_lists.lists_needed = needed
    try:
        got = posting_lists.search(df, list_size=32).collect()
    finally:
        posting_lists.lists_needed = real
    lists, need = graphs[0]
    assert 4 * need < lists  # so the graph is what finds them
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 600
