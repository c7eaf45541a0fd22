"""What the operators' parts compute, against plain Python; very long texts, single long words, empty tables and clashing columns in every operator and stage."""

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cueforge.llm import cws, mixing, packing, quality, queries, sharding, simhash, substring, token_counts, toxicity
from cueforge.llm.words import blocks


def test_regularised_leader():
    """FTRL-proximal by its definition, with dictionaries."""
    rng = random.Random(3)
    examples = [(np.array(sorted(rng.sample(range(15), 4)) + [16], np.int32), np.array([rng.random() for _ in range(4)] + [1.0], np.float32), int(rng.random() < 0.3)) for _ in range(60)]
    alpha, beta, l1, l2, passes = 0.3, 1.0, 0.02, 0.5, 2
    z, n, order = {}, {}, np.random.Generator(np.random.PCG64(5))
    share = sum(y for *_, y in examples) / len(examples)

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(passes):
        for e in order.permutation(len(examples)):
            index, x, y = examples[e]
            own = {int(i): weight(int(i)) for i in index}
            p = 1 / (1 + math.exp(-sum(own[int(i)] * float(v) for i, v in zip(index, x, strict=True))))
            for i, v in zip(index.tolist(), x.tolist(), strict=True):
                g = (p - y) * v * (0.5 / share if y else 0.5 / (1 - share))
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * own[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(quality.train(examples, 4, passes), [weight(i) for i in range(17)], atol=1e-5)


def explicit(word: str) -> dict:
    """A word's vector by its definition: every choice of four places, from the first on, over seven at most."""
    s, out = toxicity.coded(word), {}
    square = 0.0
    for at in combinations(range(len(s)), 4):
        if at[-1] - at[0] < 7 and all(s[i] for i in at):
            w = 0.5 ** (at[-1] - at[0] - 3)
            out[tuple(s[i] for i in at)] = out.get(tuple(s[i] for i in at), 0.0) + w
            square += w * w
    return {k: v / math.sqrt(square) for k, v in out.items()}


def test_string_kernel():
    """Vectors, kernels by landmarks, and decisions by table, against all subsequences; the machine's optimum by its gradient."""
    words = ["idiot", "i-d-i-o-t", "idxiot", "Idiots!", "pathetic", "the", "onhe", "réeuxê", "ohohohoh", "ab", "entrance"]
    own = toxicity.Sentences.of_words([toxicity.coded(w) for w in words])
    vectors = [explicit(w) for w in words]
    kernel = np.array([[sum(v * b.get(k, 0.0) for k, v in a.items()) for b in vectors] for a in vectors])
    codes, base, root = toxicity._landmarks(own, np.arange(len(words)))
    x = toxicity.features(own, codes, base, root, 4)
    assert np.allclose(x.astype(float) @ x.astype(float).T, kernel, atol=5e-3)
    assert kernel[0, 1] > 0.7 * kernel[0, 0] and kernel[0, 2] > 0.4 and kernel[0, 5] == 0
    y, weight = np.array([1, 1, 1, 1, -1, -1, -1, -1, -1, -1, -1]), np.linspace(1, 2, len(words))
    w = toxicity.squared_hinge([(x[y > 0], 1, weight[y > 0]), (x[y < 0], -1, weight[y < 0])], 0.1)
    a = np.c_[x.astype(float), np.ones(len(x))]
    slack = np.maximum(0, 1 - y * (a @ w))
    assert np.allclose(a.T @ (weight * y * slack), np.r_[w[:-1] * 0.1, w[-1] * 1e-6], atol=1e-4)
    table = np.zeros(toxicity._CODES, np.float32)
    table[codes] = base @ (root @ w[:-1])
    block = next(blocks(pa.array(["The onhe idiot. Entrance\nab i d i o t the"])))
    found = toxicity.Sentences(block)
    alpha = np.linalg.lstsq(kernel, toxicity.decisions(x, w) - w[-1], rcond=None)[0]
    score = lambda word: sum(c * sum(v * b.get(k, 0.0) for k, v in explicit(word).items()) for c, b in zip(alpha, vectors, strict=True))
    want = [max(map(score, s)) + w[-1] for s in (["the", "onhe", "idiot."], ["entrance"], ["ab", "idiot", "the"])]
    assert np.allclose(found.decisions(table, w[-1]), want, atol=5e-3)


def fewest(lengths: list[int], capacity: int) -> int:
    """Bins of an optimal packing, over all subsets."""
    best = {0: (0, 0)}  # subset -> (bins, fill of the last one)
    for s in range(1, 1 << len(lengths)):
        best[s] = min((b, f + x) if f and f + x <= capacity else (b + 1, x) for i, x in enumerate(lengths) if s >> i & 1 for b, f in (best[s ^ (1 << i)],))
    return best[(1 << len(lengths)) - 1][0]


def test_completion_beats_best_fit():
    rng, better, exact, fitting = random.Random(1), 0, 0, 0
    for _ in range(60):
        lengths = [rng.randint(15, 50) for _ in range(11)]
        counts = np.bincount(lengths, minlength=101)
        ours, fit, least = sum(t for _, t in packing.complete(counts, 100)), sum(t for _, t in packing.best_fit(counts, 100)), fewest(lengths, 100)
        assert packing.lower_bound(counts, 100) <= least <= ours <= fit
        better, exact, fitting = better + (ours < fit), exact + (ours == least), fitting + (fit == least)
    assert better and exact >= 59 > fitting


def test_completion_is_the_same_at_any_size():
    """Pieces that fill sequences of their own change nothing for the others, however many they are."""
    rng = random.Random(1)
    for _ in range(60):
        counts = np.bincount([rng.randint(15, 50) for _ in range(11)], minlength=101)
        alone = sum(t for _, t in packing.complete(counts, 100))
        for full in (300, 500, 100_000):
            more = counts.copy()
            more[100] = full
            assert sum(t for _, t in packing.complete(more, 100)) == alone + full


@pytest.fixture(scope="module")
def long_texts(spark):
    rng = random.Random(5)
    many = " ".join(f"w{rng.randrange(40_000)}" for _ in range(420_000))  # over 2 MiB
    rows = [(1, many), (2, "x" * 400_000), (3, None), (4, many[: len(many) // 2]), (5, "y" * 400_000 + " idiot")]
    return spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string"), [t or "" for _, t in rows]


def test_long_texts(long_texts):
    docs, texts = long_texts
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs)[0].collect()}
    half = len(texts[3].split())
    assert cut[1] == (420_000, 0) and cut[4][0] == half and cut[4][1] in (half - 1, half) and cut[3] == (0, 0)
    assert len({r.component_id for r in simhash.near_duplicates(docs, words=3, hashes=1, similarity=None).collect()}) == 5
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) == 5
    marks = {r.doc_id: r for r in cws.fingerprint_documents(docs).collect()}
    assert marks[1].n_chars == len(texts[0]) and marks[2].near_next == 0 and marks[1].near_edited > 0.2
    vocabulary = [("<unk>", -9.0), ("▁", -1.0), ("x", -1.0), ("xx", -1.5)]
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, vocabulary).collect()}[2] == 200_001
    rows = packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5} and max(r.length for r in rows) == 2048
    assert {r.topic for r in mixing.calibrate(docs, queries.TEMPERATURES, 0.8).collect()} == {"prose", "figures"}
    assert sorted(r.size for r in sharding.shard_documents(docs, shards=2).collect()) == sorted(len(t) + 8 for t in texts)
    weights = np.zeros((1 << 20) + 1, np.float32)
    weights[-1] = 1.0
    assert [round(r.score, 3) for r in quality.score(docs, weights).collect()] == [0.731] * 5
    assert toxicity.Model(np.zeros(1 << 20, np.float32), -1.0, np.zeros(4)).evidence(next(blocks(pa.array([texts[4]])))).tolist() == [[-1.0, 0.0, 0.0]]


@pytest.mark.parametrize("rows", [0, 7])
def test_stages_keep_columns(spark, tmp_path, rows):
    """Empty tables, and columns that have the names used inside, come through every stage of the pipeline."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc int, mark int, kept int, row int, topic int, tokens int, probability int, node int, root int"
    data = [(i if i < 6 else None, ["one two", None, "", "one two", "three four 5", "a@b c", "six"][i], "en", None, 3, *[i] * 9) for i in range(rows)]
    now = spark.createDataFrame(data, schema)
    spark.createDataFrame([(i, i % 2) for i in range(rows)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path))
        if i < 4:
            assert after.columns == now.columns, name
        else:
            assert after.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        after.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}") if i == 4 or rows and not spark.read.parquet(f"{tmp_path}/{i}").isEmpty() else spark.createDataFrame(data, schema)
    assert now.count() >= 0
