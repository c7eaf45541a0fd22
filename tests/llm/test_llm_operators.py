"""Each operator against brute force over a table with nulls, empty and long texts, ties, repeated rows and clashing columns; and over an empty one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from cueforge.llm import components, cws, mixing, packing, posting_lists, quality, queries, sharding, simhash, substring, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, node int, link string, size string, rank string"


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(120)
    texts = [text(rng.randint(1, 160)) for _ in range(30)]
    texts += [text(20) + " " + passage + "\n" + text(15) for _ in range(4)] + [base] * 4
    texts += [base.rsplit(" ", 1)[0] + " " + rng.choice(words) for _ in range(6)]
    texts += [None, None, "", "", "  \t\n ", "one", "One", "one two", text(9000), passage, " ".join(["again"] * 130), "i d i o t"]
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], "en", "a"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), "x", 1, "y", "z", "w") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def parts(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, none):
    out, cut = substring.remove_repeats(docs)
    least = {}
    for d, t, *_ in corpus():
        w = parts(t)
        for i in range(len(w) - 49):
            if d is not None:
                least[tuple(w[i : i + 50])] = min(d, least.get(tuple(w[i : i + 50]), d))
    want = []
    for d, t, *_ in corpus():
        w = parts(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and least[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        want.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r.n_removed for r in cut.collect()) > 500
    doubled, _ = substring.remove_repeats(docs, window=48, start=12)  # two doublings
    assert doubled.agg({"n_removed": "sum"}).first()[0] >= sum(w[2] for w in want)
    assert substring.remove_repeats(none)[0].count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(docs, window=50, start=20)


def test_words_of_equal_sums_are_not_equal(spark):
    """Two long words in letters of Thue-Morse order and its complement, which sums in powers of any odd base modulo 2**64 take for one; also as windows of words in these orders."""
    order = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[x ^ k] for x in order) for k in (0, 1))
    shared = " ".join(f"w{i}" for i in range(49))
    rows = [(1, shared + " " + one), (2, shared + " " + two), (3, " ".join("ab"[x] for x in order)), (4, " ".join("ba"[x] for x in order))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, t in rows:
        w = t.split()
        windows = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        earlier = {tuple(v[i : i + 50]) for e, u in rows for v in [u.split()] if e < d for i in range(len(v) - 49)}
        gone = {j for i in range(len(w) - 49) if tuple(w[i : i + 50]) in earlier for j in range(i, i + 50)}
        want[d] = (len(w), len(gone))
        assert d != 2 or windows.isdisjoint(earlier)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs)[0].collect()}
    assert got == want and got[2] == (50, 0)
    pair = spark.createDataFrame([(1, one + " x"), (2, two + " x")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(pair).collect()} == {1, 2}


def root_of(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_simhash(docs, none):
    rows = corpus()
    prints = []
    for _, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots, least = root_of(len(rows), pairs), {}
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            least[r] = min(rows[i][0], least.get(r, rows[i][0]))
    got = simhash.near_duplicates(docs, words=3, hashes=1, max_bits=2, similarity=None).collect()
    want = [(rows[i][0], prints[i], least.get(r)) for i, r in enumerate(roots)]
    assert sorted(((r.doc_id, r.fp[0] % 2**64, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_near_duplicates_are_verified(spark):
    """Texts that differ in the words of one to three places, brute force at 0.8 over five-word shingles."""
    rng = random.Random(12)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for k in range(4):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(120)] = f"x{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(w), g))
    rows += [(None, None, 0), (None, "", 0), (900, None, 0), (901, "one", 0), (902, "ONE", 0), (0, rows[0][1], 1)]
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots, least = root_of(len(rows), pairs), {}
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            least[r] = min(rows[i][0], least.get(r, rows[i][0]))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, a int"))
    want = sorted(((rows[i][0], least.get(r)) for i, r in enumerate(roots)), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == want


def near_groups(texts):
    """The least place of each text's group, brute force at 0.8 over five-word shingles."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    roots = root_of(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    return [least[r] for r in roots]


def found_groups(spark, texts):
    got = simhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    return [r.component_id for r in got.orderBy("doc_id").collect()]


def test_near_duplicates_at_the_limit(spark):
    """Pairs of 0.80 to 0.83: each is found."""
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        base = [f"w{rng.randrange(90000)}" for _ in range(204)]
        w = list(base)
        for i in rng.sample(range(5, 196, 10), rng.choice((4, 4, 3))):
            w[i] = f"x{rng.randrange(90000)}"
        for i in rng.sample(range(200, 204), 1):
            w[i] = "tail"
        texts += [" ".join(base), " ".join(w)]
    want = near_groups(texts)
    assert len(set(want)) < 250 and found_groups(spark, texts) == want


def test_near_duplicates_in_a_family(spark):
    """Texts of one template, less than similar among each other, with a similar pair each: a rejected link to a hub hides none."""
    rng = random.Random(8)
    template, texts = [f"t{i}" for i in range(400)], []
    for g in range(120):
        base, at = list(template), rng.sample(range(5, 396, 6), 14)
        for i in at[:7]:
            base[i] = f"a{g}.{i}"
        other = list(base)
        for i in at[7:]:
            other[i] = f"b{g}.{i}"
        texts += [" ".join(base), " ".join(other)]
    want = near_groups(texts)
    assert len(set(want)) == 120 and found_groups(spark, texts) == want


def test_near_duplicates_list_by_list(spark, monkeypatch):
    """Groups too large for one task."""
    monkeypatch.setattr(simhash.similar, "__defaults__", ((0, 0),))
    rng = random.Random(9)
    template, texts = [f"t{i}" for i in range(150)], []
    for g in range(40):
        w = list(template)
        for i in rng.sample(range(5, 146, 6), rng.randint(1, 6)):
            w[i] = f"a{g % 13}.{i}"
        texts.append(" ".join(w))
    assert found_groups(spark, texts) == near_groups(texts)


@pytest.mark.parametrize("limit", [0.3, 0.6, 0.8, 1.0])
def test_set_forest(limit):
    rng = np.random.default_rng(6)
    sets = [rng.choice(14, rng.integers(0, 12), replace=False) + 100 * rng.integers(0, 2) for _ in range(70)]
    flat, offs = np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])]
    own = [set(x.tolist()) for x in sets]
    want = root_of(70, [(i, j) for i in range(70) for j in range(i) if own[i] & own[j] and len(own[i] & own[j]) >= limit * len(own[i] | own[j]) - 1e-9])
    edges = simhash.set_forest(flat, offs, limit)
    got = root_of(70, edges.tolist())
    assert len({*zip(want, got, strict=True)}) == len(set(want)) == len(set(got)) and len(edges) == 70 - len(set(want))


def test_near_duplicates_of_repeated_shingles(spark):
    """Lines repeated 2 and 20 times over equal words are one set; a line repeated 50 times makes no likeness of different words."""
    own = lambda p: " ".join(f"{p}{i}" for i in range(300))
    line = " ".join(f"line{i}" for i in range(20))
    texts = [own("a") + f" {line}" * 2, own("a") + f" {line}" * 20, own("b") + f" {line}" * 50, own("c") + f" {line}" * 50]
    assert near_groups(texts) == [0, 0, 2, 3] and found_groups(spark, texts) == [0, 0, 2, 3]


def same_parts(n, pairs, edges):
    want, got = root_of(n, pairs), root_of(n, edges)
    return len({*zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (101, 100)]
    out = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in out.collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("long", [2, 10_000])
def test_byte_positions(spark, long):
    """Fingerprints of a few bits' difference in hot lists, by brute force; with lists keyed anew and without."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fp = np.unique(np.array([int(base[i % 6]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for i in range(240)], np.uint64))
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2]
    assert same_parts(len(fp), pairs, simhash.tallied(fp.reshape(-1, 1), 2).tolist())
    place = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    rows = spark.createDataFrame([(x, [x]) for x in place], "node long, fp array<long>")
    assert same_parts(len(fp), pairs, [(place[r.a], place[r.b]) for r in simhash.links(rows, 1, 2, long).collect()])


@pytest.mark.parametrize("positions,differing", [(8, 2), (8, 3), (16, 5), (8, 0), (8, 7)])
def test_byte_keys(positions, differing):
    """Whichever positions differ, a key is whole; and with it a finer one."""
    from itertools import combinations

    for gone in combinations(range(positions), differing):
        whole = [k for k in simhash.byte_keys(positions, differing) if not set(k) & set(gone)]
        assert whole and all(any(not set(x) & set(gone) for x in simhash.finer_keys(positions, differing, k)) for k in whole)


def test_posting_lists(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8)) + rng.integers(0, 6, (1500, 1))
    rows = [(i, [float(v) for v in r], "l") for i, r in enumerate(x)] + [(5000 + i, [0.5] * 8, "l") for i in range(300)]
    bad = [(9000, None, ""), (9100, [0.0] * 8, ""), (9200, [1.0, None] * 4, ""), (9300, [float("nan")] * 8, ""), (9400, [1.0], ""), (None, [1.0] * 8, ""), (9500, [float("inf")] * 8, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, list string")
    got = defaultdict(list)
    for r in posting_lists.search(df, list_size=32).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = 0
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    for q, found in got.items():
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(axis=1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and found == sorted(found, key=lambda f: (f[2], f[1]))
        assert all(abs(s - d[ids == i][0]) < 1e-12 for _, i, s in found)
        hits += len({f[1] for f in found} & set(best))
    assert hits / (10 * len(got)) >= 0.9
    # of 300 equal vectors the ids next to a query's own are all found, though 11 of them are indexed
    assert [i for _, i, _ in got[5000]] == list(range(5001, 5011)) and [i for _, i, _ in got[5200]] == list(range(5000, 5010))
    few = posting_lists.search(df.filter("vec_id in (0, 1, 2)"))
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]
    assert posting_lists.search(df.filter("vec_id < 0")).count() == 0


def test_posting_lists_recall_without_structure(spark):
    """More lists than the beam, unit vectors without structure: the number read follows from brute force."""
    x = np.random.default_rng(5).normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = posting_lists.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), list_size=16).collect()
    found, hits = defaultdict(set), 0
    for r in got:
        found[r.query_id].add(r.vec_id)
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        hits += len(found[q] & {int(j) for j in np.argsort(d)[1:11]})
    assert hits / 600 >= 0.98


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(24)]
    assert sum(sizes) == len(corpus()) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in corpus())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard_documents(none).count() == 0


def test_sharding_keeps_groups(spark):
    """The cut of the dealt start against that of the result, counted by hand."""
    df = spark.createDataFrame([(i, f"text {i % 300}" if i < 900 else f"own {i}") for i in range(4000)], "doc_id long, text string")

    def cut(members):
        return sum(sum(c.values()) - max(c.values()) for c in members.values())

    at, shards = defaultdict(Counter), defaultdict(set)
    for r in sharding.shard_documents(df).collect():
        at[r.text_crc32][r.shard] += 1
        shards[r.text_crc32].add(r.shard)
    dealt = spark.createDataFrame([(i % 300, i * 7919 % 24) for i in range(900)], "link long, shard int")
    start = defaultdict(Counter)
    for r in dealt.collect():
        start[r.link][r.shard] += 1
    assert sharding.apart(dealt) == cut(start) and cut(at) < cut(start) / 10
    assert sum(len(s) > 1 for s in shards.values()) < 15


def test_sharding_of_one_large_group(spark):
    """A text of a third of all rows is parted, and counts stay even."""
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"own {i // 2}") for i in range(6000)], "doc_id long, text string")
    rows = sharding.shard_documents(df).collect()
    sizes = Counter(r.shard for r in rows)
    hot = Counter(r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same"))
    assert len(rows) == 6000 and max(sizes.values()) - min(sizes.values()) <= 1 and len(hot) <= 14


def test_fingerprints(docs, none):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    got = cws.fingerprint_documents(docs).collect()
    want = Counter()
    for i, (r, t) in enumerate(zip(rows, texts, strict=True)):
        n = texts[(i + 1) % len(texts)]
        want[(r[0], len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert cws.fingerprint_documents(none).count() == 0


def test_fingerprint_likeness():
    rng = random.Random(3)
    import pyarrow as pa

    for _ in range(3):
        a, b = Counter(rng.choices("abcdefghij", k=30)), Counter(rng.choices("abcdefgklm", k=40))
        s = cws.sample(pa.array([" ".join(a.elements()), " ".join(b.elements()), " ".join(a.elements())]), 3000)
        assert (s[0] == s[2]).all()
        assert abs((s[0] == s[1]).mean() - sum((a & b).values()) / sum((a | b).values())) < 0.04


def unigram(vocabulary, **options):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    model = Tokenizer(models.Unigram(vocabulary, unk_id=0, **options))
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[ \t\n\x0b\x0c\r]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    return model


def test_token_counts(docs, none):
    vocabulary = [("<unk>", 0.0)] + [(p, -float(i % 4)) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "cd", "de", "bcd"])]
    model = unigram(vocabulary, byte_fallback=False)
    want = Counter((d, len(parts(t)), len(model.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in corpus())
    assert Counter(map(tuple, token_counts.count_tokens(docs, vocabulary).collect())) == want
    assert token_counts.count_tokens(none, vocabulary).count() == 0


def test_token_counts_of_the_query(spark):
    """The query's vocabulary, whose other characters fall back to bytes, against the tokenizer library; a word of 300,000 letters among the texts."""
    pieces, bytewise = token_counts.vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))
    least = min(s for _, s in pieces)
    model = unigram([("<unk>", least), *pieces, *((f"<0x{b:02X}>", least) for b in range(256))], byte_fallback=True)
    texts = [t for _, t, *_ in corpus()] + ["naïve 漢字 𝔘𝔫𝔦 \U0001f600\U0001f601x", "a" * 300_000, "𝔘" * 9, "Ünïcödé"]
    assert bytewise and len(pieces) > 31_000
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces, bytewise)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    want = Counter()
    for d, t, *_ in corpus():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((d, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("low,high,n", [(1, 12, 30), (5, 20, 60), (3, 9, 25), (20, 20, 5)])
def test_completion(low, high, n):
    rng = np.random.default_rng(low)
    counts = np.bincount(rng.integers(low, high + 1, n), minlength=21)
    plan = packing.complete(counts, 20)
    used = np.zeros(21, np.int64)
    for filling, times in plan:
        assert sum(x * k for x, k in filling) <= 20
        for x, k in filling:
            used[x] += k * times
    assert (used == counts).all()
    assert packing.lower_bound(counts, 20) <= sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(counts, 20))


def test_mixing(docs, none):
    rows = mixing.calibrate(docs, queries.TEMPERATURES, queries.KEEP)
    got = sorted(((r.row["doc_id"], r.topic, r.tokens, round(r.probability, 6), r.kept) for r in rows.collect()), key=repr)
    import pandas as pd

    db = duckdb.connect()
    frame = pd.DataFrame([(*r[:4],) for r in corpus()], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    db.register("documents", frame)
    assert got == sorted(db.execute(mixing.oracle_sql(queries.TEMPERATURES, queries.KEEP)).fetchall(), key=repr)
    assert mixing.calibrate(none, queries.TEMPERATURES, queries.KEEP).count() == 0
    assert rows.select("row.*").columns == docs.columns
    clash = docs.withColumnsRenamed({"mark": "topic", "node": "kept", "link": "probability", "size": "row", "rank": "tokens"})
    assert mixing.calibrate(clash, queries.TEMPERATURES, queries.KEEP).filter("kept").select("row.*").columns == clash.columns


def test_raking_reaches_margins(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(s, la, t, rng.randint(50, 90) * (9 if s == "a" else 1)) for s in "abc" for la in "xy" for t in "pq"], "source string, lang string, topic string, tokens long")
    keep, powers = 0.6, {"source": 0.3, "lang": 0.0, "topic": 1.0}
    out = mixing.rake(cells, powers, keep).toPandas()
    assert (out.weight <= out.tokens + 1e-9).all() and abs(out.weight.sum() - keep * out.tokens.sum()) < 1e-3 * out.tokens.sum()
    for d, power in powers.items():
        # by hand: shares to the power, what a margin lacks handed to the others until all fit
        have = out.groupby(d).tokens.sum()
        want = (have / have.sum()) ** power
        capped = have * 0 > 1
        while True:
            share = (have / have.sum() / keep).where(capped, want * (1 - (have[capped].sum() / have.sum() / keep)) / want[~capped].sum())
            over = share > have / have.sum() / keep + 1e-12
            if not over.any():
                break
            capped |= over
        assert np.allclose(out.groupby(d)[f"to_{d}"].first(), share * keep * have.sum())
        assert np.allclose(out.groupby(d).weight.sum() / out.weight.sum(), share, atol=2e-3)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, marks = [], []
    for i in range(700):
        w = rng.choices(words, k=rng.randint(20, 80))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron", "loser"]))
        rows.append((i, " ".join(w), "en"))
        marks.append((i, int(not bad), int(toxic)))
    extra = [(10_000, None, None), (10_001, "", None), (None, "the on", None), (3, rows[3][1], None)]
    labels = [(5, None, None), (None, 1, 1), (6, 7, 7)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, label string"), spark.createDataFrame(marks + labels, "doc_id long, quality int, toxic int"), marks


def test_quality(labelled, none):
    docs, labels, marks = labelled
    rows = quality.classify(docs, labels).collect()
    truth = {i: q for i, q, _ in marks}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 704 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert quality.classify(none, labels.limit(0)).count() == 0


def test_toxicity(labelled, none):
    docs, labels, marks = labelled
    rows = toxicity.classify(docs, labels).collect()
    truth = {i: t for i, _, t in marks}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 704 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert toxicity.classify(none, labels.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    path = str(tmp_path)
    docs.drop("mark", "node", "link", "size", "rank").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1) for d, *_ in corpus() if d is not None][:20], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    columns = spark.read.parquet(f"{path}/documents.parquet").columns
    now = spark.read.parquet(f"{path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, path)
        assert after.count() <= now.count() or i == 4
        if i < 4:
            assert after.columns == columns
        after.write.parquet(f"{path}/{i}")
        now = spark.read.parquet(f"{path}/{i}")
    assert now.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    same = corpus_pipeline.run(spark, path).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert Counter(map(tuple, same)) == Counter(map(tuple, now.select("doc_id", "piece", "length", "ids_crc32").collect()))
