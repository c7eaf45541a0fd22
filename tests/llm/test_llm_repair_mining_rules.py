"""Conversation repair, hard negatives and quality rules against plain restatements, with nulls, ties, repeats, long and empty rows, and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from cueforge.llm import conversations, hard_negatives, queries, rules, simhash
from cueforge.llm.words import blocks

TURNS = "conv_id long, turn long, role string, text string, kind int, at string, digest string, copy long"
SPACE = " \t\n\x0b\x0c\r"


def turns():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "why?", "and then", "so ", "", " \t", None, "é… ", "Done. \n", "a\x85", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]
    out = []
    for c in range(400):
        n = rng.choice([0, 1, 1, 2, 3, 4, 5, 6])
        out += [(c, t * rng.choice([1, 1, 2]), rng.choice(roles[: rng.choice([3, 5, 9])]), rng.choice(texts[: rng.choice([3, 5, 11])])) for t in range(n)]
    out += [(500, t, "user" if t % 2 == 0 else "assistant", f"t {t % 700}" + "." * (t % 3)) for t in range(3000)]  # many fragments
    out += [(501, 7, rng.choice(["user", "assistant"]), rng.choice(["A.", "B", "C."])) for _ in range(40)]  # one turn
    out += [(None, None, "user", "hi."), (None, None, "user", "hi."), (None, 3, "assistant", None), (502, None, None, None), (503, -5, "user", texts[-1]), (503, 5, "assistant", "k.")]
    return [(*r, 1, "a", "d", 2) for r in out]


def spoilt(rows):
    """The damage, and then the order."""
    text = lambda x: " " if x is None else str(x)
    out = defaultdict(list)
    for conv, turn, role, said, *_ in rows:
        code = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        said = "" if code == 1 else said.translate(dict.fromkeys(map(ord, ".!?"))) if code == 2 else said
        out[conv] += [] if code == 0 else [(turn, "user" if code == 4 else role, said)] * (2 if code == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16]))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, said in rows:
        body = said.rstrip(SPACE)
        out.append("blank" if not body.strip(SPACE) else "duplicate" if (role, said) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, said))
    return out


STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows, faults):
    """From the end: the least (cost, edits) that repairs the rows from i on after initial g; a suffix of the best is the best of its kind."""
    n = len(rows)
    after = {}
    for i in range(n, -1, -1):
        now = {}
        for g in STEPS:
            best = (0, "") if i == n and g in ("", "a") else (math.inf, "")
            if i < n:
                more = 3 if faults[i] == "truncated" else 0
                options = [("D", g, 4)]
                if faults[i] in ("", "truncated"):
                    options += [("K", STEPS[g][rows[i][1][:1]], more)] if rows[i][1][:1] in STEPS[g] else []
                    options += [("R", x, 3 + more) for x in STEPS[g].values() if x in "ua"]
                best = min([best, *((c + after[h][0], e + after[h][1]) for e, h, c in options)])
            now[g] = best
        for _ in range(3):  # inserts
            for g in STEPS:
                now[g] = min([now[g], *((3 + now[h][0], "I" + now[h][1]) for h in STEPS[g].values() if h in "ua")])
        after = now
    return after[""]


def exhaustive(rows, faults):
    """All strings of edits, one by one."""
    best = [(4 * len(rows), "D" * len(rows))]

    def go(i, g, cost, label, inserts):
        if (cost, label) > best[0] and cost > best[0][0]:
            return
        if i == len(rows):
            if g in ("", "a"):
                best[0] = min(best[0], (cost, label))
        else:
            more = 3 if faults[i] == "truncated" else 0
            go(i + 1, g, cost + 4, label + "D", 0)
            if faults[i] in ("", "truncated"):
                if rows[i][1][:1] in STEPS[g]:
                    go(i + 1, STEPS[g][rows[i][1][:1]], cost + more, label + "K", 0)
                for h in STEPS[g].values():
                    if h in "ua":
                        go(i + 1, h, cost + 3 + more, label + "R", 0)
        if inserts < 3:
            for h in STEPS[g].values():
                if h in "ua":
                    go(i, h, cost + 3, label + "I", inserts + 1)

    go(0, "", 0, "", 0)
    return best[0]


def mended(rows, audit):
    out, i, g = [], 0, ""
    for e in audit:
        if e in "IR":
            role = {"u": "user", "a": "assistant"}["a" if g == "u" else "u"]
            out.append((role, rows[i][2] if e == "R" else ""))
        elif e == "K":
            out.append(rows[i][1:])
        if e != "D":
            g = out[-1][0][:1]
        i += e != "I"
    return out


def test_conversation_repair(spark):
    rows = turns()
    damaged = spoilt(rows)
    got = {r.conv_id: r for r in conversations.audited(spark.createDataFrame(rows, TURNS).repartition(5)).collect()}
    assert set(got) == {r[0] for r in rows} and len(damaged) <= len(got)
    for conv, r in got.items():
        own = damaged.get(conv, [])
        kinds = faults(own)
        cost, audit = cheapest(own, kinds)
        if len(own) <= 4:
            assert exhaustive(own, kinds) == (cost, audit)
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [x[1][:1] for x in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mended(own, audit)).encode()).hexdigest()
        want = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
        assert tuple(r)[1:] == want, (conv, own[:8])
    assert any(len(r.audit) > 2000 for r in got.values()) and any(not r.audit for r in got.values())


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "hello."), (1, 2, "assistant", "hello."), (1, 3, "tool", "x."), (2, 0, "user", " ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    summary, fixed = conversations.repair(df)
    assert {(r.conv_id, r.cost, r.audit) for r in summary.collect()} == {(1, 11, "KIKDRI"), (2, 4, "D")} or {r.conv_id: r.cost for r in summary.collect()} == {1: cheapest([x[1:] for x in rows[:4]], ["", "", "duplicate", ""])[0], 2: 4}
    audit = {r.conv_id: r.audit for r in summary.collect()}[1]
    assert [(r.place, r.role, r.text) for r in fixed.orderBy("place").collect()] == [(i, *x) for i, x in enumerate(mended([x[1:] for x in rows[:4]], audit))]
    empty = spark.createDataFrame([], TURNS)
    assert conversations.audited(empty).count() == 0 and [x.count() for x in conversations.repair(empty)] == [0, 0]


def test_composition_in_parts():
    """Matrices of any parts give what the whole gives."""
    rng = random.Random(3)
    for _ in range(60):
        symbols = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(1, 14)))
        whole = conversations.shortest(symbols, 0)
        cuts = sorted(rng.randrange(len(symbols) + 1) for _ in range(3))
        parts = [conversations.matrix(symbols[a:b], (0, 1, 2, 3)) for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]
        found = parts[0]
        for p in parts[1:]:
            found = conversations.product(found, p)
        assert found[0] == whole


VECTORS = "vec_id long, embedding array<float>, label int, slab int, kind int, mark string, place long"


def mined(rows, low=30, high=90):
    clean = {}
    for vec, e, label in rows:
        if vec is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in e)
        if sum(x * x for x in v) < 2**61.9:
            clean[vec, label, v] = True
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for vec, label, v in clean:
        if vec % 100 == 0:
            near = sorted((-score(v, w), i) for i, other, w in clean if other == label and i != vec)[:5]
            far = sorted((-score(v, w), i) for i, other, w in clean if other != label)
            for p, i in near:
                window = [(s, j) for s, j in far if low * -p <= 100 * -s <= high * -p][:10]
                out += [(vec, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(window)]
    return out


def test_hard_negatives(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(1500):
        c = rng.choice(centres)
        scale = rng.choice([0.1, 1, 1, 5])  # norms that prune
        rows.append((i, [scale * (x + rng.gauss(0, 0.6)) for x in c], rng.randrange(4)))
    rows += [(2000 + i, rows[100][1], i % 3) for i in range(40)]  # ties
    rows += [rows[7], rows[100], rows[100], (100, rows[3][1], 1), (2100, None, 1), (2200, rows[1][1], None), (None, rows[1][1], 1), (2300, [1.0, None], 1), (2400, [math.nan] * 12, 1), (2500, [math.inf] * 12, 1)]
    rows += [(2600, [], 1), (2700, rows[5][1][:5], 2), (2800, rows[5][1] + [1.0, 2.0], 2), (2900, [2e6] * 12, 3), (2901, [-3e6, 1.0], 3), (2902, [1e6] * 12, 2), (2903, [2e6] * 12, 3), (2904, [9e6] * 12, 3), (3000, [1e30] * 12, 1), (-100, rows[9][1], 0)]
    df = spark.createDataFrame([(*r, 1, 2, "m", 3) for r in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(df).collect()]
    assert sorted(got) == sorted(mined(rows)) and len(got) > 500 and any(r[0] == 2900 for r in got)
    assert hard_negatives.mine(df.limit(0)).count() == 0 and hard_negatives.mine(df.filter("vec_id % 100 <> 0")).count() == 0


def test_norm_buckets_are_pruned():
    """Once k candidates are found among the longest vectors, no other bucket of 13 is scored."""
    rng = np.random.default_rng(2)
    v = np.r_[rng.integers(900, 1000, (300, 4)), rng.integers(1, 5, (3000, 4))]
    square = (v * v).sum(axis=1)
    order = np.lexsort((np.arange(len(v)), -square))
    columns = {"vec_id": pa.array(order), "label": pa.array(np.zeros(len(v), int)), "mark": pa.array(order), "square": pa.array(square[order]), "v": pa.array(v[order].tolist(), pa.list_(pa.int32()))}
    slab = hard_negatives.Slab([pa.table(columns)])
    seen = []
    real = slab.buckets
    slab.buckets = lambda *a: (seen.append(x[0]) or x for x in real(*a))
    block = pa.StructArray.from_arrays([pa.array([10**6]), pa.array([0]), pa.array([0]), pa.array([4 * 10**6]), pa.array([[1000] * 4], pa.list_(pa.int32()))], ["vec_id", "mark", "label", "square", "v"])
    found = hard_negatives._positives(slab, block, 5)
    assert [s for *_, s, _ in found] == sorted((1000 * v.sum(axis=1)).tolist())[::-1][:5] and seen == [0]


def judged(rows, words=50):
    """The counts of a text, its classes and its words' bins, in plain Python."""
    out = []
    for _, text, *_ in rows:
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        kinds = [0] * 7
        for c in text:
            kinds[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in SPACE else 4 if c in ".,;:?!'\"()-" else 5 if c < "\x80" else 6] += 1
        bins = Counter(word_bin("".join(c.lower() if "A" <= c <= "Z" else c for c in x)) for x in w)
        out.append(((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)), kinds, bins))
    return out


_BINS: dict[str, int] = {}


def word_bin(word):
    if word not in _BINS:
        _BINS[word] = int(next(blocks(pa.array([word]))).hashes()[0] >> np.uint64(48))
    return _BINS[word]


def js(p, q):
    s = sum(p.values())
    total = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0) / s, q.get(k, 0)
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(0.0, total))


@lru_cache(None)
def on_grid(q, k):
    return rules.by_chance(np.array(q), 2.0 ** (k / 2))


def chance(q, n):
    """Between two lengths of a grid, by the logarithm of n; beyond it by its root."""
    k = min(26, max(10, 2 * math.log2(n)))
    low, high = on_grid(q, math.floor(k)), on_grid(q, math.ceil(k))
    return (low + (k - math.floor(k)) * (high - low)) * math.sqrt(2**13 / max(n, 2**13))


def test_chance():
    """What drawing words gives, on average over many draws."""
    rng = np.random.default_rng(1)
    q = np.r_[rng.dirichlet(np.ones(60)) * 0.6, 0.4]
    for n in (50, 400):
        draws = rng.multinomial(n, q, 3000)
        assert rules.by_chance(q, n) == pytest.approx(math.sqrt((rules.distance(draws, q) ** 2).mean()), rel=0.02)


def test_quality_rules(spark):
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(300)] for lang, letters in (("en", "abcdet"), ("de", "äöükln"))}
    text = lambda lang, n: "\n".join(" ".join(words[lang][min(299, int(rng.expovariate(0.03)))] for _ in range(20)) for _ in range(max(1, n // 20)))
    rows = [(i, text(lang, rng.choice([10, 40, 60, 100, 400])), lang) for i in range(200) for lang in [rng.choice(["en", "en", "de"])]]
    rows += [(300 + i, text("en", 120).upper(), "en") for i in range(4)] + [(310 + i, " | ".join(text("en", 120).split()), "de") for i in range(4)]
    rows += [(220, "same line\n" * 60, "en"), (221, None, "en"), (222, "", None), (223, " \t\n", "de"), (224, text("en", 200), None), (225, text("de", 200), "xx"), (226, text("en", 30_000), "en"), (None, rows[3][1], "en"), rows[5], rows[5]]
    rows += [(227, "a a a " + text("en", 100), "en"), (228, "é…  #$|<" * 90, "en"), (229, "ab " * 49, "en"), (230, "1.5 %\x0b&", "en")]
    full = [(*r, len(r[1] or ""), "s", False, 1.0) for r in rows]
    schema = "doc_id long, text string, lang string, n_words long, source string, kept boolean, class_distance double"
    df = spark.createDataFrame(full, schema).repartition(4)
    got = sorted((tuple(r) for r in rules.judge(df).collect()), key=repr)
    told = judged(rows)
    unit = 1 << 20
    gathered = defaultdict(lambda: ([0] * 7, Counter(), [0]))
    for (_, _, lang), (n, kinds, bins) in zip(rows, told, strict=True):
        if n[0] >= 50:
            for key in {lang, None}:
                for k in range(7):
                    gathered[key][0][k] += kinds[k] * unit // sum(kinds)
                for b, c in bins.items():
                    gathered[key][1][b] += c * unit // n[0]
                gathered[key][2][0] += 1
    want = []
    for (doc, _, lang), (n, kinds, bins) in zip(rows, told, strict=True):
        of = gathered[lang if lang and gathered[lang][2][0] >= 30 else None]
        q = {k: x / sum(of[0]) for k, x in enumerate(of[0])}
        common = {b: x / (of[2][0] * unit) for b, x in of[1].items() if x >= 0.002 * of[2][0] * unit}
        common[-1] = 1 - sum(common.values())
        bad = n[0] < 50 or 100 * n[4] > 50 * n[0]
        far = js(dict(enumerate(kinds)), q) if sum(kinds) >= 200 else None
        p = Counter()
        for b, c in bins.items():
            p[b if b in common else -1] += c
        apart = js(p, common) if n[0] >= 60 else None
        good = not bad and not (far is not None and far > 0.2 + 2 / math.sqrt(sum(kinds))) and not (apart is not None and apart > 0.12 + chance(tuple(common.values()), n[0]))
        want.append((doc, *n, bad, good, far, apart))
    want.sort(key=repr)
    assert [r[:8] for r in got] == [r[:8] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[8:] == pytest.approx(b[8:], abs=1e-9)
    verdict = {r[0]: r[7] for r in got}
    assert not [i for i in (*range(300, 304), *range(310, 314), 220, 221, 222, 223, 228, 229) if verdict[i]] and sum(r[6] or r[7] for r in got if r[0] is not None and r[0] < 200) > 190
    assert rules.judge(df.limit(0)).count() == 0


def test_sketches_never_understate():
    """What two sets share is never more than their sketches allow, full bins and sketches of other widths included; sets far apart are told."""
    rng = np.random.default_rng(6)
    for n, m, both in ((40, 50, 30), (400, 380, 100), (224, 228, 200), (110, 130, 100), (3000, 2800, 900), (60_000, 59_000, 58_000), (1, 1, 1), (0, 5, 0)):
        pool = rng.integers(0, 2**63, n + m - both).astype(np.uint64) * np.uint64(2)
        told = simhash.Sketches(simhash.sketches(np.r_[pool[:n], pool[n - both :]], np.array([0, n, n + m])))
        bound = told.most_shared(np.array([0, 1]), np.array([1, 0]))
        assert bound[0] == bound[1] >= both and (n not in (400, 3000) or bound[0] < 0.86 * n) and (n != 60_000 or bound[0] == np.inf)


def test_queries_are_registered():
    assert {"op11_conversation_repair", "op12_hard_negatives", "op13_quality_rules"} <= set(queries.QUERIES) and "op12_hard_negatives" in queries.ORACLE_SQL
