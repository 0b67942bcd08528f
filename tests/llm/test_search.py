"""Decontamination, hard negatives and ranked search against plain versions, odd rows included."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, lexical, negatives
from textloom.llm.bytewords import word_places, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(LOW)) if text else []


def test_words_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + " ÄÖ İstanbul ΑΣ ﬁ 東京\x85x y 😀z A-b_c"
    assert [w.decode() for w in words(text.encode())] == plain_words(text)
    raw = text.encode()
    assert [raw[a:e].decode().translate(LOW) for a, e in word_places(raw)] == plain_words(text)
    assert words(None) == words(b"") == words(b" .!") == []


def plain_leaks(docs, items):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        n = min(10, len(w))
        if i is not None and n:
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = plain_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s : s + n])):
                    found |= x
                    hit |= set(range(s, s + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_rows(spark, docs, items):
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, n_words int, Items string")
    return sorted((tuple(r) for r in decontaminate.leak_digests(d, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(5)
    vocabulary = [*"abcde", "Wort", "é", "東京", "x1"]
    text = lambda n, of=vocabulary: rng.choice([" ", "\n", " - "]).join(rng.choice(of) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 30]), vocabulary + [f"w{i % 7}"])) for i in range(40)]
    items += [(100, items[7][1]), (7, items[7][1]), (101, None), (None, text(12)), (102, "only once here"), (103, " .. ")]
    docs = [(i, text(rng.choice([0, 1, 9, 10, 40, 200]))) for i in range(60)]
    docs += [(200 + k, text(30) + " " + t.upper() + " " + text(5)) for k, (_, t) in enumerate(items) if t]
    docs += [(300, None), (301, ""), (None, items[5][1]), (200, docs[60][1]), (302, "a " * 20000 + items[6][1]), (303, "Only ONCE\there!")]
    return docs, items


def test_leaks_against_all_windows(spark, leaky):
    docs, items = leaky
    got = leak_rows(spark, docs, items)
    assert got == plain_leaks(docs, items)
    assert any(r[2] and r[0] == 303 for r in got)


def test_leaks_in_several_passes(spark, leaky, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 300)
    monkeypatch.setattr(decontaminate, "STAGE_PASSES", 2)
    assert leak_rows(spark, *leaky) == plain_leaks(*leaky)


def test_leaks_of_empty_tables_and_spans(spark):
    assert leak_rows(spark, [], [(1, "a b")]) == []
    assert leak_rows(spark, [(1, "a b c"), (2, None)], []) == plain_leaks([(1, "a b c"), (2, None)], [])
    docs = spark.createDataFrame([(1, "é, A  b; c d", "k")], "doc_id long, text string, other string")
    r = decontaminate.find_leaks(docs, spark.createDataFrame([(3, "b C")], "item_id long, text string")).first()
    (s,) = r["hit_bytes"]
    assert (r["other"], "é, A  b; c d".encode()[s["first"] : s["end"]], r["items"]) == ("k", b"b; c", ["3"])
    kept = decontaminate.keep_uncontaminated(docs.union(spark.createDataFrame([(2, "b x c", None), (4, None, "")], docs.schema)), spark.createDataFrame([(3, "b C")], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4] and kept.columns == docs.columns


def test_shift_table_skips_and_finds_overlaps():
    (p,) = decontaminate.pattern_sets([b"a b c d e f g h i j k l"])
    assert sorted(s for s, _ in p.search(b"a b c d e f g h i j k l".split())) == [0, 1, 2]
    text = b"z z z z z z z z z z a b c d e f g h i j".split()
    assert [s for s, _ in p.search(text)] == [10]
    (q,) = decontaminate.pattern_sets([b"x x x"])
    assert [s for s, _ in q.search([b"x"] * 6)] == [0, 1, 2, 3]


def plain_negatives(rows, every=50):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]
    out = []
    for a, lab, v in {repr(r): r for r in rows if r[0] % every == 0}.values():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            fit = [(t, n) for t, n, m in scored if m != lab and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fit[:3])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit(1))
    return sorted(tuple(r) for r in negatives.hard_negatives(negatives.integer_rows(negatives.relabelled(df)), every=5).collect())


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    return [(i, int(rng.integers(4)), [float(x) for x in (centres[i % 6] + spread * rng.standard_normal(d)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize(("d", "spread"), [(8, 1.0), (3, 0.05), (24, 0.4)])
def test_negatives_against_all_products(spark, monkeypatch, d, spread):
    monkeypatch.setattr(negatives, "RING_ROWS", 16)
    rows = vectors(300, d, d, spread)
    got = mined(spark, rows)
    assert got and got == plain_negatives(rows, 5)


def test_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 1000)
    rows = vectors(90, 6, 1)
    rows += [(200 + i, i % 3, [0.5, 0.25, -0.5, 0.0, 1.0, 0.125]) for i in range(40)]  # copies: ties go to the smaller id
    rows += [rows[3], rows[5]]  # repeated rows
    rows += [(300, None, [1.0] * 6), (305, 1, None), (310, 1, [float("nan")] * 6), (315, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (325, 2, [0.0] * 6)]
    rows += [(330 + i, i % 2, [1.0, float(i)]) for i in range(12)] + [(400, 1, []), (401, 2, []), (402, 1, [])]
    assert mined(spark, rows) == plain_negatives(rows, 5)
    assert mined(spark, []) == mined(spark, rows[:1]) == []


def test_far_rings_are_left_out(spark):
    rows = vectors(2000, 4, 3, 0.02)
    ints = negatives.integer_rows(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    square = max(sum(math.floor(256 * x) ** 2 for x in v) for _, _, v in rows)
    rings, pivots = negatives.build_rings(ints, 4, float(square))
    v = np.floor(256 * np.array([rows[0][2]])).astype(np.int64)
    a = negatives.Anchors(np.array([0]), np.array([0]), v, pivots, square)
    best = sorted((int((v @ np.floor(256 * np.array(r[2]))).item()) for r in rows[1:]), reverse=True)[4]
    a.outer = a.radius(np.array([best]))
    assert 0 < negatives._near_rings(rings, a).count() < rings.count() / 2


def plain_ranks(docs, items, k=20):
    counts = [(d, Counter(plain_words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for i, text in dict.fromkeys(items):
        scores = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_words(text) if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(9)
    words_ = [f"w{i}" for i in range(40)] + ["É", "ß"]
    docs = [(i, " ".join(rng.choice(words_) for _ in range(rng.choice([0, 1, 3, 30, 300])))) for i in range(200)]
    docs += [(300 + i, "W1 w2 w3") for i in range(60)] + [(500, None), (501, ""), (None, "w1 w2 " * 9), (300, "w1 w2 w3"), (502, "w5 " * 30000)]
    items = [(i, " ".join(rng.choice(words_) for _ in range(rng.choice([1, 2, 10])))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "nowhere"), (43, "w1 w1 W2"), (43, "w1 w1 W2"), (None, "w7")]
    return docs, items


def ranked(spark, docs, items):
    index = lexical.build_index(spark.createDataFrame([(a, b, "y") for a, b in docs], "doc_id long, text string, ids string").repartition(3))
    return sorted((tuple(r) for r in lexical.rank(index, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)


def test_ranks_against_all_scores(spark, searched):
    assert ranked(spark, *searched) == plain_ranks(*searched)


def test_ranks_over_small_shards_and_passes(spark, searched, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    monkeypatch.setattr(lexical, "PASS_BYTES", 200)
    assert ranked(spark, *searched) == plain_ranks(*searched)


def test_ranks_of_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == ranked(spark, [(1, None)], [(1, "a")]) == ranked(spark, [(1, "a")], []) == []


def test_best_is_safe_with_ties():
    scores, ids = np.array([5, 7, 5, 5, 0, 7, 5]), np.array([9, 8, 2, 4, 1, 3, 7])
    assert ids[lexical.best(scores, ids, 4)].tolist() == [3, 8, 2, 4]
    assert ids[lexical.best(scores, ids, 10)].tolist() == [3, 8, 2, 4, 7, 9]
