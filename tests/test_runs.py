"""Comparisons of runs, the chunk report, the result store, prompt search and skip-gram training against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import statistics as ST
from textloom.operators import chunk_report as CR
from textloom.operators import chunking as C
from textloom.operators import comparisons as R
from textloom.operators import scoring as SC
from textloom.operators import skipgram as SG

SCORES = "run string, qid int, score double, cluster int"


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(2)
    base = rng.random(120)
    rows = [(r, q, float(base[q] + shift + noise * rng.standard_normal()), q % 9) for r, shift, noise in (("a", 0.0, 0.0), ("b", 0.3, 0.1), ("c", 0.0, 0.02), ("d", -0.2, 0.5)) for q in range(120)]
    return spark.createDataFrame(rows, SCORES).persist(), rows


def plain_interval(rows, a, b, unit, draws, level=0.95):
    s = {(r, q): (x, c) for r, q, x, c in rows}
    per = {}
    for q in range(120):
        u = str(s[a, q][1] if unit == "cluster" else q)
        x = per.setdefault(u, [0.0, 0])
        x[0] += s[b, q][0] - s[a, q][0]
        x[1] += 1
    ends = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    weight = lambda u, r: int((int(hashlib.md5(f"{u}|{r // 4}|0".encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8], 16) / 2**32 >= ends).sum())
    means = []
    for r in range(draws):
        w = {u: weight(u, r) for u in per}
        means.append(sum(w[u] * x for u, (x, _) in per.items()) / sum(w[u] * n for u, (_, n) in per.items()))
    return np.percentile(means, [(1 - level) / 2 * 100, (1 + level) / 2 * 100])


@pytest.mark.parametrize("cluster", [None, "cluster"])
def test_intervals_against_a_plain_bootstrap(scores, cluster):
    df, rows = scores
    got = {(r["a"], r["b"]): r for r in R.compare(df, [("a", "b"), ("a", "c"), ("d", "a"), ("b", "a")], 0.05, cluster=cluster, draws=150).collect()}
    for (a, b), r in got.items():
        low, high = plain_interval(rows, a, b, cluster, 150)
        assert (r["low"], r["high"]) == (pytest.approx(low), pytest.approx(high))
        d = np.array([y[2] - x[2] for x, y in zip([x for x in rows if x[0] == a], [x for x in rows if x[0] == b], strict=True)])
        assert r["mean_diff"] == pytest.approx(d.mean()) and r["mde"] == pytest.approx(1.959963984540054 * d.std(ddof=1) / math.sqrt(120))
        assert (r["wins"], r["losses"], r["ties"], r["n"], r["units"]) == ((d > 0).sum(), (d < 0).sum(), (d == 0).sum(), 120, 9 if cluster else 120)
        assert r["reading"] == ST.interpret(r["low"], r["high"], 0.05)
    assert (got["a", "b"]["reading"], got["b", "a"]["reading"]) == ("b_better", "a_better")
    assert got["a", "b"]["low"] == pytest.approx(-got["b", "a"]["high"])


def test_readings_sizes_and_unequal_runs(spark, scores):
    assert [ST.interpret(*x) for x in ((-0.5, 0.4, 0.1), (-0.05, 0.05, 0.1), (0.1, 0.2, 1), (-0.2, -0.1, 1))] == ["inconclusive", "tie", "b_better", "a_better"]
    df, rows = scores
    means = {r: np.mean([x[2] for x in rows if x[0] == r]) for r in "abcd"}
    got = {r["size"]: r for r in R.size_rule(df, {64: "c", 128: "a", 256: "d"}, 0.01, draws=200).collect()}
    best = max((64, 128, 256), key=lambda s: means[{64: "c", 128: "a", 256: "d"}[s]])
    assert [s for s in got if got[s]["best"]] == [best] and got[64]["tied"] and got[128]["tied"] and not got[256]["tied"]
    assert [s for s in got if got[s]["chosen"]] == [64]
    with pytest.raises(Exception, match="has no score"):
        R.compare(df.where("run <> 'b' OR qid > 3"), [("a", "b")], 0.1).collect()
    with pytest.raises(ValueError):
        R.compare(df, [], 0.1)


def plain_report(chunks, spans, docs, floor, ceiling, budget):
    n = [c[6] for c in chunks]
    per = {}
    for c in chunks:
        per.setdefault(c[1], []).append(c)
    cuts = sum(len(x) - 1 for x in per.values())
    out = {"n": len(n), "min": min(n), "max": max(n), "mean": np.mean(n), "p5": np.percentile(n, 5), "p95": np.percentile(n, 95), "cv": np.std(n) / np.mean(n), "fill": np.mean(np.array(n) / budget), "above": np.mean([x + 2 > ceiling for x in n]), "below": np.mean([x < floor for x in n])}
    out["single_chunk_docs"] = np.mean([len(x) == 1 for x in per.values()])
    ends = starts = mid = dangling = straddling = held = total = union = 0
    over = []
    for d, cs in per.items():
        cs.sort(key=lambda c: c[2])
        known = [s[1:] for s in spans if s[0] == d]
        covered = set()
        for i, c in enumerate(cs):
            total += len(c[5])
            covered |= set(range(c[3], c[4]))
            if i:
                starts += c[3] in {a for a, _ in known}
                words = C.re.findall(r"\w+", c[5].lower())
                dangling += bool(words) and words[0] in CR.DANGLING
                over.append(max(0, cs[i - 1][4] - c[3]))
            if i < len(cs) - 1:
                ends += c[4] in {b for _, b in known}
                mid += docs[d][c[4] - 1].isalnum() and docs[d][c[4]].isalnum()
                if c[4] not in {b for _, b in known}:
                    straddling += 1
                    held += any(a < c[4] < b and cs[i + 1][3] <= a and cs[i + 1][4] >= b for a, b in known)
        union += len(covered)
    share = lambda x: x / cuts if cuts else None
    return out | {"cuts": cuts, "end_aligned": share(ends), "start_aligned": share(starts), "mid_word": share(mid), "dangling": share(dangling), "mean_overlap": np.mean(over) if over else None, "max_overlap": max(over, default=None), "redundancy": total / union, "straddling": straddling, "straddle_protected": held / straddling if straddling else None}


def test_report_against_a_plain_analysis(spark):
    rng = random.Random(4)
    docs = {d: "".join(" ".join(rng.choice(["it", "They", "cat", "dogs", "such", "a1"]) for _ in range(rng.randint(1, 12))) + rng.choice([".\n", ". ", "! "]) for _ in range(rng.randint(1, 12))) for d in range(15)}
    spans = [(d, a, b) for d, t in docs.items() for a, b in C.sentences(t)]
    chunks = []
    for name, size, step in (("x", 40, 40), ("y", 60, 25), ("whole", 10_000, 10_000)):
        chunks += [(name, d, i, a, min(a + size, len(t)), t[a : a + size], C.count(t[a : a + size])) for d, t in docs.items() for i, a in enumerate(range(0, len(t), step))]
    df = spark.createDataFrame(chunks, "config string, doc_id int, chunk_index int, start long, stop long, text string, n_tokens int")
    coherence = spark.createDataFrame([("x", 0.5), ("x", float("nan")), ("x", None), ("x", 1.0)], "config string, score double")
    rows = CR.report(df, spark.createDataFrame(spans, "doc_id int, start long, stop long"), spark.createDataFrame(list(docs.items()), "doc_id int, text string"), 8, 10, 3, coherence).collect()
    got = {(r["config"], r["measure"]): r["value"] for r in rows}
    for name in ("x", "y", "whole"):
        for k, v in plain_report([c for c in chunks if c[0] == name], spans, docs, 3, 10, 8).items():
            assert got[name, k] == (None if v is None else pytest.approx(float(v))), (name, k)
    assert (got["x", "n_scores"], got["x", "coherence"], got["y", "coherence"]) == (4.0, 0.75, None)


def test_tuning_takes_the_closest_percentile(spark):
    rng = random.Random(6)
    topics = [["cat", "paw", "fur"], ["car", "road", "oil"], ["sea", "salt", "wave"]]
    docs = [(d, " ".join(" ".join(rng.choice(topics[(s // 3 + d) % 3]) for _ in range(6)) + "." for s in range(15))) for d in range(8)] + [(90, None), (91, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = C.tune_semantic(df, 20, [10, 50, 90], min_tokens=4).collect()
    texts = [t for _, t in docs if t]
    gaps = [g for t in texts for g in C.gap_distances(t, C.sentences(t))]
    target = np.mean([C.count(t[a:b]) for t in texts for a, b in C.by_tokens(t, 0, len(t), 20)])
    means = {}
    for p in (10, 50, 90):
        limit = np.percentile(gaps, p)
        means[p] = np.mean([C.count(t[a:b]) for t in texts for a, b in C.semantic(t, C.gap_distances(t, C.sentences(t)), C.sentences(t), limit, 20, 4)])
    assert {r["percentile"]: r["mean_tokens"] for r in got} == pytest.approx(means) and all(r["target"] == pytest.approx(target) for r in got)
    assert [r["percentile"] for r in got if r["chosen"]] == [min(means, key=lambda p: abs(means[p] - target))]
    assert C.tune_semantic(df.limit(0), 20, [50]).count() == 0


def judge(spark, calls):
    def score(asked):
        calls.append(sorted((r["prompt"], r["example"]) for r in asked.collect()))
        right = (F.crc32(F.concat("prompt", "example")) % 10) < F.length("prompt")
        return asked.select("prompt", "hash", "example", right.alias("ok"), F.lit(True).alias("valid"), F.lit(False).alias("truncated"), F.lit(3).alias("tokens"))

    return score


def test_pairs_are_scored_once(spark, tmp_path):
    store, calls = SC.ResultStore(spark, str(tmp_path / "store")), []
    examples = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "example string")
    first, new = store.evaluate(["aa", "bbbb", "aa"], examples, judge(spark, calls))
    assert new == 6 and {r["prompt"]: r["n"] for r in first.collect()} == {"aa": 3, "bbbb": 3}
    again, new = SC.ResultStore(spark, str(tmp_path / "store")).evaluate(["bbbb", "c"], spark.createDataFrame([("3",), ("4",)], "example string"), judge(spark, calls))
    assert new == 3 and calls[-1] == [("bbbb", "4"), ("c", "3"), ("c", "4")]
    assert {r["prompt"]: r["n"] for r in again.collect()} == {"bbbb": 2, "c": 2}
    assert store.evaluate([], examples, judge(spark, calls))[1] == 0 and store.rows().count() == 9
    with pytest.raises(ValueError):
        store.evaluate([str(i) for i in range(1001)], examples, judge(spark, calls))


def test_candidates(spark):
    banned = SC.banned_grams(spark.createDataFrame([("One two, three four five six seven EIGHT nine",)], "text string"))
    assert banned.count() == 2
    texts = ["use {q} well", "use {q} well", "no place", "{q} " + "w " * 20, "{q}: one two three four five six seven eight!", "seen {q}", "no place", "{q} one\ttwo"]
    rows = spark.createDataFrame([(1 + i // 5, i, t) for i, t in enumerate(texts)], "round int, position int, prompt string")
    seen = spark.createDataFrame([(hashlib.sha256(b"seen {q}").hexdigest()[:12],)], "hash string")
    got = {r["position"]: r["reason"] for r in SC.check_candidates(rows, ["{q}"], 12, banned, seen).collect()}
    assert got == {0: None, 1: "duplicate", 2: "missing", 3: "long", 4: "banned", 5: "duplicate", 6: "missing", 7: None}
    assert SC.check_candidates(rows.limit(0), [], 5, banned, seen).count() == 0


def test_search_for_prompts(spark, tmp_path):
    ok = lambda p, e: zlib_crc(p + e) % 10 < len(p)
    proposals = [(1, 1, "ppppp"), (1, 2, "qqqqqqqqqq"), (1, 3, "x"), (2, 1, "rrrrrr"), (2, 2, "qqqqqqqqqq"), (3, 1, "ss"), (4, 1, "tttttttttt")]
    train, dev = [str(i) for i in range(20)], [str(i) for i in range(100, 140)]
    table = lambda x: spark.createDataFrame([(e,) for e in x], "example string")
    store = SC.ResultStore(spark, str(tmp_path / "s"))
    best, reason, log = SC.improve(store, "bb", spark.createDataFrame(proposals, "round int, position int, prompt string"), table(train), table(dev), judge(spark, []), [], 5, spark.createDataFrame([], "gram string"), 0.05, 2)
    by = {(x["round"], x["prompt"]): x for x in log}
    share = lambda p, of: sum(ok(p, e) for e in of) / len(of)
    assert by[1, "qqqqqqqqqq"]["status"] == "accepted" and by[1, "ppppp"]["reason"] == "not_best_of_round"
    assert (by[1, "qqqqqqqqqq"]["gained"], by[1, "qqqqqqqqqq"]["lost"]) == (sum(ok("qqqqqqqqqq", e) and not ok("bb", e) for e in dev), 0)
    assert by[2, "qqqqqqqqqq"]["reason"] == "duplicate" and by[2, "rrrrrr"]["reason"] == "not_significant" and by[2, "rrrrrr"]["parent"] == by[1, "qqqqqqqqqq"]["version"]
    for x in log:
        if x["dev"] is not None:
            assert (x["train"], x["dev"]) == (pytest.approx(share(x["prompt"], train)), pytest.approx(share(x["prompt"], dev)))
    assert (best, reason, len(log)) == ("qqqqqqqqqq", "patience", 7)


def zlib_crc(t):
    import zlib

    return zlib.crc32(t.encode())


def test_training_equals_a_plain_run(spark, tmp_path):
    rng = np.random.default_rng(0)
    width, words = 6, 12
    model = SG.initial(spark.range(words), width, 3)
    start = {r["id"]: r["w_in"] for r in model.collect()}
    w_in, w_out = np.array([start[i] for i in range(words)]), np.zeros((words, width))
    assert np.abs(w_in).max() <= 0.5 / width and len({tuple(x) for x in w_in}) == words
    batches, losses = [], []
    for k in range(6):
        rows = [(int(c), [int((c + 1) % 4)] + [int(x) for x in rng.integers(4, words, 3)], int(rng.integers(1, 4))) for c in rng.integers(0, words, 30)]
        batches.append(spark.createDataFrame(rows, "center long, targets array<long>, n int"))
        rate = 0.2 - (0.2 - 0.01) * k / 6
        c, t, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
        u, v = w_in[c], w_out[t]
        s = np.einsum("bd,bkd->bk", u, v)
        losses.append((n * (np.logaddexp(0, -s[:, 0]) + np.logaddexp(0, s[:, 1:]).sum(1))).sum() / n.sum())
        g = (1 / (1 + np.exp(-s)) - np.eye(1, 4)) * n[:, None]
        np.add.at(w_in, c, -rate * np.einsum("bk,bkd->bd", g, v))
        np.add.at(w_out, t.ravel(), -rate * np.einsum("bk,bd->bkd", g, u).reshape(-1, width))
    end, got = SG.train(model, batches, 6, 0.2, 0.01)
    assert got == pytest.approx(losses) and got[0] == pytest.approx(4 * math.log(2)) and got[-1] < got[0]
    rows = {r["id"]: r for r in end.collect()}
    assert np.allclose([rows[i]["w_in"] for i in range(words)], w_in) and np.allclose([rows[i]["w_out"] for i in range(words)], w_out)
    SG.save_vectors(end, str(tmp_path / "v"))
    back = {r["id"]: r["w_in"] for r in SG.load_vectors(spark, str(tmp_path / "v")).collect()}
    assert back == {i: rows[i]["w_in"] for i in range(words)}
    spark.createDataFrame([("other",)], "value string").coalesce(1).write.text(str(tmp_path / "w"))
    with pytest.raises(Exception, match="no vectors"):
        SG.load_vectors(spark, str(tmp_path / "w")).collect()
    assert SG.loss(SG.scored(model, batches[0].limit(0))) is None
