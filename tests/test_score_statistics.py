"""Statistics over all pairs of queries and rows, in bounded space."""

import hashlib

import numpy as np
import pytest

from textloom.operators import metrics as M
from textloom.operators import vector_index as X
from textloom.plans import retrieval


@pytest.fixture(scope="module")
def rows(spark):
    """Vectors of few values, so that scores tie; some without a label or a vector."""
    rng = np.random.default_rng(3)
    made = [(i, None if i % 37 == 5 else i % 4, None if i % 41 == 7 else [float(x) for x in rng.integers(-2, 3, 3) + 0.5]) for i in range(400)]
    return X.unit_rows(spark.createDataFrame(made, "vec_id long, label int, embedding array<float>")).repartition(5)


def plain(rows):
    """{query: [(score in millionths, same label)]}"""
    known = [r for r in rows.collect() if r["u"] is not None and r["label"] is not None]
    return {q["vec_id"]: [(round(float(np.dot(q["u"], r["u"])) * 1e6), q["label"] == r["label"]) for r in known if r["vec_id"] != q["vec_id"]] for q in known if q["vec_id"] % 10 == 0}


def test_histogram(rows, monkeypatch):
    want = {}
    for s, same in (x for v in plain(rows).values() for x in v):
        at = want.setdefault(s, [0, 0])
        at[0 if same else 1] += 1
    asked = rows.where("vec_id % 10 = 0")
    for limit in (20_000, 9):  # all queries at once, and in parts
        monkeypatch.setattr(X, "BROADCAST_ROWS", limit)
        got = {round(r["score"] * 1e6): [r["r"], r["o"]] for r in X.score_histogram(asked, rows).collect()}
        assert got == want


def test_auc_in_passes(rows, monkeypatch):
    asked = rows.where("vec_id % 10 = 0")
    want = {}
    for q, found in plain(rows).items():
        a, b = ([s for s, same in found if same is k] for k in (True, False))
        want[q] = sum((x > y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b))
    for most, held in ((10**9, 1 << 18), (4000, 100)):
        monkeypatch.setattr(X, "PASS_PAIRS", most)
        monkeypatch.setattr(X, "HELD", held)
        got = {r["query_id"]: r["auc"] for r in X.score_auc(asked, rows).collect()}
        assert got == pytest.approx(want)
    assert {r["query_id"]: r["auc"] for r in M.auc_of_counts(X.score_counts(asked, rows), "query_id").collect()} == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("name", ["score_gap", "score_overlap"])
def test_global_figures_shuffle_no_query(spark, name):
    """What is grouped is the score or bin alone, so the shuffle doesn't grow with the queries."""
    df = retrieval.QUERIES[name][0](spark, "/root/testdata/sf0.001")
    assert "query_id" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_draw_for_each_query(spark, monkeypatch):
    """Most queries have too few keys below a low limit and are ranked again over all rows."""
    table = spark.range(300).selectExpr("id AS vec_id", "CAST(id % 3 AS int) AS label")
    asked = table.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id")
    key = lambda q, v: hashlib.md5(f"{q}|{v}|42".encode()).hexdigest()
    want = {(q, i + 1): (v, v % 3) for q in range(0, 300, 10) for i, v in enumerate(sorted((v for v in range(300) if v != q), key=lambda v: (key(q, v), v))[:5])}
    for drawn in (16, 1):
        monkeypatch.setattr(X, "DRAWN", drawn)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["label"]) for r in X.sample_for_each(asked, table, 5, 42).collect()}
        assert got == want
