"""The trained inverted file against exact search, and its odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.vector import unit
from textloom.operators import inverted_file as IF
from textloom.operators import vector_index as X


def rows_of(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, e array<double>").select("vec_id", unit(F.col("e")).alias("u"))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    v = np.repeat(rng.standard_normal((10, 16)), 100, axis=0) + 0.3 * rng.standard_normal((1000, 16))
    rows = rows_of(spark, v).persist()
    return rows, IF.build(rows, IF.train(rows, 10, seed=1))


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in df.collect())


def test_all_lists_are_an_exact_search(clustered):
    rows, index = clustered
    asked = rows.where("vec_id % 50 = 0")
    assert found(index.search(asked, 7, 10)) == found(X.search(asked, rows, 7))
    assert found(index.search(asked, 7, 99)) == found(X.search(asked, rows, 7))


def test_few_lists_find_nearly_all(clustered):
    rows, index = clustered
    asked = rows.where("vec_id % 20 = 0")
    exact = {x[:1] + x[2:3] for x in found(X.search(asked, rows, 5))}
    got = {x[:1] + x[2:3] for x in found(index.search(asked, 5, 3))}
    assert len(exact & got) >= 0.9 * len(exact)
    scanned = {r["query_id"]: r["scanned"] for r in index.scanned(asked, 3).collect()}
    assert len(scanned) == 50 and np.mean(list(scanned.values())) < 500
    assert sum(r["n"] for r in index.sizes().collect()) == 1000


def test_large_lists_are_several_blocks(spark, clustered, monkeypatch):
    monkeypatch.setattr(IF, "BLOCK_ROWS", 16)
    monkeypatch.setattr(IF, "QUERY_ROWS", 4)
    rows, index = clustered
    small = IF.build(rows, index.centroids)
    assert small.lists.count() > 60
    asked = rows.where("vec_id % 30 = 0")
    assert found(small.search(asked, 5, 3)) == found(index.search(asked, 5, 3))


def test_written_and_read(spark, clustered, tmp_path):
    rows, index = clustered
    index.write(str(tmp_path / "ivf"))
    again = IF.read(spark, str(tmp_path / "ivf"))
    asked = rows.where("vec_id % 100 = 0")
    assert found(again.search(asked, 5, 2)) == found(index.search(asked, 5, 2))
    assert len(list((tmp_path / "ivf" / "lists").glob("cid=*"))) == 10


def test_ties_copies_empty_lists_and_padding(spark):
    rows = rows_of(spark, [[1, 0], [1, 0], [1, 0], [0, 1]])
    index = IF.build(rows, IF.train(rows, 4, seed=0))
    sizes = [r["n"] for r in index.sizes().orderBy("cid").collect()]
    assert sorted(sizes) == [0, 0, 1, 3]
    asked = rows.where("vec_id = 2")
    assert [x[2] for x in found(index.search(asked, 2, 4))] == [0, 1]
    # the nearest list alone holds three rows
    near = int(np.argmax(np.round(index.centroids @ np.array([1.0, 0.0]), 6)))
    assert sizes[near] == 3
    padded = index.search(asked, 5, 1, padded=True).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in padded] == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, -1, None), (5, -1, None)]


def test_more_lists_than_rows_nulls_and_bad_settings(spark):
    rows = rows_of(spark, [[1, 0], [0, 1]]).union(spark.createDataFrame([(9, None)], "vec_id long, u array<double>"))
    index = IF.build(rows, IF.train(rows, 10))
    assert len(index.centroids) == 2 and index.lists.agg(F.sum("n")).first()[0] == 2
    assert index.search(rows, 1, 2).count() == 2
    for bad in (lambda: IF.train(rows, 0), lambda: IF.train(rows, 2, train_rows=0), lambda: index.search(rows, 0, 1), lambda: index.search(rows, 1, 0), lambda: IF.train(rows.limit(0), 2)):
        with pytest.raises(ValueError):
            bad()


def test_training_is_bounded_by_its_sample(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(spark, rng.standard_normal((300, 4)))
    a, b = IF.train(rows, 8, train_rows=50), IF.train(rows.repartition(7), 8, train_rows=50)
    assert np.array_equal(a, b) and np.allclose((a * a).sum(1), 1)


@pytest.mark.parametrize("broadcast", [20_000, 3])
def test_exact_search_by_broadcast_and_by_shuffle(spark, monkeypatch, broadcast):
    monkeypatch.setattr(X, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(X, "BLOCK_ROWS", 40)
    monkeypatch.setattr(X, "QUERY_ROWS", 2)
    monkeypatch.setattr(X, "HELD", 50)
    rng = np.random.default_rng(7)
    v = rng.standard_normal((300, 5)).round(1)
    v[200:240] = v[0]  # ties
    label = rng.integers(0, 3, 300)
    unit_v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    rows = spark.createDataFrame([(i, int(label[i]), [float(x) for x in unit_v[i]]) for i in range(300)] + [(900, 0, [1.0, 0.0]), (901, 1, [0.6, 0.8]), (902, 0, None)], "vec_id long, label int, u array<double>").repartition(4)
    asked = rows.where("vec_id % 40 = 0 OR vec_id >= 900")
    s = np.round(unit_v @ unit_v.T, 6)
    want, capped = [], []
    for q in range(0, 300, 40):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-s[q, i], i))
        want += [(q, n + 1, i, s[q, i]) for n, i in enumerate(order[:6])]
        kept = [i for i in order if sum(label[j] == label[i] for j in order[: order.index(i)]) < 2]
        capped += [(q, n + 1, i, s[q, i]) for n, i in enumerate(kept[:5])]
    assert [x for x in found(X.search(asked, rows, 6, others=True)) if x[0] < 900] == sorted(want)
    assert [x for x in found(X.search(asked, rows, 6, others=True)) if x[0] >= 900] == [(900, 1, 901, 0.6), (901, 1, 900, 0.6)]
    assert [x for x in found(X.capped_label(asked, rows, 5, 0.4)) if x[0] < 900] == sorted(capped)
    counts = {(r["query_id"], r["score"]): (r["r"], r["o"]) for r in X.score_counts(asked.where("vec_id < 300"), rows.where("vec_id < 300")).collect()}
    assert sum(a + b for a, b in counts.values()) == 8 * 299
    q = 80
    for x in set(s[q].tolist()):
        at = [i for i in range(300) if i != q and s[q, i] == x]
        if at:
            assert counts[q, x] == (sum(label[i] == label[q] for i in at), sum(label[i] != label[q] for i in at))
    picks = sorted(tuple(r) for r in X.mmr(asked.where("vec_id < 300"), rows.where("vec_id < 300"), 3).collect())
    monkeypatch.setattr(X, "BROADCAST_ROWS", 20_000)
    assert picks == sorted(tuple(r) for r in X.mmr(asked.where("vec_id < 300"), rows.where("vec_id < 300"), 3).collect()) and len(picks) == 24
