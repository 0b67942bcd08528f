"""Empty tables, nulls, repeats and clashing column names in the stages that keep rows, and bounds that are gone."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import ann, jaccard_join, langid, packing, quality, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i} alpha{i % 7}" for i in range(30_000))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_and_run_on_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, empty)
        assert out.count() == 0 and out.columns == docs.columns
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert quality.keep_good(docs).count() == toxicity.keep_civil(docs, toxicity.Model()).count() == jaccard_join.keep_one(docs).count() == suffix_dedup.remove_repeats(docs).count() == 0
    assert packing.pack(spark.createDataFrame([], "length long")).count() == langid.language_query(docs).count() == 0


def test_rows_that_are_null_empty_repeated_or_long(spark):
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, "some short text"), (None, LONG), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, Lost string, _text string, spans string")
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] if r["text"] is None else len(r["text"])) for r in kept.collect() if r["text"] is not None) == [(0, 0), (2, 0), (3, 0), (3, 0), (4, 15)]
    one = jaccard_join.keep_one(docs)
    assert one.columns == docs.columns and sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 0, 1, 2, 3, 3, 4]
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} <= {3, None}
    assert toxicity.keep_civil(docs, toxicity.Model()).count() == 7


def test_packing_beside_columns_of_the_same_names(spark):
    items = spark.createDataFrame([(i, 1 + i % 9, "a", 7, True) for i in range(50)], "id int, length long, Offset string, _bin int, _done boolean")
    rows = packing.pack(items, 10).collect()
    assert sorted(r["id"] for r in rows) == list(range(50))
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 10


def test_packing_goes_on_while_rounds_save_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 40)
    sizes = [10 + (i * 37) % 41 for i in range(600)]
    rows = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id int, length long").repartition(6), 100).collect()
    assert len({r["sequence_id"] for r in rows}) <= 1.04 * sum(sizes) / 100
    # nothing fits with anything else: it ends all the same
    assert packing.pack(spark.createDataFrame([(i, 60) for i in range(300)], "id int, length long").repartition(3), 100).select("sequence_id").distinct().count() == 300


def test_neighbours_of_vectors_of_several_lengths(spark):
    rows = spark.createDataFrame([(i, [float(i % 5 + 1), 1.0]) for i in range(30)] + [(100 + i, [1.0, float(i + 1), 2.0]) for i in range(10)] + [(200, []), (201, None)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(rows, rows.where("vec_id IN (3, 100, 200)"), k=4).collect()}
    assert [got[3, r] for r in range(1, 5)] == [(4, 21.0), (9, 21.0), (14, 21.0), (19, 21.0)]
    assert [got[100, r] for r in range(1, 5)] == [(109, 15.0), (108, 14.0), (107, 13.0), (106, 12.0)] and len(got) == 8


def test_every_word_of_the_sample_is_learned(spark):
    words = [f"{a}{b}{c}" for a in "abcd" for b in "aeiou" for c in "xyz"]
    docs = spark.createDataFrame([(i, " ".join(words[i::4] * 2), "pq"[i % 2]) for i in range(8)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.words) == set(words) and sum(map(len, model.grams.values())) > len(words)


def test_sizes_of_linked_sets_are_in_neighbouring_classes(spark):
    rows = [(n, -(-3 * n // 4)) for n in range(1, 4000)]
    df = spark.createDataFrame(rows, "n long, m long").select((jaccard_join._size(F.col("n")) - jaccard_join._size(F.col("m"))).alias("d"))
    assert df.agg(F.max("d"), F.min("d")).first() == (1, 0)
