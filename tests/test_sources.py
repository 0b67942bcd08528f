"""Round trips of readers and sinks, and operators that have no SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import replay, structure
from textloom.operators import vector_index as X
from textloom.sources import sinks, tables


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_beir_folder(spark, tmp_path):
    lines(tmp_path / "corpus.jsonl", [{"_id": "d1", "title": "T", "text": " body "}, {"_id": "d2", "title": None, "text": "x"}])
    lines(tmp_path / "queries.jsonl", [{"_id": "q1", "text": "a"}, {"_id": "q2", "text": "b"}])
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td2\t1\n")
    corpus, queries, qrels = tables.read_beir(spark, str(tmp_path))
    assert sorted(map(tuple, corpus.select("doc_id", "text").collect())) == [("d1", "T body"), ("d2", " x")]
    assert [r["qid"] for r in queries.collect()] == ["q1"] and [tuple(r) for r in qrels.collect()] == [("q1", "d2", 1)]


def test_code_files_are_taken_in_order_of_their_paths(spark, tmp_path):
    for name, n in (("b.py", 30), ("a/c.py", 20), ("skip/d.py", 50), ("e.txt", 60), ("z.py", 5)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * (n - 2) + "\n\n")
    files = tables.read_code_files(spark, str(tmp_path), min_chars=10, blocked=("skip",))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["b.py", "c.py"]
    assert [r["path"].rsplit("/", 1)[1] for r in tables.code_corpus(files, 25).collect()] == ["c.py"]


def test_labels_answers_and_hops(spark, tmp_path):
    (tmp_path / "l.csv").write_text('text,label\n"a, b", Card \nc,apple\n')
    rows = tables.read_labelled(spark, str(tmp_path / "l.csv"))
    assert tables.label_list(rows) == ["apple", "card"] and rows.select("id").distinct().count() == 2
    lines(tmp_path / "a.jsonl", [{"question": "q", "answer": "so #### 1,200"}])
    assert tables.read_answers(spark, str(tmp_path / "a.jsonl")).first()["gold"] == 1200.0
    lines(tmp_path / "h.jsonl", [{"id": "1", "question": "q", "answer": "y", "context": {"title": ["A", "B"], "sentences": [["a1. ", "a2."], ["b1."]]}}])
    hop = tables.read_hops(spark, str(tmp_path / "h.jsonl"))
    assert hop.select(tables.context_paragraphs(F.col("titles"), F.col("texts"))).first()[0] == "A: a1. a2.\n\nB: b1."


def test_entities_of_tags(spark, tmp_path):
    lines(tmp_path / "t.jsonl", [{"id": "1", "tokens": ["New", "York", "and", "Bo", "Li", "IBM"], "tags": ["B-LOC", "I-LOC", "O", "B-PER", "B-PER", "I-ORG"]}, {"id": "2", "tokens": ["x"], "tags": ["O"]}])
    got = {r["id"]: [tuple(e) for e in r["entities"]] for r in tables.entities_of_tags(tables.read_tagged(spark, str(tmp_path / "t.jsonl"))).collect()}
    assert got == {"1": [("New York", "LOC"), ("Bo", "PER"), ("Li", "PER"), ("IBM", "ORG")], "2": []}


def test_runs_and_logs(spark, tmp_path):
    lines(tmp_path / "runs/base.json", [{"q": "1", "s": 0.5}])
    lines(tmp_path / "runs/new.jsonl", [{"q": "1", "s": 0.7}])
    runs = tables.read_runs(spark, str(tmp_path / "runs"), "q string, s double")
    assert tables.run_ids(runs) == ["base", "new"] and tables.run_ids(runs, ["new"]) == ["new"]
    with pytest.raises(ValueError):
        tables.run_ids(runs, ["other"])
    for v in (1, 2):
        sinks.append_log(spark.createDataFrame([(v,)], "v int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_chunk_vector_and_model_stores(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "doc_id string, chunk_index int, text string")
    sinks.save_chunks(chunks, str(tmp_path / "c"))
    back = sinks.load_chunks(spark, str(tmp_path / "c"), "doc_id string, chunk_index int, text string, chunk_id string")
    assert sorted(r["chunk_id"] for r in back.collect()) == ["d::0", "d::1"]
    vectors = spark.createDataFrame([("d::0", [1.0, 0.0]), ("d::1", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    sinks.save_vectors(vectors, str(tmp_path / "v"))
    assert sinks.load_vectors(spark, str(tmp_path / "v"), back).count() == 2
    with pytest.raises(ValueError):
        sinks.load_vectors(spark, str(tmp_path / "v"), back.limit(1))
    with pytest.raises(ValueError):
        sinks.save_vectors(vectors.unionAll(spark.createDataFrame([("x", [1.0])], vectors.schema)), str(tmp_path / "w"))
    calls = []
    embed = lambda t: calls.append(1) or vectors
    for _ in range(2):
        assert sinks.embed_with_cache(back, str(tmp_path / "e"), embed).count() == 2
    assert len(calls) == 1
    merges, vocab = spark.createDataFrame([(0, 97, 98, 256)], "rank int, left int, right int, id int"), spark.createDataFrame([(256, bytearray(b"ab"))], "id int, bytes binary")
    sinks.save_bpe(merges, vocab, str(tmp_path / "m"))
    a, b = sinks.load_bpe(spark, str(tmp_path / "m"))
    assert a.collect() == merges.collect() and b.collect() == vocab.collect()


def test_summary_rows_replace_each_other(spark, tmp_path):
    one = lambda **x: spark.createDataFrame([x])
    sinks.write_summary_row(one(run="a", score=1.0), str(tmp_path / "s"), "run")
    sinks.write_summary_row(one(run="b", score=2.0, extra="x"), str(tmp_path / "s"), "run")
    got = sinks.write_summary_row(one(run="a", score=3.0), str(tmp_path / "s"), "run")
    assert {r["run"]: (r["score"], r["extra"]) for r in got.collect()} == {"a": (3.0, None), "b": (2.0, "x")}
    ids = sinks.config_id(one(name="n", size=1).unionAll(one(name="m", size=1)), ["size"])
    assert len({r["config_id"] for r in ids.collect()}) == 1


def vectors_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, u array<double>")


def test_marginal_relevance_over_all_rows(spark):
    x = np.random.default_rng(4).standard_normal((90, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = vectors_of(spark, x)
    got = {(r["query_id"], r["step"]): r["vec_id"] for r in X.mmr(rows.where("vec_id < 3"), rows, 5).collect()}
    sim = np.round(x @ x.T, 6)
    for q in range(3):
        picked = []
        for step in range(1, 6):
            value = [-np.inf if i == q or i in picked else round(0.7 * sim[i, q] - (0.3 * max(sim[i, p] for p in picked) if picked else 0), 9) for i in range(90)]
            picked.append(int(np.argmax(value)))
            assert got[q, step] == picked[-1]


def test_kmeans_settles_and_search_is_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((40, 5)) * 0.05 + c for c in np.eye(5)[:3]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = vectors_of(spark, x)
    centroids, labels = X.kmeans(rows, 3)
    c = np.array([r["u"] for r in centroids.orderBy("cid").collect()])
    got = {r["vec_id"]: r["cid"] for r in labels.collect()}
    assert [got[i] for i in range(120)] == np.round(x @ c.T, 6).argmax(axis=1).tolist()
    means = [np.mean([x[i] for i in range(120) if got[i] == k], axis=0) for k in range(3)]
    assert np.allclose(c, [m / np.linalg.norm(m) for m in means], atol=1e-6)
    near = X.search(rows.where("vec_id < 4"), rows, 7, others=True).orderBy("query_id", "rank").collect()
    s = np.round(x @ x.T, 6)
    for q in range(4):
        assert [r["vec_id"] for r in near if r["query_id"] == q] == sorted((i for i in range(120) if i != q), key=lambda i: (-s[i, q], i))[:7]


def test_agent_loop(spark):
    a, f, e = (lambda t, g: ("action", t, g, None)), ("finish", None, None, "42"), ("error", None, None, None)
    runs = {
        1: [a("search", "x"), f], 2: [e, e, f], 3: [a("search", "x"), a("search", "X"), a("search", "x"), f], 4: [a(None, "x"), a("search", "y"), a("look", "z"), f, e], 5: [a("search", "x")], 6: [a("search", "x"), a("search", "x")],
    }
    rows = [(i, n, *r, 10) for i, x in runs.items() for n, r in enumerate(x, 1)]
    calls = spark.createDataFrame(rows, "item long, call int, kind string, tool string, arg string, answer string, tokens long")
    known = spark.createDataFrame([("search", "x"), ("look", "z")], "tool string, arg string")
    got = {r["item"]: tuple(r)[1:] for r in replay.agent_loop(calls, known, max_steps=2, max_format_errors=2).collect()}
    assert got[1] == ("ok", "42", 2, 2, 20) and got[2] == ("format_failure", "42", 2, 3, 30)
    # a first repeat is told and tried again, a second ends the run; one more call gives the answer
    assert got[3] == ("loop", "42", 3, 4, 40) and got[4] == ("max_steps", "42", 2, 4, 40)
    assert got[5] == ("out_of_replies", None, 1, 1, 10) and got[6] == ("out_of_replies", None, 2, 2, 20)


def test_coherence(spark):
    embed = lambda texts: np.array([[1.0, 0.0] if "a" in t else [0.0, 1.0] for t in texts])
    chunks = spark.createDataFrame([(1, 0, "a b"), (1, 1, "b")], "doc_id long, chunk_index int, text string")
    parts = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "b")], "doc_id long, chunk_index int, piece int, text string")
    got = {r["chunk_index"]: r["score"] for r in structure.coherence(parts, chunks, embed).collect()}
    assert got == {0: 0.5, 1: None}
