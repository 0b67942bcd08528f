"""Extracted sets, relations read by place, books split, attention by stacks, and the encoder against a plain one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import attention as A
from textloom.operators import extraction as X
from textloom.operators.byte_pairs import BytePairs


def test_sets_and_micro_figures(spark):
    record = lambda pairs, triples=(): json.dumps({"entities": [{"text": a, "type": b} for a, b in pairs], "relations": [dict(zip(("subject", "relation", "object"), t, strict=True)) for t in triples]})
    rows = [
        (record([("Ann", "PER"), ("Ann", "PER"), ("Rome", "LOC")], [("Ann", "Live_In", "Rome")]), [("Ann", "PER"), ("Oslo", "LOC")], [("Ann", "Live_In", "Rome")]),
        (None, [("Bo", "PER")], []),
        ("not json", [], [("a", "b", "c")]),
        (record([("Bo", "ORG")]), None, None),
    ]
    df = spark.createDataFrame(rows, f"value string, gold {X.PAIRS}, relations {X.TRIPLES}")
    df = df.select(X.set_counts(F.col("gold"), X.pairs(F.col("value"))).alias("e"), X.set_counts(F.col("relations"), X.triples(F.col("value"))).alias("r"))
    assert [tuple(r["e"]) for r in df.collect()] == [(1, 2, 2), (0, 0, 1), (0, 0, 0), (0, 1, 0)]
    e, r = X.micro(df, "e").first(), X.micro(df, "r").first()
    assert (e["common"], e["precision"], e["recall"], e["f1"]) == (1, pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert (r["precision"], r["recall"]) == (1.0, 0.5)
    none = X.micro(df.where("e.gold > 99"), "e").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_flags_and_topics(spark):
    rows = [('{"has_person": true, "has_organization": false, "has_location": true, "has_misc": false, "topic": "a"}', [("x", "PER")], "a"), (None, [("x", "PER")], "a"), ('{"has_person": false, "topic": "b"}', [("x", "PER")], "a")]
    df = spark.createDataFrame(rows, f"value string, gold {X.PAIRS}, topic string")
    r = X.flat_accuracy(df, "value", "gold").first()
    assert (r["n"], r["has_person"], r["has_organization"], r["has_location"]) == (2, 0.5, 0.5, 0.0)
    assert [x[0] for x in df.select(X.topic_correct(F.col("value"), F.col("topic"))).collect()] == [True, False, False]


def test_relations_name_their_entities(spark, tmp_path):
    rows = [{"tokens": ["Ann", "Lee", "works", "for", "Acme", "."], "entities": [{"type": "Peop", "start": 0, "end": 2}, {"type": "Org", "start": 4, "end": 5}], "relations": [{"type": "Work_For", "head": 0, "tail": 1}]}, {"tokens": ["No", "one"], "entities": [], "relations": []}]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = {r["sentence"]: r for r in X.read_relations(spark, str(tmp_path / "c.jsonl")).collect()}
    r = got["Ann Lee works for Acme ."]
    assert [tuple(x) for x in r["entities"]] == [("Ann Lee", "Peop"), ("Acme", "Org")] and [tuple(x) for x in r["relations"]] == [("Ann Lee", "Work_For", "Acme")]
    assert got["No one"]["relations"] == [] and len({r["id"] for r in got.values()}) == 2 and r["id"].startswith("validation_")


def test_books_are_split_beyond_a_gap():
    assert X.prose_split("\n [A Book by B] \n abcdefghij ", 4, 2, 3) == ("abcd", "ghi")
    assert X.prose_split("abcdefghij", 4, 0, 6) == ("abcd", "efghij")
    with pytest.raises(ValueError):
        X.prose_split("abc", 2, 1, 1)


def test_uniform_attention_and_stacks(spark):
    import numpy as np

    for n in (1, 4, 7):
        w = np.tril(np.ones((n, n)))
        w /= w.sum(1, keepdims=True)
        assert A.uniform_received(n) == pytest.approx((w.sum(0) / np.arange(n, 0, -1)).tolist())
    rng = np.random.default_rng(1)
    w = rng.random((2, 3, 2, 4, 4)) * np.tril(np.ones((4, 4)))
    w /= w.sum(-1, keepdims=True)
    rows = [(s, la, h, q, k, float(w[s, la, h, q, k])) for s in range(2) for la in range(3) for h in range(2) for q in range(4) for k in range(q + 1)]
    got = {(r["stack"], r["q"], r["k"]): r["w"] for r in A.rollout(spark.createDataFrame(rows, "stack int, layer int, head int, q int, k int, w double"), 3).collect()}
    for s in range(2):
        out = np.eye(4)
        for la in range(3):
            a = w[s, la].mean(0) / 2 + np.eye(4) / 2
            out = (a / a.sum(1, keepdims=True)) @ out
        for q in range(4):
            for k in range(q + 1):
                assert got[s, q, k] == pytest.approx(out[q, k])


def plain_part(model, word):
    ids = list(word.encode())
    while len(ids) > 1:
        best = min((model.merges[p] for p in zip(ids, ids[1:], strict=False) if p in model.merges), default=None)
        if best is None:
            break
        out, i = [], 0
        while i < len(ids):
            pair = i + 1 < len(ids) and model.merges.get((ids[i], ids[i + 1])) == best
            out.append(best if pair else ids[i])
            i += 1 + pair
        ids = out
    return tuple(ids)


def test_encoder_by_heap_equals_the_plain_one():
    import pickle

    rng = random.Random(3)
    merges, known = [], list(b"abc")
    for rank in range(60):
        pair = rng.choice(known), rng.choice(known)
        if pair not in {m[1:3] for m in merges}:
            merges.append((rank, *pair, 256 + len(merges)))
            known.append(255 + len(merges))
    model = BytePairs(merges)
    for _ in range(500):
        word = "".join(rng.choice("aaabc") for _ in range(rng.randint(1, 40)))
        assert model._part(word) == plain_part(model, word), word
    assert pickle.loads(pickle.dumps(model))._known == {} and model.decode(model.encode("aab cab" * 50)) == "aab cab" * 50
    assert len(model._part("ab" * 20_000)) >= 1
