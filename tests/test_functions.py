"""Worked cases of scalars, spans, chunkers and statistics."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import jsonx as J
from textloom.functions import spans as S
from textloom.functions import statistics as ST
from textloom.functions import text as T
from textloom.operators import chunking as C
from textloom.operators import metrics as M
from textloom.operators import bpe_training as B
from textloom.operators import vocabulary as V
from textloom.plans import registry


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("The answer, is: An apple!", "answer is apple"), ("", "")])
def test_normalize_answer(spark, text, want):
    assert one(spark, T.normalize_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("$1,234.50", 1234.5), ("about 3/4 of", 0.75), ("-1/2", -1.0), ("7/0", None), ("none", None), ("12.", 12.0)])
def test_numbers(spark, text, want):
    assert one(spark, T.normalize_number(F.col("t")), t=text) == want


def test_last_tag_wins(spark):
    assert one(spark, T.extract_tag(F.col("t"), "answer"), t="<answer>1</answer> <ANSWER>\n2</ANSWER>") == "\n2"
    assert one(spark, T.extract_tag(F.col("t"), "answer"), t="none") is None


def test_token_f1(spark):
    assert one(spark, T.token_f1(F.col("a"), F.col("b")), a="red red fox", b="red fox fox") == pytest.approx(2 / 3)
    assert one(spark, T.token_f1(F.col("a"), F.col("b")), a="the", b="fox") == 0


def test_token_f1_of_long_texts_and_whole_turns(spark):
    rng = random.Random(2)
    pairs = [tuple(" ".join(rng.choice(["ox", "elk", "cow", "yak", "x 1", "x"]) for _ in range(rng.choice([0, 1, 30, 400]))) for _ in "ab") for _ in range(60)]

    def f1(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return 2 * (a & b).total() / (a.total() + b.total()) if a or b else 0

    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", T.token_f1(F.col("a"), F.col("b")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in rows] == pytest.approx([f1(*p) for p in pairs])


def test_answers_are_compared_beyond_a_prefix(spark, tmp_path):
    same = "same words " * 20
    spark.createDataFrame([(1, 0, "user", same + "red fox"), (1, 1, "assistant", same + "grey owl")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, same + x) for i, x in enumerate(("red", "grey"))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in registry.queries()["answer_f1"](spark, str(tmp_path)).collect()] == [(1, 1, pytest.approx(40 / 42, abs=1e-6), False)]
    assert registry.queries()["normalize_answers"](spark, str(tmp_path)).select("key").distinct().count() == 2



def test_dates(spark):
    for text, want in (("July 4, 2020 [EBook #1]", "2020-07-04"), ("4 July 2020", "2020-07-04"), ("July 2020", "2020-07"), ("soon", None)):
        assert one(spark, T.parse_date(F.col("t")), t=text) == want


def test_ngrams_guard(spark):
    assert one(spark, T.ngrams(F.split("t", " "), 3), t="a b") == []
    assert one(spark, T.ngrams(F.split("t", " "), 2), t="a b a b") == ["a b", "b a"]


def test_json_repairs(spark):
    r = one(spark, J.repaired(F.col("t")), t='```json\n{"a": [1,],}\n```')
    assert r["ok"] and r["rules"] == ["strip_fences", "trailing_comma_removal"]
    assert one(spark, J.repaired(F.col("t"), F.col("s")), t="{}", s="length")["stage"] == "truncated"
    assert not one(spark, J.repaired(F.col("t")), t="{'a': 1}")["ok"]


def test_merge_and_as_of(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 2, 4), (1, 10, 12), (1, 20, 25)], "k int, start int, stop int")
    assert sorted((r["start"], r["stop"]) for r in S.merge(rows, "k").collect()) == [(0, 12), (20, 25)]
    left = spark.createDataFrame([(1, 5), (1, 0)], "k int, pos long")
    right = spark.createDataFrame([(1, 3, "a"), (1, 5, "b")], "k int, since long, title string")
    assert {r["pos"]: r["title"] for r in S.as_of(left, right, "k", "pos", "since", "title").collect()} == {5: "b", 0: None}


def test_sentence_packing_keeps_budget_and_overlap():
    text = "One two three. Four five. Six seven eight nine. Ten."
    spans = C.pack_sentences(text, 5, 1)
    assert [text[a:b] for a, b in spans] == ["One two three. Four five.", "Six seven eight nine. Ten."]
    text = "a b c d e f g."
    assert [text[a:b] for a, b in C.pack_sentences(text, 3)] == ["a b c", "d e f", "g."]


def test_recursive_chunks_cover_all_words():
    text = "a b c d\n\ne f\ng h i j k l m\n\nn"
    got = " ".join(text[a:b] for a, b in C.recursive(text, 4)).split()
    assert got == text.split()
    assert all(C.count(text[a:b]) <= 4 for a, b in C.recursive(text, 4))


def test_semantic_cut():
    text = "red fox ran. red fox ran. blue sea sky. blue sea sky."
    s = C.sentences(text)
    assert [text[a:b] for a, b in C.semantic(text, C.gap_distances(text, s), s, 0.5, 10)] == ["red fox ran. red fox ran.", "blue sea sky. blue sea sky."]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "qid long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 8, 1), (1, 5, 2), (2, 1, 1)], "qid long, doc_id long, rel int")
    got = {r["qid"]: r for r in M.per_query(run, qrels, 3).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["rr"] == 0.5 and got[1]["precision"] == pytest.approx(1 / 3, abs=1e-6)
    assert got[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / (2 + 1 / math.log2(3)), abs=1e-6)
    assert got[2]["recall"] == 0 and got[2]["ndcg"] == 0


def test_sign_test(spark):
    assert ST.sign_test(3, 9) == pytest.approx(0.146, abs=1e-3)
    assert one(spark, ST.sign_test_column(F.col("b"), F.col("c")), b=3, c=9) == pytest.approx(ST.sign_test(3, 9))
    assert ST.sign_test(0, 0) == 1
    # more pairs than 0.5 to their power can say
    for b, c in ((600, 700), (1000, 900)):
        assert one(spark, ST.sign_test_column(F.col("b"), F.col("c")), b=b, c=c) == pytest.approx(ST.sign_test(b, c), rel=1e-6)
    assert ST.interpret(-0.01, 0.01, 0.02) == "tie" and ST.interpret(0.1, 0.2, 0) == "b_better"


def test_byte_pairs(spark):
    docs = spark.createDataFrame([(1, "aaabdaaabac aaab")], "doc_id long, text string")
    merges = B.train(docs, 3)
    assert merges[0] == (0, 97, 97, 256) and len(merges) == 3
    assert one(spark, V.merge_pair(F.col("s"), 97, 97, 256), s=[97, 97, 97, 98]) == [256, 97, 98]


@pytest.mark.parametrize("n", [0, 4])
def test_ngram_floor_of_another_n_is_an_error(spark, n):
    with pytest.raises(ValueError):
        V.ngram_floor(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string"), n)


def test_ngram_floor_of_a_small_text(spark):
    # 9 of 10 characters train: aab twice and aaa; the last, b, is held out; two characters are known
    docs = spark.createDataFrame([(1, "aabaabaaab"), (2, None), (3, "")], "doc_id long, text string")
    assert V.ngram_floor(docs, 1).first()["nats"] == pytest.approx(-math.log(3 / 11), abs=1e-6)
