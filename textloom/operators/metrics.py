"""Ranked-retrieval metrics over long tables run (qid, doc_id, rank) and qrels (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, k: int, gain: str = "linear", denominator: str = "k") -> DataFrame:
    """(qid, recall, precision, rr, ndcg) at k of every judged query; one that the run lacks has zeros.

    gain is linear (rel) or exponential (2^rel - 1); precision divides by k or by what was retrieved.
    """
    if k < 1 or gain not in ("linear", "exponential") or denominator not in ("k", "retrieved"):
        raise ValueError("k is at least 1, gain linear or exponential, denominator k or retrieved")
    value = F.col("rel").cast("double") if gain == "linear" else F.pow(F.lit(2.0), F.col("rel")) - 1
    gold = qrels.where("rel > 0").withColumn("gain", value)
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("gain"), "doc_id"))
    ideal = gold.withColumn("i", place).groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1))).alias("ideal"))
    top = run.where(F.col("rank") <= k)
    hits = top.join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    got = top.groupBy("qid").agg(F.count("*").alias("retrieved"))
    rows = ideal.join(hits, "qid", "left").join(got, "qid", "left")
    h, bottom = F.coalesce("h", F.lit(0)), F.lit(k) if denominator == "k" else F.greatest(F.coalesce("retrieved", F.lit(0)), F.lit(1))
    return rows.select("qid", F.round(h / F.col("n"), 6).alias("recall"), F.round(h / bottom, 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))


def auc(rows: DataFrame, by: str) -> DataFrame:
    """(by, auc) from (by, score, relevant): the rank-sum form of P(relevant > other) + P(tie) / 2.

    Equal scores are counted first, then a running sum over distinct scores: no pairs are formed.
    """
    return auc_of_counts(rows.groupBy(by, "score").agg(F.sum(F.col("relevant").cast("long")).alias("r"), F.sum((~F.col("relevant")).cast("long")).alias("o")), by)


def auc_of_counts(per: DataFrame, by: str) -> DataFrame:
    """auc from (by, score, r, o): how many relevant and other rows have each score."""
    below = F.sum("o").over(W.partitionBy(by).orderBy("score").rowsBetween(W.unboundedPreceding, -1))
    parts = per.withColumn("below", F.coalesce(below, F.lit(0)))
    out = parts.groupBy(by).agg(F.sum(F.col("r") * (F.col("below") + F.col("o") / 2)).alias("u"), F.sum("r").alias("nr"), F.sum("o").alias("no"))
    return out.where("nr > 0 AND no > 0").select(by, F.round(F.col("u") / (F.col("nr") * F.col("no")), 6).alias("auc"))
