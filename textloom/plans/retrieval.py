"""Ranked-retrieval queries: a row is relevant to a query if it has the query's label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import metrics as M
from textloom.operators import vector_index as X
from textloom.plans.vectors import SCORED
from textloom.sources.tables import table

K = 10


def _run(spark: SparkSession, d: str) -> DataFrame:
    rows = X.unit_rows(table(spark, d, "embeddings"))
    return X.search(rows.where("vec_id % 100 = 0"), rows, K, others=True).select(F.col("query_id").alias("qid"), F.col("vec_id").alias("doc_id"), "score", "rank")


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    q = X.small(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("l")))
    return rows.join(q, F.col("label") == F.col("l")).where("vec_id <> qid").select("qid", F.col("vec_id").alias("doc_id"), F.lit(1).alias("rel"))


def rank_maxp(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are vectors, documents are vec_id div 4: a document has the score of its best chunk."""
    rows = X.unit_rows(table(spark, d, "embeddings"))

    def run(pairs):
        # a document among the best has its best chunk in a block where it is among the best
        for q, r in pairs:
            order = np.argsort(r["ids"] // 4, kind="stable")
            docs, first = np.unique(r["ids"][order] // 4, return_index=True)
            s = np.maximum.reduceat(np.round(q["u"] @ r["u"].T, 6)[:, order], first, axis=1)
            least = np.partition(s, -5, axis=1)[:, -5] if len(docs) > 5 else np.full(len(s), -np.inf)
            i, j = np.nonzero(s >= least[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q["ids"][i]), pa.array(docs[j]), pa.array(s[i, j])], names=["query_id", "doc_id", "score"])

    found = X.products(rows.where("vec_id % 100 = 0"), rows, run, "query_id long, doc_id long, score double")
    return X.top_k(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), 5, tie="doc_id")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.per_query(_run(spark, d), _qrels(spark, d), K).select("qid", "recall")


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.per_query(_run(spark, d), _qrels(spark, d), K).select("qid", "precision")


def mrr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.per_query(_run(spark, d), _qrels(spark, d), K).select("qid", "rr")


def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.per_query(_run(spark, d), _qrels(spark, d), K).select("qid", "ndcg")


def evaluate_run_left(spark: SparkSession, d: str) -> DataFrame:
    """Means over all judged queries; every third query is taken out of the run and counts as zeros."""
    per = M.per_query(_run(spark, d).where("qid % 3 <> 0"), _qrels(spark, d), K)
    return per.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


def _relevance(spark: SparkSession, d: str) -> DataFrame:
    """(score, r, o): how many pairs of a query with a row of its label, and with other rows, have a score."""
    rows = X.unit_rows(table(spark, d, "embeddings"))
    return X.score_histogram(rows.where("vec_id % 100 = 0"), rows)


def score_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = X.unit_rows(table(spark, d, "embeddings"))
    return X.score_auc(rows.where("vec_id % 100 = 0"), rows).select("query_id", F.round("auc", 6).alias("auc"))


def score_gap(spark: SparkSession, d: str) -> DataFrame:
    n = _relevance(spark, d)
    mean = lambda c: F.sum(F.col("score") * F.col(c)) / F.sum(c)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("score") * F.col("score") * F.col("o")) / F.sum("o") - mean("o") * mean("o")))
    p95 = F.percentile(F.when(F.col("o") > 0, F.col("score")), 0.95, F.greatest("o", F.lit(1)))
    return n.agg(F.round(mean("r"), 6).alias("mean_relevant"), F.round(mean("o"), 6).alias("mean_other"), F.round(mean("r") - mean("o"), 6).alias("gap"), F.round(sd, 6).alias("sd_other"), F.round(p95, 6).alias("p95_other"))


def score_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared mass of the two score histograms, 20 bins from -1 to 1."""
    b = _relevance(spark, d).select("r", "o", F.least(F.lit(19), F.floor((F.col("score") + 1) * 10)).cast("int").alias("bin"))
    n = b.groupBy("bin").agg(F.sum("r").alias("r"), F.sum("o").alias("o"))
    t = n.agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    return n.crossJoin(F.broadcast(t)).agg(F.round(F.sum(F.least(F.col("r") / F.col("tr"), F.col("o") / F.col("to"))), 6).alias("overlap"))


def paired_runs(spark: SparkSession, d: str) -> DataFrame:
    """Wins, losses and ties of the exact run against one re-ranked by hash, per query recall."""
    q = _qrels(spark, d)
    a = M.per_query(_run(spark, d), q, K).select("qid", F.col("recall").alias("a"))
    rows = X.unit_rows(table(spark, d, "embeddings"))
    again = X.best_scores(rows.where("vec_id % 100 = 0"), rows, K, others=True, score=lambda q, r: np.round(q["u"] @ r["u"].T, 6) * 0.5 + (r["ids"] % 7) * 0.1)
    other = X.top_k(again.drop("grp"), K).select(F.col("query_id").alias("qid"), F.col("vec_id").alias("doc_id"), "score", "rank")
    b = M.per_query(other, q, K).select("qid", F.col("recall").alias("b"))
    return a.join(b, "qid").agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


RUN = f"""{SCORED}, run AS (SELECT query_id AS qid, vec_id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
   FROM s WHERE query_id <> vec_id QUALIFY rank <= 10),
 qrels AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d USING (label) WHERE q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
 n AS (SELECT qid, count(*) AS n FROM qrels GROUP BY qid),
 hit AS (SELECT run.qid, rank FROM run JOIN qrels USING (qid, doc_id)),
 ideal AS (SELECT qid, sum(1 / log2(i + 1)) AS ideal FROM (SELECT qid, unnest(range(1, least(n, 10) + 1)) AS i FROM n) GROUP BY qid),
 m AS (SELECT n.qid, round(count(rank) / any_value(n.n), 6) AS recall, round(count(rank) / 10, 6) AS precision, round(coalesce(1 / min(rank), 0), 6) AS rr,
       round(coalesce(sum(1 / log2(rank + 1)), 0) / any_value(ideal), 6) AS ndcg FROM n JOIN ideal USING (qid) LEFT JOIN hit USING (qid) GROUP BY n.qid)"""
REL = f"{SCORED}, r AS (SELECT query_id, score, label = query_label AS relevant FROM s WHERE query_id <> vec_id)"

QUERIES = {
    "rank_maxp": (rank_maxp, f"WITH {SCORED}, b AS (SELECT query_id, vec_id // 4 AS doc_id, max(score) AS score FROM s GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 5"),
    "recall_at_k": (recall_at_k, f"WITH {RUN} SELECT qid, recall FROM m"),
    "precision_at_k": (precision_at_k, f"WITH {RUN} SELECT qid, precision FROM m"),
    "mrr_at_k": (mrr_at_k, f"WITH {RUN} SELECT qid, rr FROM m"),
    "ndcg_at_k": (ndcg_at_k, f"WITH {RUN} SELECT qid, ndcg FROM m"),
    "evaluate_run_left": (
        evaluate_run_left,
        f"WITH {RUN}, z AS (SELECT qid, CASE WHEN qid % 3 <> 0 THEN 1 ELSE 0 END AS k, recall, precision, rr, ndcg FROM m) SELECT count(*) AS n, round(avg(recall * k), 6) AS recall, round(avg(precision * k), 6) AS precision, round(avg(rr * k), 6) AS rr, round(avg(ndcg * k), 6) AS ndcg FROM z",
    ),
    "score_auc": (
        score_auc,
        f"""WITH {REL} SELECT a.query_id, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc
        FROM r a JOIN r b ON a.query_id = b.query_id AND a.relevant AND NOT b.relevant GROUP BY a.query_id""",
    ),
    "score_gap": (
        score_gap,
        f"""WITH {REL} SELECT round(avg(score) FILTER (relevant), 6) AS mean_relevant, round(avg(score) FILTER (NOT relevant), 6) AS mean_other,
        round(avg(score) FILTER (relevant) - avg(score) FILTER (NOT relevant), 6) AS gap, round(stddev_pop(score) FILTER (NOT relevant), 6) AS sd_other,
        round(quantile_cont(score, 0.95) FILTER (NOT relevant), 6) AS p95_other FROM r""",
    ),
    "score_overlap": (
        score_overlap,
        f"""WITH {REL}, b AS (SELECT least(19, floor((score + 1) * 10)) AS bin, count(*) FILTER (relevant) AS r, count(*) FILTER (NOT relevant) AS o FROM r GROUP BY ALL)
        SELECT round(sum(least(r / (SELECT sum(r) FROM b), o / (SELECT sum(o) FROM b))), 6) AS overlap FROM b""",
    ),
    "paired_runs": (
        paired_runs,
        f"""WITH {RUN}, r2 AS (SELECT query_id AS qid, vec_id AS doc_id FROM s WHERE query_id <> vec_id
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score * 0.5::DOUBLE + (vec_id % 7) * 0.1::DOUBLE DESC, vec_id) <= 10),
        m2 AS (SELECT n.qid, round(count(r2.doc_id) / any_value(n.n), 6) AS recall FROM n LEFT JOIN (SELECT r2.* FROM r2 JOIN qrels USING (qid, doc_id)) r2 USING (qid) GROUP BY n.qid)
        SELECT count(*) FILTER (m.recall > m2.recall) AS wins, count(*) FILTER (m.recall < m2.recall) AS losses, count(*) FILTER (m.recall = m2.recall) AS ties FROM m JOIN m2 USING (qid)""",
    ),
}
