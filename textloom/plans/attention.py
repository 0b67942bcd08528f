"""Attention and model maths over sequences of 16 vectors (vec_id div 16), each a head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import attention as A
from textloom.sources.tables import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.expr("vec_id DIV 16").alias("seq"), F.expr("vec_id % 16").alias("t"), v.alias("v"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).withColumnRenamed("seq", "head")
    return A.softmax(A.causal_scores(e, e, "head", 8.0), "head")


def attention_output(spark: SparkSession, d: str) -> DataFrame:
    """The causal attention of each sequence to itself, without keys 3, which are padding."""
    e = _vectors(spark, d).withColumnRenamed("seq", "head")
    padding = e.where("t = 3").select("head", F.col("t").alias("k"))
    w = A.softmax(A.causal_scores(e, e, "head", 8.0, padding=padding), "head")
    out = A.attend(w, e, "head")
    return out.select("head", "q", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def attention_heads(spark: SparkSession, d: str) -> DataFrame:
    """Self-attention of two heads of half the components, merged again: the norm of each output."""
    parts = A.split_heads(_vectors(spark, d), 2)
    parts = parts.withColumn("head", F.col("seq") * 2 + F.col("head"))
    out = A.attend(A.softmax(A.causal_scores(parts, parts, "head", 32**0.5), "head"), parts, "head")
    rows = out.groupBy("head", "q").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda y: y["x"]).alias("v"))
    whole = A.merge_heads(rows.withColumn("seq", F.floor(F.col("head") / 2)), "seq", "q")
    return whole.select("seq", "q", F.size("v").cast("long").alias("d"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


def attention_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Normalised row entropies, by sequence."""
    return A.normalized_entropy(_weights(spark, d), "head").groupBy("head").agg(F.round(F.avg("h"), 6).alias("entropy"), F.count("*").alias("rows"))


def attention_received(spark: SparkSession, d: str) -> DataFrame:
    out = A.received(_weights(spark, d), "head")
    return out.select("head", "k", F.round("received", 6).alias("received"))


def attention_rollout(spark: SparkSession, d: str) -> DataFrame:
    """Three sequences of 16 after another as the layers of one stack, all stacks rolled out; the last may have fewer and gives nothing."""
    layers = _weights(spark, d).select(F.expr("head DIV 3").alias("stack"), (F.col("head") % 3).alias("layer"), F.lit(0).alias("head"), "q", "k", "w")
    return A.rollout(layers, 3).select("stack", "q", "k", F.round("w", 6).alias("w"))


def activations(spark: SparkSession, d: str) -> DataFrame:
    """GELU and sigmoid of values, and the skip-gram loss of a value against two noise scores."""
    x = (F.col("value") - 25) / 10
    return table(spark, d, "events").select("event_id", F.round(A.gelu(x), 6).alias("gelu"), F.round(A.sigmoid(x), 6).alias("sigmoid"), F.round(A.pair_loss(x, F.array(x / 2, -x)), 6).alias("loss"))


def next_token_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of each user's five best events as tokens, at temperature 0.8, and the loss of the best."""
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("token"), (F.col("value") / 10).alias("s"))
    return A.next_token_shares(rows, "user_id", 0.8, 5).select("user_id", "token", F.round("p", 6).alias("p"), F.round(-F.log("p"), 6).alias("loss"))


W = """e AS (SELECT vec_id // 16 AS head, vec_id % 16 AS t, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.head, a.t AS q, b.t AS k, exp(list_inner_product(a.v, b.v) / 8) AS x FROM e a JOIN e b ON a.head = b.head AND b.t <= a.t),
w AS (SELECT *, x / sum(x) OVER (PARTITION BY head, q) AS w FROM s)"""
QUERIES = {
    "attention_output": (
        attention_output,
        """WITH e AS (SELECT vec_id // 16 AS head, vec_id % 16 AS t, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.head, a.t AS q, b.v, exp(list_inner_product(a.v, b.v) / 8) AS x FROM e a JOIN e b ON a.head = b.head AND b.t <= a.t AND b.t <> 3),
        w AS (SELECT *, x / sum(x) OVER (PARTITION BY head, q) AS w FROM s) SELECT head, q, pos, round(sum(w * v[pos + 1]), 6) AS x FROM w, unnest(range(64)) AS u(pos) GROUP BY head, q, pos""",
    ),
    "attention_heads": (
        attention_heads,
        """WITH e AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS t, h, embedding[h * 32 + 1 : h * 32 + 32]::DOUBLE[] AS v FROM embeddings, unnest([0, 1]) AS u(h)),
        s AS (SELECT a.seq, a.h, a.t AS q, b.v, exp(list_inner_product(a.v, b.v) / sqrt(32)) AS x FROM e a JOIN e b ON a.seq = b.seq AND a.h = b.h AND b.t <= a.t), w AS (SELECT *, x / sum(x) OVER (PARTITION BY seq, h, q) AS w FROM s),
        o AS (SELECT seq, q, h, pos, sum(w * v[pos + 1]) AS x FROM w, unnest(range(32)) AS u(pos) GROUP BY seq, q, h, pos) SELECT seq, q, count(*) AS d, round(sqrt(sum(x * x)), 6) AS norm FROM o GROUP BY seq, q""",
    ),
    "attention_entropy": (attention_entropy, f"WITH {W}, r AS (SELECT head, q, -sum(w * ln(w)) / ln(q + 1) AS h FROM w WHERE q > 0 GROUP BY head, q) SELECT head, round(avg(h), 6) AS entropy, count(*) AS rows FROM r GROUP BY head"),
    "attention_received": (attention_received, f"WITH {W}, n AS (SELECT head, max(q) + 1 AS n FROM w GROUP BY head) SELECT head, k, round(sum(w) / (any_value(n) - k), 6) AS received FROM w JOIN n USING (head) GROUP BY head, k"),
    "attention_rollout": (
        attention_rollout,
        f"""WITH {W}, a AS (SELECT head, q, k, (w / 2 + CASE WHEN q = k THEN 0.5 ELSE 0 END) AS w FROM w), n AS (SELECT head, q, k, w / sum(w) OVER (PARTITION BY head, q) AS w FROM a),
        r AS (SELECT y.head // 3 AS stack, y.q, x.k, sum(x.w * y.w) AS w FROM n y JOIN n x ON y.head % 3 = 1 AND x.head = y.head - 1 AND y.k = x.q GROUP BY ALL)
        SELECT r.stack, z.q, r.k, round(sum(z.w * r.w), 6) AS w FROM n z JOIN r ON z.head = 3 * r.stack + 2 AND z.k = r.q GROUP BY r.stack, z.q, r.k""",
    ),
    "activations": (
        activations,
        """WITH x AS (SELECT event_id, (value - 25) / 10 AS x FROM events)
        SELECT event_id, round(x / 2 * (1 + (1 - 2 / (exp(2 * 0.7978845608028654::DOUBLE * (x + 0.044715 * x * x * x)) + 1))), 6) AS gelu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(2 * ln(1 + exp(-x)) + ln(1 + exp(x / 2)), 6) AS loss FROM x""",
    ),
    "next_token_shares": (
        next_token_shares,
        """WITH t AS (SELECT user_id, event_id AS token, value / 10 AS s FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value / 10 DESC, event_id) <= 5),
        p AS (SELECT user_id, token, exp(s / 0.8) / sum(exp(s / 0.8)) OVER (PARTITION BY user_id) AS p FROM t) SELECT user_id, token, round(p, 6) AS p, round(-ln(p), 6) AS loss FROM p""",
    ),
}
