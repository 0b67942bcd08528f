"""Attention over long tables: (head, q, k, s) scores, (head, q, k, w) weights, and (head, t, v) vectors.

A head is one sequence, so its rows are bounded by the square of a sequence's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.vector import dot


def causal_scores(queries: DataFrame, keys: DataFrame, head: str, scale: float, offset: int = 0, causal: bool = True, padding: DataFrame | None = None) -> DataFrame:
    """(head, q, k, s): scaled inner products of (head, t, v) rows where k <= q + offset; keys that padding (head, k) lists are masked."""
    q, k = queries.select(head, F.col("t").alias("q"), F.col("v").alias("vq")), keys.select(head, F.col("t").alias("k"), F.col("v").alias("vk"))
    both = q.join(k, head)
    both = both.where(F.col("k") <= F.col("q") + offset) if causal else both
    both = both if padding is None else both.join(padding.select(head, "k"), [head, "k"], "left_anti")
    return both.select(head, "q", "k", (dot("vq", "vk") / F.lit(float(scale))).alias("s"))


def softmax(scores: DataFrame, head: str) -> DataFrame:
    """(head, q, k, w): the weights of each query, from scores less their maximum."""
    row = W.partitionBy(head, "q")
    x = scores.withColumn("x", F.exp(F.col("s") - F.max("s").over(row)))
    return x.select(head, "q", "k", (F.col("x") / F.sum("x").over(row)).alias("w"))


def attend(weights: DataFrame, values: DataFrame, head: str) -> DataFrame:
    """(head, q, pos, x): weighted sums of (head, t, v), a row a component."""
    v = values.select(head, F.col("t").alias("k"), F.posexplode("v").alias("pos", "y"))
    return weights.join(v, [head, "k"]).groupBy(head, "q", "pos").agg(F.sum(F.col("w") * F.col("y")).alias("x"))


def split_heads(rows: DataFrame, heads: int) -> DataFrame:
    """(seq, t, v) to (seq, head, t, v): equal slices of v; a length that heads don't divide raises an error."""
    n = F.size("v")
    part = F.when(n % heads == 0, n / heads).otherwise(F.raise_error(F.lit(f"{heads} heads don't divide the vector"))).cast("int")
    return rows.select(*[c for c in rows.columns if c != "v"], F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice("v", h * part + 1, part))).alias("head", "v"))


def merge_heads(rows: DataFrame, *keys: str) -> DataFrame:
    """The inverse of split_heads: (keys, v)."""
    return rows.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("head", "v"))), lambda x: x["v"])).alias("v"))


def row_entropy(w: Column) -> Column:
    """Aggregate: the entropy of a row of weights in nats."""
    return -F.sum(w * F.log(F.greatest(w, F.lit(1e-12))))


def normalized_entropy(weights: DataFrame, head: str, causal: bool = True) -> DataFrame:
    """(head, q, h): a row's entropy over the logarithm of how many keys it may see; rows with one key have none."""
    seen = F.col("q") + 1 if causal else F.count("*").over(W.partitionBy(head, "q"))
    rows = weights.withColumn("seen", seen).groupBy(head, "q").agg(row_entropy(F.col("w")).alias("e"), F.max("seen").alias("seen"))
    return rows.where("seen > 1").select(head, "q", (F.col("e") / F.log("seen")).alias("h"))


def received(weights: DataFrame, head: str, causal: bool = True) -> DataFrame:
    """(head, k, received): the mean weight that a key gets from the queries that can see it."""
    last = F.max(F.col("q")).over(W.partitionBy(head))
    rows = weights.withColumn("n", last + 1).groupBy(head, "k").agg(F.sum("w").alias("s"), F.max("n").alias("n"))
    return rows.select(head, "k", (F.col("s") / (F.col("n") - F.col("k") if causal else F.col("n"))).alias("received"))


def uniform_received(n: int) -> list[float]:
    """What received gives for each of n keys if every query spreads its weight evenly over the keys that it can see."""
    tail, out = 0.0, []
    for q in range(n - 1, -1, -1):
        tail += 1 / (q + 1)
        out.append(tail / (n - q))
    return out[::-1]


def rollout(layers: DataFrame, n_layers: int, add_identity: bool = True, by: str = "stack") -> DataFrame:
    """(by, q, k, w) from (by, layer, head, q, k, w): heads averaged, half the identity added, rows normalised, layers of a stack multiplied."""
    a = layers.groupBy(by, "layer", "q", "k").agg(F.avg("w").alias("w"))
    if add_identity:
        same = a.select(by, "layer", "q").distinct().select(by, "layer", "q", F.col("q").alias("k"), F.lit(0.5).alias("w"))
        a = a.withColumn("w", F.col("w") / 2).unionByName(same).groupBy(by, "layer", "q", "k").agg(F.sum("w").alias("w"))
    a = a.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy(by, "layer", "q")))
    out = a.where("layer = 0").select(by, "q", "k", "w")
    for n in range(1, n_layers):
        step = a.where(F.col("layer") == n).select(by, "q", F.col("k").alias("via"), F.col("w").alias("x"))
        out = step.join(out.select(by, F.col("q").alias("via"), "k", "w"), [by, "via"]).groupBy(by, "q", "k").agg(F.sum(F.col("x") * F.col("w")).alias("w"))
    return out


def summary(weights: DataFrame, head: str) -> DataFrame:
    """(head, mean_entropy, prev_token, self_score, sink), rounded; the scores leave out the first query where it has no choice."""
    pick = lambda cond: F.round(F.avg(F.when(cond, F.col("w"))), 6)
    q, k = F.col("q"), F.col("k")
    return weights.groupBy(head).agg(
        F.round(row_entropy(F.col("w")) / F.count_distinct("q"), 6).alias("mean_entropy"), pick(k == q - 1).alias("prev_token"), pick((k == q) & (q > 0)).alias("self_score"), pick((k == 0) & (q > 0)).alias("sink"),
    )


def gelu(x: Column) -> Column:
    """The tanh form."""
    return x / 2 * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x)))


def sigmoid(x: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))


def pair_loss(positive: Column, negatives: Column) -> Column:
    """Skip-gram loss of a pair: softplus of the negated positive score and of the negative scores (an array)."""
    softplus = lambda x: F.when(x > 30, x).otherwise(F.log1p(F.exp(x)))
    return softplus(-positive) + F.aggregate(negatives, F.lit(0.0), lambda s, x: s + softplus(x))


def next_token_shares(logits: DataFrame, key: str, temperature: float = 1.0, top_k: int | None = None) -> DataFrame:
    """(key, token, p): softmax of (key, token, s) at a temperature over the top_k largest scores, ties to the smaller token."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("s"), "token"))
    rows = logits if top_k is None else logits.withColumn("rank", rank).where(F.col("rank") <= top_k)
    whole = W.partitionBy(key)
    x = rows.withColumn("x", F.exp((F.col("s") - F.max("s").over(whole)) / temperature))
    return x.select(key, "token", (F.col("x") / F.sum("x").over(whole)).alias("p"))
