"""Runs compared on the same questions: one resampling table for all pairs of runs.

A question's, or a cluster's, weights in all draws come from its own digest, so every task resamples its units by
one matrix product and sends one sum a draw and pair. Percentiles of the draws' means are the intervals.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import statistics as S


def wide(scores: DataFrame, runs: list[str], cluster: str | None = None) -> DataFrame:
    """(qid, unit, s): a row a question with the scores of all runs in their order. A run that lacks a question of another is an error.

    scores: (run, qid, score[, cluster]). unit is the cluster, or the question itself.
    """
    unit = F.first(cluster) if cluster else F.first("qid")
    per = scores.where(F.col("run").isin(runs)).groupBy("qid").agg(unit.cast("string").alias("unit"), *[F.max(F.when(F.col("run") == r, F.col("score").cast("double"))).alias(f"s{i}") for i, r in enumerate(runs)])
    whole = [F.when(F.col(f"s{i}").isNull(), F.raise_error(F.concat(F.lit(f"run {r} has no score for "), F.col("qid").cast("string"))).cast("double")).otherwise(F.col(f"s{i}")) for i, r in enumerate(runs)]
    return per.select("qid", "unit", F.array(*whole).alias("s"))


def compare(scores: DataFrame, pairs: list[tuple[str, str]], margin: float, level: float | Column = 0.95, cluster: str | None = None, draws: int = 1000, seed: int = 0) -> DataFrame:
    """A row for each pair (a, b): n, units, mean_a, mean_b, mean_diff of b less a, low, high, wins, losses, ties, mde and reading.

    The interval has the given level; with a cluster column whole clusters are drawn, and the mean of a draw is
    the sum of their sums over the sum of their counts. mde, the least effect to be found, is at the level of
    questions either way. reading is b_better or a_better beside an interval without 0; else tie if both ends are
    within the margin, else inconclusive.
    """
    if not pairs:
        raise ValueError("no pairs")
    runs = list(dict.fromkeys(r for p in pairs for r in p))
    rows = wide(scores, runs, cluster)
    spark = scores.sparkSession
    at = [(runs.index(a), runs.index(b)) for a, b in pairs]
    d = lambda i: F.element_at("s", at[i][1] + 1) - F.element_at("s", at[i][0] + 1)
    units = rows.groupBy("unit").agg(F.count("*").cast("double").alias("n"), *[F.sum(d(i)).alias(f"x{i}") for i in range(len(pairs))])
    names = ["n", *(f"x{i}" for i in range(len(pairs)))]

    sums = S.resampled(units, names, draws, seed, per=4)
    means = sums.where("n > 0").select(*[(F.col(f"x{i}") / F.col("n")).alias(f"m{i}") for i in range(len(pairs))])
    tail = (1 - level) / 2
    ends = means.agg(*[F.percentile(f"m{i}", F.lit(q)).alias(f"{name}{i}") for i in range(len(pairs)) for name, q in (("low", tail), ("high", 1 - tail))])
    z = NormalDist().inv_cdf((1 + level) / 2)
    each = rows.agg(
        F.count("*").alias("n"), F.count_distinct("unit").alias("units"), *[F.avg(F.element_at("s", j + 1)).alias(f"mean{j}") for j in range(len(runs))],
        *[c for i in range(len(pairs)) for c in (F.avg(d(i)).alias(f"diff{i}"), (F.lit(z) * F.stddev_samp(d(i)) / F.sqrt(F.count(d(i)))).alias(f"mde{i}"), F.count_if(d(i) > 0).alias(f"wins{i}"), F.count_if(d(i) < 0).alias(f"losses{i}"), F.count_if(d(i) == 0).alias(f"ties{i}"))],
    )
    one, two = each.first(), ends.first()  # one row each
    out = []
    for i, (a, b) in enumerate(pairs):
        low, high = two[f"low{i}"], two[f"high{i}"]
        out.append((a, b, one["n"], one["units"], one[f"mean{at[i][0]}"], one[f"mean{at[i][1]}"], one[f"diff{i}"], low, high, one[f"wins{i}"], one[f"losses{i}"], one[f"ties{i}"], one[f"mde{i}"], None if low is None else S.interpret(low, high, margin)))
    return spark.createDataFrame(out, "a string, b string, n long, units long, mean_a double, mean_b double, mean_diff double, low double, high double, wins long, losses long, ties long, mde double, reading string")


def size_rule(scores: DataFrame, sizes: dict[int, str], margin: float, cluster: str | None = None, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(size, mean, low, high, best, tied, chosen): the size with the best mean, those whose interval against it holds 0, and the least of these.

    Of equal means the first size is best.
    """
    means = {r["run"]: r["m"] for r in scores.where(F.col("run").isin(list(sizes.values()))).groupBy("run").agg(F.avg("score").alias("m")).collect()}
    best = max(sizes, key=lambda s: means[sizes[s]])
    others = [s for s in sizes if s != best]
    found = compare(scores, [(sizes[best], sizes[s]) for s in others], margin, 0.95, cluster, draws, seed).collect() if others else []
    ends = {s: (r["low"], r["high"]) for s, r in zip(others, found, strict=True)}
    tied = {best, *(s for s, (low, high) in ends.items() if low <= 0 <= high)}
    rows = [(s, means[sizes[s]], *ends.get(s, (None, None)), s == best, s in tied, s == min(tied)) for s in sizes]
    return scores.sparkSession.createDataFrame(rows, "size long, mean double, low double, high double, best boolean, tied boolean, chosen boolean")
