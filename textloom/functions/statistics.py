"""Statistics over tables: entropy, exact sign test, bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_test(b: int, c: int) -> float:
    """Exact two-sided p of b against c discordant pairs; 1 without any."""
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(max(b, c), n + 1)) / 2**n)


def _upper_tail(n: Column, least: Column) -> Column:
    """Sum of C(n, i) / 2^n for i from least, at least n / 2, to n.

    Terms run in logarithms and fall ever faster; those farther than ten roots of n beyond least add nothing
    that a double can hold, so a row's array has no more than that many.
    """
    n, least = n.cast("long"), least.cast("long")
    first = _log_gamma(n + 1) - _log_gamma(least + 1) - _log_gamma(n - least + 1) + n * F.lit(math.log(0.5))
    start = F.struct(first.alias("t"), F.lit(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        ratio = F.when(i < n, F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).otherwise(0.0)
        return F.struct((acc["t"] + ratio).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s"))

    last = F.least(n, least + F.ceil(10 * F.sqrt(n.cast("double"))) + 50)
    return F.aggregate(F.sequence(least, last), start, step)["s"]


def _log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x from 1, by Stirling's series eight steps up."""
    x = x.cast("double")
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - sum((F.log(x + i) for i in range(1, 8)), F.log(x))


def sign_test_column(b: Column, c: Column) -> Column:
    """sign_test in an expression."""
    n = b + c
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * _upper_tail(n, F.greatest(b, c))))


def one_sided_tail(b: Column, c: Column) -> Column:
    """The chance of at least as many as the larger of b and c among b + c fair draws; 1 without any."""
    return F.when(b + c == 0, 1.0).otherwise(F.least(F.lit(1.0), _upper_tail(b + c, F.greatest(b, c))))


def noise_margin(p: Column, n: Column) -> Column:
    """Two standard errors of a share."""
    return 2 * F.sqrt(p * (1 - p) / n)


def bonferroni_level(m: int, alpha: float = 0.05) -> float:
    if m < 1:
        raise ValueError("m must be 1 or more")
    return 1 - alpha / m


def min_detectable_effect(d: Column, level: float = 0.95) -> Column:
    """Aggregate: z times the standard error of the mean of paired differences."""
    return F.lit(NormalDist().inv_cdf(1 - (1 - level) / 2)) * F.stddev_samp(d) / F.sqrt(F.count(d))


def weights(units: list[str], draws: int, seed: int = 0, per: int = 1) -> np.ndarray:
    """Poisson(1) weights, a row a unit: draw i takes four bytes of the digest of unit, i div per and seed; per is from 1 to 4."""
    need = -(-draws // per)
    raw = b"".join(hashlib.md5(f"{u}|{j}|{seed}".encode()).digest()[: 4 * per] for u in units for j in range(need))
    u = np.frombuffer(raw, ">u4").reshape(len(units), per * need)[:, :draws] / 4294967296.0
    ends = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return np.searchsorted(ends, u, side="right").astype(float)


def resampled(units: DataFrame, names: list[str], draws: int, seed: int = 0, per: int = 1) -> DataFrame:
    """(draw, names): sums of the named columns of units (unit string, ..) under each draw's weights.

    A task weighs its units by a matrix product and sends one row a draw.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(names)))
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                total += weights(part.column("unit").to_pylist(), draws, seed, per).T @ np.column_stack([np.asarray(part.column(c)) for c in names])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *(pa.array(total[:, i]) for i in range(len(names)))], names=["draw", *names])

    return units.select("unit", *names).mapInArrow(run, "draw long, " + ", ".join(f"{c} double" for c in names)).groupBy("draw").agg(*[F.sum(c).alias(c) for c in names])


def _interval(units: DataFrame, draws: int, seed: int, level: float) -> DataFrame:
    """(low, high) of the draws' means of units (unit, x, n)."""
    tail = (1 - level) / 2
    means = resampled(units, ["x", "n"], draws, seed).where("n > 0").select((F.col("x") / F.col("n")).alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(tail)), 6).alias("low"), F.round(F.percentile("m", F.lit(1 - tail)), 6).alias("high"))


def cluster_bootstrap(rows: DataFrame, value: str, cluster: str, draws: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """As bootstrap, but whole clusters are drawn: the sum of their sums over the sum of their counts."""
    each = rows.groupBy(F.col(cluster).cast("string").alias("unit")).agg(F.sum(F.col(value).cast("double")).alias("x"), F.count(value).cast("double").alias("n"))
    return _interval(each, draws, seed, level).crossJoin(each.agg(F.round(F.sum("x") / F.sum("n"), 6).alias("mean"), F.count("*").alias("clusters")))


def entropy(p: Column) -> Column:
    return -F.sum(p * F.log(F.greatest(p, F.lit(1e-12))))


def bootstrap(rows: DataFrame, value: str, id_col: str, draws: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(mean, low, high): percentile interval of the mean of value under resampling with Poisson(1) weights by hash.

    Every row weighs itself in each draw, so no row number and no shuffle of the rows is needed.
    """
    each = rows.select(F.col(id_col).cast("string").alias("unit"), F.col(value).cast("double").alias("x"), F.lit(1.0).alias("n"))
    return _interval(each, draws, seed, level).crossJoin(rows.agg(F.round(F.avg(value), 6).alias("mean")))


def interpret(low: float, high: float, margin: float) -> str:
    if low <= 0 <= high:
        return "tie" if max(abs(low), abs(high)) <= margin else "inconclusive"
    return "b_better" if low > 0 else "a_better"
