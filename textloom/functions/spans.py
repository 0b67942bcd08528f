"""Span algebra over long tables (key columns, start, stop) and over arrays of struct(start, stop), half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping and touching spans of a key joined: islands where a start passes every earlier stop."""
    order = W.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > before, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return spans.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, n): characters in both span sets. An equi-join on the key, then the interval condition."""
    x, y = merge(a, key), merge(b, key).select(key, F.col("start").alias("s2"), F.col("stop").alias("e2"))
    both = x.join(y, key).where("start < e2 AND s2 < stop")
    return both.groupBy(key).agg(F.sum(F.least("stop", "e2") - F.greatest("start", "s2")).alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """left with value of the last row of right that starts at or before at, by one union and window."""
    r = right.select(key, F.col(since).alias("_at"), F.struct(F.col(value)).alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_row"))
    rows = left.select(key, F.col(at).alias("_at"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_row"))
    order = W.partitionBy(key).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    return r.unionByName(rows).withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1").select("_row.*", F.col(f"_last.{value}").alias(value))


def merged_array(spans: Column) -> Column:
    """An array's spans joined where they overlap or touch, in order."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(last["stop"] >= x["start"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    kind = "array<struct<start:long,stop:long>>"
    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), step)


def array_length(spans: Column) -> Column:
    """The length of an array of spans that don't overlap."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def array_overlap(a: Column, b: Column) -> Column:
    """The length that two arrays of spans, each without overlaps, have in common."""
    both = lambda x, y: F.greatest(F.lit(0).cast("long"), F.least(x["stop"], y["stop"]) - F.greatest(x["start"], y["start"]))
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.aggregate(b, F.lit(0).cast("long"), lambda m, y: m + both(x, y)))
