"""Deterministic draws: an order by md5 of id and seed is the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw_key(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in ids], F.lit(str(seed))))


def hash_uniform(seed: int, *ids: str) -> Column:
    """A number from 0 to 1 made of the first 8 hexadecimal digits of the draw key."""
    return F.conv(F.substring(draw_key(seed, *ids), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_rows(rows: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    return rows.orderBy(draw_key(seed, *ids), *ids).limit(n)


def sample_per(rows: DataFrame, group: str, n: int, seed: int, *ids: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(draw_key(seed, group, *ids), *ids))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def split_rows(rows: DataFrame, share: float, seed: int, *ids: str) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts; a row's part depends on its ids only."""
    u = hash_uniform(seed, *ids)
    return rows.where(u < share), rows.where(u >= share)
