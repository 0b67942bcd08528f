"""Sinks: chunk and vector stores, model tables, append logs, keyed caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines with a derived chunk_id."""
    chunks.withColumn("chunk_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))).write.mode("overwrite").json(path)


def load_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_bpe(merges: DataFrame, vocab: DataFrame, path: str) -> None:
    """merges (rank, left, right, id) and vocab (id, bytes) as Parquet."""
    merges.write.mode("overwrite").parquet(f"{path}/merges")
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")


def load_bpe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/merges"), spark.read.parquet(f"{path}/vocab")


def append_log(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def config_id(config: DataFrame, columns: list[str]) -> DataFrame:
    """A ten-digit key of the configuration without its name."""
    return config.withColumn("config_id", F.substring(F.sha1(F.to_json(F.struct(*sorted(columns)))), 1, 10))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Read path if it is there, else make, write and read it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.parquet(path)
    return spark.read.parquet(path)


def check_aligned(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> None:
    """Raise unless both tables have the same keys."""
    a, b = chunks.select(key), vectors.select(key)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError(f"the two tables differ in {key}")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(key, embedding) as Parquet; a null vector or one of another length than the rest raises an error."""
    n = vectors.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.count_if(F.col("embedding").isNull()).alias("c")).first()
    if n["c"] or n["a"] != n["b"]:
        raise ValueError("vectors are missing or differ in length")
    vectors.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, chunks: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """Saved vectors; with chunks, an error unless both have the same keys."""
    vectors = spark.read.parquet(path)
    if chunks is not None:
        check_aligned(chunks, vectors, key)
    return vectors


def embed_with_cache(texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], key: str = "chunk_id") -> DataFrame:
    """The vectors in path if it has those of the keys of texts, else embed(texts), written there. A stale cache raises an error."""
    vectors = cached(texts.sparkSession, path, lambda: embed(texts))
    check_aligned(texts, vectors, key)
    return vectors


def write_summary_row(row: DataFrame, path: str, key: str) -> DataFrame:
    """The summary in path with row in the place of one of the same key; columns that either lacks are null.

    The new table is written beside the old one and read from there by the returned path's newest part.
    """
    spark = row.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []
    if parts:
        old = spark.read.parquet(f"{path}/{parts[-1]}")
        row = old.join(row.select(key), key, "left_anti").unionByName(row, allowMissingColumns=True)
    new = f"{path}/part={len(parts):06d}"
    row.coalesce(1).write.parquet(new)
    return spark.read.parquet(new)
