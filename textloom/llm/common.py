"""Shared helpers: tables, shared scratch folder, partition counts."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; in a local session without one, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/textloom/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: later steps start from the file.

    The files survive a lost executor. They stay until the scratch folder is emptied.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    # Spark deletes the shuffle files of a finished job when the driver's JVM has collected its plan
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def text_blocks(rows: DataFrame, id_col: str, text_col: str, limit: int) -> tuple[int, Iterator[list]]:
    """The distinct rows with a text as (id, raw bytes), in blocks of about limit bytes; one block at a time is collected."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).where("raw IS NOT NULL").distinct()
    n = -(-(rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // limit)
    return n, (rows.where(F.pmod(F.xxhash64("id", "raw"), F.lit(n)) == k).collect() for k in range(n))


def release() -> None:
    """Give unused memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """run, a generator over batches, with release() at its end: a worker outlives its task, and other stages use it next."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], name: str) -> str:
    """name, or name with underscores added until no column of that name (in any case) is taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
