"""One stream of characters over all texts in order of their ids, cut into training windows across their borders.

Each text's place in the stream comes from sums over partitions: a partition's own running sum, plus the total of
the partitions before it, of which there is one number each. Texts are cut at the multiples of BUCKET, and a window
is joined with the one or two buckets that it touches, so neither a long text nor the stream is ever in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.vocabulary import checkpointed

BUCKET = 1 << 14


def character_table(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The distinct characters in order of their code points; an id is the place in this list. As many as there are characters at most."""
    rows = docs.select(F.explode(F.array_distinct(F.split(text_col, ""))).alias("c")).where("c <> ''").distinct().collect()
    return sorted(r["c"] for r in rows)


def encode(text: Column, characters: list[str]) -> Column:
    """The ids of a text's characters; one that isn't in the table is an error."""
    known = F.create_map(*[F.lit(x) for i, c in enumerate(characters) for x in (c, i)])
    of = lambda c: F.coalesce(F.try_element_at(known, c), F.raise_error(F.concat(F.lit("no such character: "), c)).cast("int"))
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), of)


def decode(ids: Column, characters: list[str]) -> Column:
    table = F.array(*map(F.lit, characters))
    return F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")


def offsets(rows: DataFrame, order: list[str], length: str) -> DataFrame:
    """rows with offset, the sum of length over the rows before, in order; the rows are written once, in ranges of that order."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(length).alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(length).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("offset", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


class Stream:
    """The characters of docs (doc_id, text) in order of doc_id; null and empty texts add none. Rows with one id stand in order of their text's hash."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0")
        rows = rows.select("id", F.xxhash64("text").alias("tie"), "text", F.length("text").cast("long").alias("n"))
        self.rows = offsets(rows, ["id", "tie"], "n")
        self.length = rows.agg(F.sum("n")).first()[0] or 0

    def pieces(self) -> DataFrame:
        """(bucket, at, piece): the texts cut at the multiples of BUCKET; at is the piece's place in the stream."""
        first, last = F.floor(F.col("offset") / BUCKET), F.floor((F.col("offset") + F.col("n") - 1) / BUCKET)
        cut = self.rows.select("offset", "n", "text", F.explode(F.sequence(first, last)).alias("bucket"))
        start = F.greatest(F.col("offset"), F.col("bucket") * BUCKET)
        stop = F.least(F.col("offset") + F.col("n"), (F.col("bucket") + 1) * BUCKET)
        return cut.select("bucket", start.alias("at"), F.substring("text", (start - F.col("offset") + 1).cast("int"), (stop - start).cast("int")).alias("piece"))

    def slices(self, windows: DataFrame, size: int) -> DataFrame:
        """windows, which have a column start, with slice: size characters of the stream from there; fewer at its end, empty beyond it."""
        rows = windows.withColumn("_row", F.struct(*windows.columns))
        asked = rows.select("_row", "start", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("start") + size - 1) / BUCKET))).alias("bucket"))
        first, stop = F.greatest(F.col("at"), F.col("start")), F.least(F.col("at") + F.length("piece"), F.col("start") + size)
        hits = asked.join(self.pieces(), "bucket").where((F.col("at") < F.col("start") + size) & (F.col("at") + F.length("piece") > F.col("start")))
        parts = hits.select("_row", F.struct(first.alias("at"), F.substring("piece", (first - F.col("at") + 1).cast("int"), (stop - first).cast("int")).alias("part")).alias("x"))
        joined = parts.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("slice"))
        return rows.select("_row").join(joined, "_row", "left").select("_row.*", F.coalesce("slice", F.lit("")).alias("slice"))

    def split(self, share: float = 0.9) -> tuple[tuple[int, int], tuple[int, int]]:
        """(start, length) of the first share of the stream and of the rest."""
        n = int(share * self.length)
        return (0, n), (n, self.length - n)

    def batch(self, draws: DataFrame, u: Column, block: int, part: tuple[int, int] | None = None) -> DataFrame:
        """draws with start, x and y: block characters from a place drawn by u (from 0 to 1) within part, and those one further on.

        A window and its target never pass the part's end. A part of fewer than block + 2 characters is an error.
        """
        at, n = part or (0, self.length)
        if n < block + 2:
            raise ValueError(f"the part has {n} characters, it needs {block + 2}")
        rows = self.slices(draws.withColumn("start", F.floor(u * (n - block - 1)).cast("long") + at), block + 1)
        return rows.withColumn("x", F.substring("slice", 1, block)).withColumn("y", F.substring("slice", 2, block)).drop("slice")
