"""Training windows over the stream of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.sampling import hash_uniform
from textloom.operators import token_stream as TS
from textloom.sources.tables import table

BLOCK = 64


def stream_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each document begins in the stream, and the bucket pieces that it is cut into."""
    stream = TS.Stream(table(spark, d, "documents"))
    return stream.rows.select(F.col("id").alias("doc_id"), "offset", "n")


def _batch(spark: SparkSession, d: str, which: int) -> DataFrame:
    docs = table(spark, d, "documents")
    stream, characters = TS.Stream(docs), TS.character_table(docs)
    draws = docs.select(F.col("doc_id").alias("draw"))
    rows = stream.batch(draws, hash_uniform(11 + which, "draw"), BLOCK, stream.split()[which])
    ids = lambda c: F.md5(F.array_join(TS.encode(F.col(c), characters), " "))
    back = TS.decode(TS.encode(F.col("x"), characters), characters) == F.col("x")
    return rows.select("draw", "start", ids("x").alias("x"), ids("y").alias("y"), back.alias("same"))


def stream_batch_train(spark: SparkSession, d: str) -> DataFrame:
    """A window of the first nine tenths of the stream for each document, with its shifted target, as ids of characters."""
    return _batch(spark, d, 0)


def stream_batch_held_out(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d, 1)


def _sql(which: int) -> str:
    part = "0 AS b, floor(0.9 * length(s))::BIGINT AS n" if which == 0 else "floor(0.9 * length(s))::BIGINT AS b, length(s) - floor(0.9 * length(s))::BIGINT AS n"
    return f"""WITH s AS MATERIALIZED (SELECT string_agg(text, '' ORDER BY doc_id) AS s FROM documents WHERE text <> ''), v AS MATERIALIZED (SELECT list(c ORDER BY c) AS v FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''),
    p AS (SELECT {part} FROM s), w AS (SELECT doc_id AS draw, b + floor(('0x' || md5(concat_ws('|', doc_id, {11 + which}))[1:8])::BIGINT / 4294967296.0 * (n - {BLOCK} - 1))::BIGINT AS start FROM documents, p),
    x AS (SELECT draw, start, substring(s, start + 1, {BLOCK}) AS x, substring(s, start + 2, {BLOCK}) AS y FROM w, s)
    SELECT draw, start, md5(array_to_string(list_transform(string_split(x, ''), lambda c: list_position(v, c) - 1), ' ')) AS x, md5(array_to_string(list_transform(string_split(y, ''), lambda c: list_position(v, c) - 1), ' ')) AS y, true AS same FROM x, v"""


QUERIES = {
    "stream_offsets": (stream_offsets, "SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset, length(text) AS n FROM documents WHERE length(text) > 0"),
    "stream_batch_train": (stream_batch_train, _sql(0)),
    "stream_batch_held_out": (stream_batch_held_out, _sql(1)),
}
