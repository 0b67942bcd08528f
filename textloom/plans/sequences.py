"""Order-dependent and numeric queries: moving averages, islands, carry-forward, multisets, schedules, encodings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.sources.tables import table


def smooth(spark: SparkSession, d: str) -> DataFrame:
    """Trailing mean of 25 values of each user's events."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-24, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


def label_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal event types of a user, as tag runs are grouped to entities."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id").withColumn("new", F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(w)), 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase's value at each event of a user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    kept = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)
    return table(spark, d, "events").select("event_id", F.round(kept, 6).alias("value"))


def multiset_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared words of a document and its benchmark namesake (doc_id modulo their number), as multisets."""
    words = lambda t: F.explode(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)))
    a = table(spark, d, "documents").select("doc_id", words("text").alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("x"))
    b = table(spark, d, "benchmark").select("item_id", words("text").alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("y"))
    items = table(spark, d, "benchmark").count()
    both = a.join(b, (F.col("doc_id") % items == F.col("item_id")) & (a["w"] == b["w"]))
    return both.groupBy("doc_id").agg(F.sum(F.least("x", "y")).alias("n"))


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    """A rate for each event as a training step: linear warm-up of 100 steps, then cosine decay to 1e-4 at the last event."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("step"))
    last = rows.agg(F.max("step")).first()[0] or 0
    s = F.col("step")
    decay = (s - 100) / float(max(1, last - 100))
    return rows.select("step", F.round(F.when(s < 100, 1e-3 * (s + 1) / 100).otherwise(1e-4 + 0.5 * (1e-3 - 1e-4) * (1 + F.cos(F.lit(math.pi) * decay))), 9).alias("lr"))


def position_encodings(spark: SparkSession, d: str) -> DataFrame:
    """Sines and cosines of each conversation turn's place, in eight frequencies."""
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("i"))
    angle = F.col("pos") * F.pow(F.lit(10000.0), -2 * F.col("i") / 16)
    return rows.select("conv_id", "pos", "i", F.round(F.sin(angle), 6).alias("sin"), F.round(F.cos(angle), 6).alias("cos"))


EV = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
QUERIES = {
    "smooth": (smooth, "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 24 PRECEDING), 6) AS mean FROM events"),
    "label_islands": (
        label_islands,
        f"""WITH f AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events {EV}),
        r AS (SELECT *, (sum(new) OVER w)::BIGINT AS run FROM f {EV}) SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL""",
    ),
    "carry_forward": (carry_forward, f"SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w, 6) AS value FROM events {EV}"),
    "multiset_overlap": (
        multiset_overlap,
        """WITH a AS (SELECT doc_id, w, count(*) AS x FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY ALL),
        b AS (SELECT item_id, w, count(*) AS y FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) GROUP BY ALL)
        SELECT doc_id, sum(least(x, y))::BIGINT AS n FROM a JOIN b ON a.w = b.w AND doc_id % (SELECT count(*) FROM benchmark) = item_id GROUP BY doc_id""",
    ),
    "lr_schedule": (lr_schedule, "SELECT s AS step, round(CASE WHEN s < 100 THEN 0.001::DOUBLE * (s + 1) / 100 ELSE 0.0001::DOUBLE + 0.5 * 0.0009 * (1 + cos(pi() * (s - 100) / greatest(1, last - 100)::DOUBLE)) END::DOUBLE, 9) AS lr FROM (SELECT event_id AS s, max(event_id) OVER () AS last FROM events)"),
    "position_encodings": (position_encodings, "SELECT conv_id, turn AS pos, i, round(sin(turn * pow(10000.0, -2 * i / 16)), 6) AS sin, round(cos(turn * pow(10000.0, -2 * i / 16)), 6) AS cos FROM conversations, range(8) q(i)"),
}
