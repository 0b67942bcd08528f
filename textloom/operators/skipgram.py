"""Skip-gram training with negative samples: sparse gradient steps as joins and sums by word id.

The model is a table (id, w_in, w_out). A batch is a table of centers with their targets, the first of which is the
context and the others noise; n weighs a row that stands for several equal ones. A step joins the rows with
the vectors that they name, sums the gradients by word, and writes the new table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.sampling import hash_uniform
from textloom.functions.vector import dot
from textloom.operators.vocabulary import checkpointed

HEAD = "Embedding Model V1"
#: A model of at most this many components a side is broadcast.
FEW_COMPONENTS = 2_000_000


def initial(ids: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(id, w_in, w_out): w_in by hash, from -0.5 to 0.5 over the width; w_out zeros."""
    places = F.sequence(F.lit(0), F.lit(width - 1))
    rows = ids.select("id", F.explode(places).alias("place")).withColumn("x", (hash_uniform(seed, "id", "place") - 0.5) / width)
    vectors = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("w_in"))
    return vectors.withColumn("w_out", F.transform("w_in", lambda _: F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def scored(model: DataFrame, batch: DataFrame, few: bool = False) -> DataFrame:
    """(center, target, positive, n, u, v, score) for each target of each row of batch (center, targets[, n]). A model of few rows is broadcast."""
    n = F.col("n") if "n" in batch.columns else F.lit(1)
    rows = batch.select("center", n.cast("double").alias("n"), F.posexplode("targets").alias("place", "target")).withColumn("positive", F.col("place") == 0)
    centers, targets = model.select(F.col("id").alias("center"), F.col("w_in").alias("u")), model.select(F.col("id").alias("target"), F.col("w_out").alias("v"))
    rows = rows.join(F.broadcast(centers) if few else centers, "center").join(F.broadcast(targets) if few else targets, "target")
    return rows.withColumn("score", dot("u", "v"))


def loss(rows: DataFrame) -> float | None:
    """The mean loss of a batch's rows as scored gives them; null for an empty batch."""
    s = F.col("score")
    total, n = rows.agg(F.sum(F.col("n") * F.when(F.col("positive"), softplus(-s)).otherwise(softplus(s))), F.sum(F.when(F.col("positive"), F.col("n")))).first()
    return total / n if n else None


def step(model: DataFrame, batch: DataFrame, rate: float, width: int, few: bool = False) -> DataFrame:
    """The model after one step on a batch: each row's gradients, taken at the old vectors, are added up by word. Words of no vector are left out."""
    rows = scored(model, batch, few).withColumn("g", F.col("n") * (sigmoid(F.col("score")) - F.col("positive").cast("double")))
    total = lambda c: F.array(*[F.sum(F.col("g") * F.element_at(c, i + 1)) for i in range(width)])
    to_in = rows.groupBy(F.col("center").alias("id")).agg(total("v").alias("d_in"))
    to_out = rows.groupBy(F.col("target").alias("id")).agg(total("u").alias("d_out"))
    moved = lambda w, d: F.when(F.col(d).isNull(), F.col(w)).otherwise(F.zip_with(w, d, lambda x, y: x - rate * y)).alias(w)
    return model.join(to_in, "id", "left").join(to_out, "id", "left").select("id", moved("w_in", "d_in"), moved("w_out", "d_out"))


def train(model: DataFrame, batches: Iterable[DataFrame], steps: int, rate: float = 0.025, least: float = 0.0001) -> tuple[DataFrame, list[float | None]]:
    """(model, losses): a step for each batch, at a rate that falls in a line from rate towards least over steps. The model is written after each step."""
    width = model.select(F.max(F.size("w_in"))).first()[0] or 0
    losses = []
    model = checkpointed(model)
    few = width * model.count() <= FEW_COMPONENTS
    for k, batch in enumerate(batches):
        losses.append(loss(scored(model, batch, few)))
        model = checkpointed(step(model, batch, rate - (rate - least) * k / steps, width, few))
    return model, losses


def save_vectors(model: DataFrame, path: str) -> None:
    """w_in as text, in order of id: a head line, the number of rows, then the components with commas. A vocabulary's size bounds it, so it is one file."""
    lines = model.select(F.col("id").cast("long").alias("at"), F.array_join(F.transform("w_in", lambda x: x.cast("string")), ",").alias("value"))
    head = model.agg(F.count("*").cast("string").alias("value")).select(F.lit(-1).cast("long").alias("at"), "value")
    first = model.sparkSession.createDataFrame([(-2, HEAD)], "at long, value string")
    first.unionByName(head).unionByName(lines).repartition(1).sortWithinPartitions("at").select("value").write.text(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, w_in) of a file that save_vectors has written; ids are the places of the rows. Another head is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.rtrim("value", F.lit("\n")), "\n").alias("x"))
    good = (F.element_at("x", 1) == HEAD) & (F.try_element_at("x", F.lit(2)).try_cast("long") == F.size("x") - 2)
    rows = whole.select(F.when(F.coalesce(good, F.lit(False)), F.col("x")).otherwise(F.raise_error(F.lit("no vectors of this kind")).cast("array<string>")).alias("x"))
    return rows.select(F.posexplode(F.slice("x", F.lit(3), F.size("x"))).alias("id", "line")).select(F.col("id").cast("long").alias("id"), F.split("line", ",").cast("array<double>").alias("w_in"))
