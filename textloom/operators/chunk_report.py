"""One report on the chunks of many configurations: sizes, boundaries, overlap, each computed by group in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.functions.answers import mid_word
from textloom.operators.structure import DANGLING

KEY = ["config"]


def _share(hit, of):
    return F.try_divide(F.count_if(hit).cast("double"), F.count_if(of).cast("double"))


def sizes(chunks: DataFrame, budget: int, ceiling: int, floor: int) -> DataFrame:
    """Chunk counts and sizes in tokens; above counts those that two added tokens bring over the ceiling."""
    n = F.col("n_tokens")
    p = lambda q: F.percentile(n, F.lit(q))
    return chunks.groupBy(*KEY).agg(
        F.count("*").cast("double").alias("n"), F.min(n).cast("double").alias("min"), F.max(n).cast("double").alias("max"), F.avg(n).alias("mean"), p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"),
        F.try_divide(F.stddev_pop(n), F.avg(n)).alias("cv"), F.avg(n / budget).alias("fill"), F.avg((n + 2 > ceiling).cast("double")).alias("above"), F.avg((n < floor).cast("double")).alias("below"),
    )


def single_rate(chunks: DataFrame) -> DataFrame:
    """The share of documents, of those that have chunks, with one chunk."""
    return chunks.groupBy(*KEY, "doc_id").agg(F.count("*").alias("c")).groupBy(*KEY).agg(F.avg((F.col("c") == 1).cast("double")).alias("single_chunk_docs"))


def _ordered(chunks: DataFrame) -> DataFrame:
    w = W.partitionBy(*KEY, "doc_id").orderBy("chunk_index")
    return chunks.withColumns({"prev_stop": F.lag("stop").over(w), "next_start": F.lead("start").over(w), "next_stop": F.lead("stop").over(w)})


def boundaries(chunks: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Internal cuts, and the shares that lie on a sentence's end or start, part a word, or begin with a word that points back; null without cuts."""
    word = F.lower(F.regexp_extract("text", r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1))
    rows = _ordered(chunks).withColumn("dangling", word.isin(*DANGLING))
    known = lambda c, hit: spans.select("doc_id", F.col(c), F.lit(True).alias(hit)).distinct()
    rows = rows.join(known("start", "at_start"), ["doc_id", "start"], "left").join(known("stop", "at_stop"), ["doc_id", "stop"], "left")
    inner_start, inner_end = F.col("prev_stop").isNotNull(), F.col("next_start").isNotNull()
    shares = rows.groupBy(*KEY).agg(
        F.count_if(inner_start).cast("double").alias("cuts"), _share(inner_end & F.col("at_stop"), inner_start).alias("end_aligned"),
        _share(inner_start & F.col("at_start"), inner_start).alias("start_aligned"), _share(inner_start & F.col("dangling"), inner_start).alias("dangling"),
    )
    # a text meets the cuts of all configurations once
    cuts = _ordered(chunks).where("next_start IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct(*KEY, "stop")).alias("cut"))
    inside = docs.select("doc_id", "text").join(cuts, "doc_id").select(F.explode(F.filter("cut", lambda c: mid_word(F.col("text"), c["stop"]))).alias("c"))
    parted = inside.groupBy(*[F.col(f"c.{k}").alias(k) for k in KEY]).agg(F.count("*").alias("m"))
    return shares.join(parted, KEY, "left").withColumn("mid_word", F.when(F.col("cuts") > 0, F.coalesce("m", F.lit(0)) / F.col("cuts"))).drop("m")


def overlaps(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Overlap of neighbours in characters, redundancy, and cuts inside a sentence, with the share of them that the next chunk holds whole."""
    rows = _ordered(chunks)
    over = F.when(F.col("prev_stop").isNotNull(), F.greatest(F.lit(0), F.col("prev_stop") - F.col("start")))
    before = F.max("stop").over(W.partitionBy(*KEY, "doc_id").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.col("start")))))
    sums = rows.groupBy(*KEY).agg(F.avg(over).alias("mean_overlap"), F.max(over).cast("double").alias("max_overlap"), F.try_divide(F.sum(F.length("text")).cast("double"), F.sum("fresh").cast("double")).alias("redundancy"))
    ends = spans.select("doc_id", "stop").distinct()
    cut = _ordered(chunks).where("next_start IS NOT NULL").select(*KEY, "doc_id", "stop", "next_start", "next_stop").join(ends, ["doc_id", "stop"], "left_anti").withColumn("inside", F.col("stop") - 1)
    around = S.as_of(cut, spans.select("doc_id", "start", F.struct("start", "stop").alias("sentence")), "doc_id", "inside", "start", "sentence")
    held = (F.col("sentence.stop") > F.col("stop")) & (F.col("next_start") <= F.col("sentence.start")) & (F.col("next_stop") >= F.col("sentence.stop"))
    straddling = around.groupBy(*KEY).agg(F.count("*").cast("double").alias("straddling"), F.avg(F.coalesce(held, F.lit(False)).cast("double")).alias("straddle_protected"))
    return sums.join(straddling, KEY, "left").withColumn("straddling", F.coalesce("straddling", F.lit(0.0)))


def report(chunks: DataFrame, spans: DataFrame, docs: DataFrame, budget: int, ceiling: int, floor: int, coherence: DataFrame | None = None) -> DataFrame:
    """(config, measure, value) over chunks (config, doc_id, chunk_index, start, stop, text, n_tokens) of all configurations.

    spans are the sentences (doc_id, start, stop) and docs the texts (doc_id, text). coherence, if given, has
    (config, score); null and NaN scores count in n_scores only. A measure that has no value is null.
    """
    out = sizes(chunks, budget, ceiling, floor).join(single_rate(chunks), KEY).join(boundaries(chunks, spans, docs), KEY).join(overlaps(chunks, spans), KEY)
    if coherence is not None:
        good = F.when(~F.isnan("score"), F.col("score"))
        out = out.join(coherence.groupBy(*KEY).agg(F.count("*").cast("double").alias("n_scores"), F.avg(good).alias("coherence"), F.percentile(good, F.lit(0.05)).alias("coherence_p5"), F.percentile(good, F.lit(0.95)).alias("coherence_p95")), KEY, "left")
    return out.unpivot(KEY, [c for c in out.columns if c not in KEY], "measure", "value")
