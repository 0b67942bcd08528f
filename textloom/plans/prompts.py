"""Prompts, configuration grids and evaluations over annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.functions import templates as T
from textloom.plans.chunks import _word_spans
from textloom.sources.sinks import config_id
from textloom.operators.token_stream import offsets
from textloom.sources.tables import table

EXAMPLE = "Q: {{ question }}\nA: {{answer}}"
PROMPT = "You are {{role}}.\n\n{{examples}}\n\nQ: {{question}}\nA:"


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for each customer with two worked examples from its nation."""
    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    made = F.array(pair(F.concat(F.lit("segment of "), F.col("c_name")), F.col("c_mktsegment")), pair(F.lit("nation"), F.col("c_nationkey").cast("string")))
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", F.md5(T.render(PROMPT, role="a clerk", examples=T.examples(made, EXAMPLE), question=F.col("c_name"))).alias("prompt"))


def few_shot(spark: SparkSession, d: str) -> DataFrame:
    """The first three customers of each nation as examples, in order: what a prompt of fixed examples holds."""
    rank = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = table(spark, d, "customer").withColumn("r", rank).where("r <= 3")
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("r", "c_name", "c_mktsegment"))), lambda x: F.struct(x["c_name"].alias("question"), x["c_mktsegment"].alias("answer")))
    return rows.groupBy("c_nationkey").agg(T.examples(pairs, EXAMPLE).alias("examples"))


def prefixed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a split and a running number within it, from 0."""
    split = F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train")
    rows = table(spark, d, "labels").select("doc_id", split.alias("split"), F.lit(1).cast("long").alias("n"))
    placed = offsets(rows, ["split", "doc_id"], "n")
    first = placed.groupBy("split").agg(F.min("offset").alias("first"))
    return placed.join(F.broadcast(first), "split").select("doc_id", F.concat("split", F.lit("-"), (F.col("offset") - F.col("first")).cast("string")).alias("id"))


def config_grid(spark: SparkSession, d: str) -> DataFrame:
    """Chunk sizes by overlap and strategy for each language of the documents, with a key of the settings; an overlap fits its size."""
    rows = table(spark, d, "documents").where("lang IS NOT NULL").select("lang").distinct()
    for name, values in (("size", (64, 128, 256)), ("overlap", (0, 32, 64)), ("strategy", ("fixed", "recursive", "sentence"))):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return config_id(rows.where("overlap < size"), ["size", "overlap", "strategy", "lang"])


def annotator_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each document's evidence at three budgets of words, the best over three annotators; the mean over documents.

    Windows of 50 words are ranked by digest and taken while they fit; annotator a marks every window
    whose number modulo 3 is a.
    """
    s = _word_spans(spark, d, 50, 0)
    order = W.partitionBy("doc_id").orderBy(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))), "chunk_index").rowsBetween(W.unboundedPreceding, 0)
    ranked = s.withColumn("used", F.sum(F.col("stop") - F.col("start")).over(order)).withColumn("annotator", F.col("chunk_index") % 3)
    at = ranked.withColumn("budget", F.explode(F.array(*map(F.lit, (100, 200, 400)))))
    n = F.col("stop") - F.col("start")
    per = at.groupBy("doc_id", "budget", "annotator").agg((F.sum(F.when(F.col("used") <= F.col("budget"), n).otherwise(0)) / F.sum(n)).alias("recall"))
    best = per.groupBy("doc_id", "budget").agg(F.max("recall").alias("recall"))
    return best.groupBy(F.col("budget").cast("long").alias("budget")).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n"))


def span_union(spark: SparkSession, d: str) -> DataFrame:
    """The words that the windows of each document cover, overlaps once."""
    return S.merge(_word_spans(spark, d, 64, 16).select("doc_id", "start", "stop"), "doc_id").groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("n"))


WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)"
QUERIES = {
    "prompts": (
        prompts,
        "SELECT c_custkey, md5('You are a clerk.' || chr(10) || chr(10) || 'Q: segment of ' || c_name || chr(10) || 'A: ' || c_mktsegment || chr(10) || chr(10) || 'Q: nation' || chr(10) || 'A: ' || c_nationkey || chr(10) || chr(10) || 'Q: ' || c_name || chr(10) || 'A:') AS prompt FROM customer",
    ),
    "few_shot": (
        few_shot,
        "WITH r AS (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 3) SELECT c_nationkey, string_agg('Q: ' || c_name || chr(10) || 'A: ' || c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey) AS examples FROM r GROUP BY c_nationkey",
    ),
    "prefixed_ids": (prefixed_ids, "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM labels) SELECT doc_id, split || '-' || (row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) AS id FROM s"),
    "config_grid": (
        config_grid,
        """SELECT lang, size::INT AS size, overlap::INT AS overlap, strategy, sha1('{"lang":"' || lang || '","overlap":' || overlap || ',"size":' || size || ',"strategy":"' || strategy || '"}')[1:10] AS config_id
        FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), unnest([64, 128, 256]) AS a(size), unnest([0, 32, 64]) AS b(overlap), unnest(['fixed', 'recursive', 'sentence']) AS c(strategy) WHERE overlap < size""",
    ),
    "annotator_evidence": (
        annotator_evidence,
        f"""WITH {WORDS}, c AS (SELECT doc_id, s // 50 AS i, least(50, len(w) - s) AS n FROM w, unnest(range(0, len(w), 50)) AS u(s)),
        r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY md5(concat_ws('|', doc_id, i)), i) AS used FROM c),
        p AS (SELECT doc_id, budget, sum(CASE WHEN used <= budget THEN n ELSE 0 END) / sum(n) AS recall FROM r, unnest([100, 200, 400]) AS b(budget) GROUP BY doc_id, budget, i % 3),
        m AS (SELECT doc_id, budget, max(recall) AS recall FROM p GROUP BY doc_id, budget) SELECT budget::BIGINT AS budget, round(avg(recall), 6) AS recall, count(*) AS n FROM m GROUP BY budget""",
    ),
    "span_union": (span_union, f"WITH {WORDS} SELECT doc_id, len(w) AS n FROM w WHERE len(w) > 0"),
}
