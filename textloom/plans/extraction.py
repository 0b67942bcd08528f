"""Extracted sets against annotated ones, figures of selected examples, and chunks with their place in a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.operators import extraction as X
from textloom.operators import papers as P
from textloom.operators import vector_index as V
from textloom.plans.papers import _BLOCKS, _papers
from textloom.plans.vectors import SCORED
from textloom.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Each document's capitalised words as gold: (word, type by its length), and neighbours of them as relations; a record has every entity but one of three, and one that is wrong."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", words.alias("w"))
    kind = lambda x: F.element_at(F.array(*map(F.lit, ("PER", "ORG", "LOC", "MISC"))), (F.length(x) % 4 + 1).cast("int"))
    pair = lambda x: F.struct(x.alias("text"), kind(x).alias("type"))
    link = lambda a, b: F.struct(a.alias("subject"), F.lit("next_to").alias("relation"), b.alias("object"))
    next_to = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), link)
    kept = F.filter("w", lambda x, i: i % 3 != 1)
    rows = rows.withColumn("kept", kept)
    found = F.concat(F.transform("kept", pair), F.array(F.struct(F.lit("Nobody").alias("text"), F.lit("PER").alias("type"))))
    record = F.to_json(F.struct(found.alias("entities"), next_to(F.col("kept")).alias("relations"), (F.size("kept") > 3).alias("has_person"), F.lit(True).alias("has_organization"), F.lit(False).alias("has_location"), (F.col("doc_id") % 2 == 0).alias("has_misc"), F.col("lang").alias("topic")))
    value = F.when(F.col("doc_id") % 10 == 3, F.lit(None)).when(F.col("doc_id") % 10 == 4, F.lit("not json")).otherwise(record)
    return rows.select("doc_id", "lang", F.transform("w", pair).alias("gold"), next_to(F.col("w")).alias("gold_relations"), value.alias("value"))


def entity_prf(spark: SparkSession, d: str) -> DataFrame:
    """Micro precision, recall and F1 of entities and of relations by language."""
    rows = _records(spark, d).select("lang", X.set_counts(F.col("gold"), X.pairs(F.col("value"))).alias("e"), X.set_counts(F.col("gold_relations"), X.triples(F.col("value"))).alias("r"))
    parts = [X.micro(rows, c, "lang").withColumn("kind", F.lit(name)) for c, name in (("e", "entities"), ("r", "relations"))]
    return parts[0].unionByName(parts[1]).select("lang", "kind", "common", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def flag_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often the flat flags are right, of documents with a record, and the topics."""
    rows = _records(spark, d)
    flags = X.flat_accuracy(rows.where("value <> 'not json'"), "value", "gold")
    topics = rows.agg(F.round(F.avg(X.topic_correct(F.col("value"), F.col("lang")).cast("double")), 6).alias("topics"))
    return flags.crossJoin(topics).select("n", *[F.round(f, 6).alias(f) for f in X.FLAGS], "topics")


def selector_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are among the five nearest of two queries or more."""
    rows = V.unit_rows(table(spark, d, "embeddings"))
    picked = V.search(rows.where("vec_id % 100 = 0"), rows, 5, others=True)
    return picked.groupBy("vec_id").agg(F.count("*").alias("picked_by")).where("picked_by >= 2").join(rows.select("vec_id", "label"), "vec_id")


def selector_summary(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the five nearest examples: similarity of the same label, of others and of the picked, label hits, hubs."""
    rows = V.unit_rows(table(spark, d, "embeddings"))
    asked = rows.where("vec_id % 100 = 0")
    labels = rows.select("vec_id", "label")
    picked = V.search(asked, rows, 5, others=True).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("match", F.col("label") == F.col("ql"))
    n = V.score_histogram(asked, rows).agg((F.sum(F.col("score") * F.col("r")) / F.sum("r")).alias("same"), (F.sum(F.col("score") * F.col("o")) / F.sum("o")).alias("other"))
    per = picked.groupBy("query_id").agg(F.max(F.col("match").cast("int")).alias("hit"), F.max(F.when(F.col("rank") == 1, F.col("match").cast("int"))).alias("top"))
    one = picked.agg(F.count_distinct("query_id").alias("queries"), F.count_distinct("vec_id").alias("examples"), F.avg("score").alias("picked"), F.avg(F.col("match").cast("double")).alias("precision"))
    hits = per.agg(F.avg("hit").alias("hit_rate"), F.avg("top").alias("top_match"))
    return one.crossJoin(hits).crossJoin(n).select("queries", "examples", *[F.round(c, 6).alias(c) for c in ("same", "other", "picked", "precision", "hit_rate", "top_match")])


def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of papers as chunks with all that is attached to them: id, neighbours, number, title, and the heading they stand under."""
    papers = P.rendered(_papers(spark, d))
    chunks = papers.select("paper_id", "title", F.posexplode("blocks").alias("chunk_index", "b")).select("paper_id", "title", "chunk_index", F.col("b.start").alias("start"))
    heads = papers.select("paper_id", F.explode("headings").alias("h")).select("paper_id", F.col("h.start").alias("start"), F.col("h.title").alias("section"))
    rows = S.as_of(chunks, heads, "paper_id", "start", "start", "section")
    w = W.partitionBy("paper_id").orderBy("chunk_index")
    key = F.concat_ws("::", "paper_id", F.col("chunk_index").cast("string"))
    rows = rows.withColumn("chunk_id", key)
    return rows.select("chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"), F.count("*").over(W.partitionBy("paper_id")).alias("n_chunks"), "title", "section")


_SETS = """WITH d AS (SELECT doc_id, lang, list_filter(range(1, len(x) + 1), lambda i: list_position(x, x[i]) = i) AS idx, x FROM (SELECT doc_id, lang, regexp_extract_all(text, '[A-Z][a-z]+') AS x FROM documents WHERE text IS NOT NULL)),
 w AS (SELECT doc_id, lang, list_transform(idx, lambda i: x[i]) AS w FROM d), k AS (SELECT *, list_transform(list_filter(range(1, len(w) + 1), lambda i: (i - 1) % 3 <> 1), lambda i: w[i]) AS kept, doc_id % 10 NOT IN (3, 4) AS ok FROM w),
 n AS (SELECT *, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g, list_transform(range(1, len(kept)), lambda i: kept[i] || ' ' || kept[i + 1]) AS f FROM k),
 c AS (SELECT lang, 'entities' AS kind, CASE WHEN ok THEN len(kept) + (list_contains(w, 'Nobody') AND length('Nobody') % 4 = 0 AND NOT list_contains(kept, 'Nobody'))::INT ELSE 0 END AS common, CASE WHEN ok THEN len(kept) + 1 ELSE 0 END AS found, len(w) AS gold FROM n
  UNION ALL SELECT lang, 'relations', CASE WHEN ok THEN len(list_intersect(g, f)) ELSE 0 END, CASE WHEN ok THEN len(f) ELSE 0 END, len(g) FROM n),
 t AS (SELECT lang, kind, sum(common)::BIGINT AS common, sum(common) / nullif(sum(found), 0) AS p, sum(common) / nullif(sum(gold), 0) AS r FROM c GROUP BY lang, kind)"""
_KIND = "['PER', 'ORG', 'LOC', 'MISC'][length(x) % 4 + 1]"
_NEAR = f"{SCORED}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE query_id <> vec_id), p AS (SELECT * FROM t WHERE rank <= 5)"

QUERIES = {
    "entity_prf": (entity_prf, f"{_SETS} SELECT lang, kind, common, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM t"),
    "flag_accuracy": (
        flag_accuracy,
        f"""{_SETS}, y AS (SELECT *, list_transform(w, lambda x: {_KIND}) AS types FROM n) SELECT count(*) FILTER (ok) AS n, round(avg(((len(kept) > 3) = list_contains(types, 'PER'))::INT) FILTER (ok), 6) AS has_person, round(avg(list_contains(types, 'ORG')::INT) FILTER (ok), 6) AS has_organization,
        round(avg((NOT list_contains(types, 'LOC'))::INT) FILTER (ok), 6) AS has_location, round(avg(((doc_id % 2 = 0) = list_contains(types, 'MISC'))::INT) FILTER (ok), 6) AS has_misc, round(avg((ok AND lang IS NOT NULL)::INT), 6) AS topics FROM y""",
    ),
    "selector_hubs": (selector_hubs, f"WITH {_NEAR} SELECT vec_id, count(*) AS picked_by, any_value(label) AS label FROM p GROUP BY vec_id HAVING count(*) >= 2"),
    "selector_summary": (
        selector_summary,
        f"""WITH {_NEAR}, q AS (SELECT query_id, max((label = query_label)::INT) AS hit, max((label = query_label)::INT) FILTER (rank = 1) AS top FROM p GROUP BY query_id)
        SELECT (SELECT count(DISTINCT query_id) FROM p) AS queries, (SELECT count(DISTINCT vec_id) FROM p) AS examples, round(avg(score) FILTER (label = query_label), 6) AS same, round(avg(score) FILTER (label <> query_label), 6) AS other,
        (SELECT round(avg(score), 6) FROM p) AS picked, (SELECT round(avg((label = query_label)::INT), 6) FROM p) AS precision, (SELECT round(avg(hit), 6) FROM q) AS hit_rate, (SELECT round(avg(top), 6) FROM q) AS top_match FROM t""",
    ),
    "chunk_metadata": (
        chunk_metadata,
        f"""WITH {_BLOCKS}, m AS (SELECT b.*, x.source, doc_id || '::' || (place - 1) AS chunk_id FROM b JOIN x USING (doc_id))
        SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id, count(*) OVER (PARTITION BY doc_id) AS n_chunks, source AS title, last_value(m.title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY place)""",
    ),
}
