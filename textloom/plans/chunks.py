"""Chunking, spans and document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.operators import chunking as C
from textloom.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed_windows(_docs(spark, d), 64, 16)


def chunk_fixed_words(spark: SparkSession, d: str) -> DataFrame:
    return _fixed(spark, d).select("doc_id", "chunk_index", F.md5("text").alias("digest"), "n_tokens")


def chunk_size_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_tokens")
    p = lambda x: F.round(F.percentile(n, x), 6)
    return _fixed(spark, d).agg(
        F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"),
        F.round(F.stddev_pop(n) / F.avg(n), 6).alias("cv"), F.round(F.avg(n / 64), 6).alias("fill"), F.round(F.avg((n + 2 > 64).cast("double")), 6).alias("above"), F.round(F.avg((n < 16).cast("double")), 6).alias("below"),
    )


def chunk_single_rate(spark: SparkSession, d: str) -> DataFrame:
    return _fixed(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("rate"))


def chunk_neighbors(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("chunk_index")
    key = F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    rows = _fixed(spark, d).select("doc_id", "chunk_index", key.alias("chunk_id"))
    return rows.select("chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"), F.count("*").over(W.partitionBy("doc_id")).alias("n_chunks"))


def truncation_rates(spark: SparkSession, d: str) -> DataFrame:
    n = _docs(spark, d).select(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("n"))
    p = lambda x: F.round(F.percentile("n", x), 6)
    return n.agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.round(F.avg((F.col("n") > 510).cast("double")), 6).alias("truncated"), F.round(F.sum(F.greatest(F.col("n") - 510, F.lit(0))) / F.sum("n"), 6).alias("lost"))


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as runs up to . ! ? or a line end, by one regular expression."""
    parts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    return _docs(spark, d).select("doc_id", F.posexplode(parts).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("s").alias("digest"), F.length("s").cast("long").alias("n"))


def chunk_sentence_greedy(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(_docs(spark, d), lambda t: C.pack_sentences(t, 64, 1)).drop("text")


def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(_docs(spark, d), lambda t: C.recursive(t, 64, 16)).drop("text")


def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Cuts at distances over the 80th percentile of the corpus."""
    docs = _docs(spark, d)
    threshold = C.document_gaps(docs).agg(F.percentile("d", F.lit(0.8))).first()[0] or 0.0

    def spans(t):
        s = C.sentences(t)
        return C.semantic(t, C.gap_distances(t, s), s, threshold, 64, 16)

    return C.chunk_documents(docs, spans).drop("text")


def _word_spans(spark: SparkSession, d: str, size: int, overlap: int) -> DataFrame:
    rows = C.fixed_windows(_docs(spark, d), size, overlap)
    start = (F.col("chunk_index") * (size - overlap)).cast("long")
    return rows.select("doc_id", "chunk_index", start.alias("start"), (start + F.col("n_tokens")).alias("stop"))


def chunk_overlap_stats(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of neighbours and redundancy, in words."""
    s = _word_spans(spark, d, 64, 16)
    before = F.lag("stop").over(W.partitionBy("doc_id").orderBy("chunk_index"))
    over = s.withColumn("over", F.greatest(F.lit(0), before - F.col("start"))).agg(F.round(F.avg("over"), 6).alias("mean_overlap"), F.max("over").alias("max_overlap"), F.sum(F.col("stop") - F.col("start")).alias("total"))
    union = S.merge(s.select("doc_id", "start", "stop"), "doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    return over.crossJoin(union).select("mean_overlap", "max_overlap", F.round(F.col("total") / F.col("covered"), 6).alias("redundancy"))


def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    s = _word_spans(spark, d, 40, 0).where("chunk_index % 3 <> 2").select("doc_id", "start", "stop")
    return S.merge(s, "doc_id")


def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = _word_spans(spark, d, 40, 0).where("chunk_index % 2 = 0").select("doc_id", "start", "stop")
    b = _word_spans(spark, d, 50, 10).where("chunk_index % 3 = 0").select("doc_id", "start", "stop")
    return S.overlap(a, b, "doc_id")


def evidence_at_budget(spark: SparkSession, d: str) -> DataFrame:
    """Chunks ranked by digest, taken while they fit 120 words; recall and precision of every third window."""
    s = _word_spans(spark, d, 50, 0)
    order = W.partitionBy("doc_id").orderBy(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))), "chunk_index").rowsBetween(W.unboundedPreceding, 0)
    taken = s.withColumn("used", F.sum(F.col("stop") - F.col("start")).over(order)).where("used <= 120").select("doc_id", "start", "stop")
    gold = s.where("chunk_index % 3 = 0").select("doc_id", "start", "stop")
    size = lambda x, name: S.merge(x, "doc_id").groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias(name))
    rows = size(gold, "g").join(size(taken, "t"), "doc_id", "left").join(S.overlap(taken, gold, "doc_id"), "doc_id", "left")
    hit = F.coalesce("n", F.lit(0))
    return rows.select("doc_id", F.round(hit / F.col("g"), 6).alias("recall"), F.round(F.try_divide(hit, F.col("t")), 6).alias("precision"))


def html_fields(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all(html, F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"))


def conversation_turn_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Turns in pairs of a conversation, in order."""
    rows = table(spark, d, "conversations").withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    part = rows.groupBy("conv_id", F.expr("rn DIV 2").alias("chunk_index")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return part.select("conv_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(F.array_join(F.transform("x", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")).alias("digest"), F.size("x").cast("long").alias("turns"))


W_ = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)"


def _win(size: int, step: int, name: str = "f") -> str:
    return f"""{name} AS (SELECT doc_id, i AS chunk_index, i * {step} AS start, least(len(w), i * {step} + {size}) AS stop, w[i * {step} + 1 : i * {step} + {size}] AS part
      FROM (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {size}) / {step})::BIGINT) + 1)) AS i FROM w WHERE len(w) > 0))"""


FIX = f"WITH {W_}, {_win(64, 48)}"
MERGE = """SELECT doc_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(CASE WHEN start > b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS isl
  FROM (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {})) GROUP BY doc_id, isl"""
LINES = """l AS (SELECT doc_id, i - 1 AS pos, x[i] AS raw FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
 m AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 AND trim(raw, ' ') <> '' THEN repeat('#', (pos // 5 % 3 + 1)::INT) || ' ' || substring(trim(raw, ' '), 1, 12) ELSE raw END AS line FROM l),
 h AS (SELECT doc_id, pos, len(regexp_extract(line, '^(#{1,6}) +(\\S.*?) *$', 1)) AS level, regexp_extract(line, '^(#{1,6}) +(\\S.*?) *$', 2) AS title FROM m WHERE regexp_matches(line, '^(#{1,6}) +(\\S.*?) *$'))"""

QUERIES = {
    "chunk_fixed_words": (chunk_fixed_words, f"{FIX} SELECT doc_id, chunk_index, md5(array_to_string(part, ' ')) AS digest, len(part) AS n_tokens FROM f"),
    "chunk_size_stats": (
        chunk_size_stats,
        f"""{FIX}, n AS (SELECT stop - start AS n FROM f) SELECT count(*) AS n, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.05), 6) AS p5, round(quantile_cont(n, 0.5), 6) AS p50,
        round(quantile_cont(n, 0.95), 6) AS p95, round(stddev_pop(n) / avg(n), 6) AS cv, round(avg(n / 64), 6) AS fill, round(avg((n + 2 > 64)::INT), 6) AS above, round(avg((n < 16)::INT), 6) AS below FROM (SELECT n AS n FROM n)""",
    ),
    "chunk_single_rate": (chunk_single_rate, f"{FIX} SELECT round(avg((n = 1)::INT), 6) AS rate FROM (SELECT count(*) AS n FROM f GROUP BY doc_id)"),
    "chunk_neighbors": (
        chunk_neighbors,
        f"""{FIX}, k AS (SELECT doc_id, chunk_index, doc_id || '::' || chunk_index AS chunk_id FROM f)
        SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
    ),
    "truncation_rates": (
        truncation_rates,
        f"""WITH {W_}, n AS (SELECT len(w) AS n FROM w) SELECT round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99,
        round(avg((n > 510)::INT), 6) AS truncated, round(sum(greatest(n - 510, 0)) / sum(n), 6) AS lost FROM n""",
    ),
    "sentence_spans": (
        sentence_spans,
        r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS x FROM documents)
        SELECT doc_id, i - 1 AS pos, md5(x[i]) AS digest, length(x[i]) AS n FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM s)""",
    ),
    "chunk_sentence_greedy": (chunk_sentence_greedy, None),
    "chunk_recursive": (chunk_recursive, None),
    "chunk_semantic": (chunk_semantic, None),
    "chunk_overlap_stats": (
        chunk_overlap_stats,
        f"""{FIX}, o AS (SELECT *, greatest(0, lag(stop) OVER (PARTITION BY doc_id ORDER BY chunk_index) - start) AS o, lag(stop) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS b FROM f)
        SELECT round(avg(coalesce(o, 0)), 6) AS mean_overlap, max(coalesce(o, 0)) AS max_overlap, round(sum(stop - start) / (SELECT sum(len(w)) FROM w), 6) AS redundancy FROM o""",
    ),
    "merge_spans": (merge_spans, f"WITH {W_}, {_win(40, 40)}, k AS (SELECT * FROM f WHERE chunk_index % 3 <> 2) " + MERGE.format("k")),
    "span_overlap": (
        span_overlap,
        f"""WITH {W_}, {_win(40, 40)}, {_win(50, 40, "g")}, a AS (SELECT doc_id, unnest(range(start, stop)) AS p FROM f WHERE chunk_index % 2 = 0), b AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS p FROM g WHERE chunk_index % 3 = 0)
        SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT * FROM a) JOIN b USING (doc_id, p) GROUP BY doc_id""",
    ),
    "evidence_at_budget": (
        evidence_at_budget,
        f"""WITH {W_}, {_win(50, 50)}, t AS (SELECT *, sum(stop - start) OVER (PARTITION BY doc_id ORDER BY md5(concat_ws('|', doc_id, chunk_index)), chunk_index) AS used FROM f)
        SELECT doc_id, round(sum(CASE WHEN used <= 120 AND chunk_index % 3 = 0 THEN stop - start ELSE 0 END) / sum(CASE WHEN chunk_index % 3 = 0 THEN stop - start END), 6) AS recall,
        round(sum(CASE WHEN used <= 120 AND chunk_index % 3 = 0 THEN stop - start ELSE 0 END) / nullif(sum(CASE WHEN used <= 120 THEN stop - start ELSE 0 END), 0), 6) AS precision FROM t GROUP BY doc_id""",
    ),
    "html_fields": (html_fields, """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages"""),
    "conversation_turn_chunks": (
        conversation_turn_chunks,
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations)
        SELECT conv_id, rn // 2 AS chunk_index, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM r GROUP BY conv_id, rn // 2""",
    ),
}
