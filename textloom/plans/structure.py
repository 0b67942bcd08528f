"""Headings, sections, front matter and chunk quality. Lines of the documents are made into headings and labels by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.operators import chunking as C
from textloom.operators import structure as T
from textloom.sources.tables import table

FORMS = ["## Head of", "1.2 Numbered", "CHAPTER IV. Of", " Abstract: ", "3. Ends with a dot.", "Part one two three four five six seven eight", "BOOK II", "4.1.1. Deep", "plain line"]


def _lined(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): line i of a text is form (i + doc_id) modulo 9; the first, second and eighth carry i."""
    form = lambda i: F.element_at(F.array(*map(F.lit, FORMS)), ((F.col("doc_id") + i) % 9 + 1).cast("int"))
    line = lambda x, i: F.when(((F.col("doc_id") + i) % 9).isin(0, 1, 7), F.concat(form(i), F.lit(" "), i.cast("string"))).otherwise(form(i))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def headings_detect(spark: SparkSession, d: str) -> DataFrame:
    return T.headings(_lined(spark, d)).select("doc_id", "start", F.col("level").cast("long").alias("level"), "title")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _lined(spark, d)
    return T.sections(T.headings(rows), rows.select("doc_id", F.length("text").cast("long").alias("n")))


def sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("doc_id", "start", "stop", F.col("level").cast("long").alias("level"), F.array_join("path", " > ").alias("path"))


def section_path_asof(spark: SparkSession, d: str) -> DataFrame:
    """The section path at every hundredth character, the place of a chunk's start."""
    at = _lined(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(100).cast("long"))).alias("pos"))
    paths = _sections(spark, d).select("doc_id", "start", F.array_join("path", " > ").alias("path"))
    return S.as_of(at, paths, "doc_id", "pos", "start", "path")


def heading_match(spark: SparkSession, d: str) -> DataFrame:
    """Multiset precision and recall of (level, title) of found headings against those of even levels' doubles, per document."""
    found = T.headings(_lined(spark, d)).groupBy("doc_id", "level", "title").agg(F.count("*").alias("p"))
    gold = found.select("doc_id", "level", "title", F.when(F.col("level") % 2 == 0, F.col("p") + 1).otherwise(F.greatest(F.col("p") - 1, F.lit(0))).alias("g"))
    both = found.join(gold, ["doc_id", "level", "title"], "full").select("doc_id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("g", F.lit(0)).alias("g"))
    rows = both.groupBy("doc_id").agg(F.sum(F.least("p", "g")).alias("hit"), F.sum("p").alias("p"), F.sum("g").alias("g"))
    ratio = lambda x: F.round(F.try_divide(F.col("hit").cast("double"), F.col(x).cast("double")), 6)
    return rows.select("doc_id", ratio("p").alias("precision"), ratio("g").alias("recall"), ((F.col("hit") == F.col("p")) & (F.col("hit") == F.col("g"))).alias("perfect"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): documents behind front matter of five kinds."""
    s, i = F.coalesce("source", F.lit("none")), F.col("doc_id") % 5
    made = [
        F.concat(F.lit("Title: "), s, F.lit("\n  second part\nAuthor: Ann Roe and Bo Doe\nRelease Date: March 5, 2001 [EBook #1]\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nTitle: no\n")),
        F.concat(F.lit("\nThe Project Gutenberg EBook of "), s, F.lit(", by Ann\n\nPosting Date: 5 May 1999\n")),
        F.lit("Title: A\nTitle: B\n  of nothing\nother\n  also nothing\nAuthor: \n  Bo and  \nrelease date: 2001-02-03\n"),
        F.lit("Posting date: May 2004\nRelease date: no date\nAuthor: Cy\n*** START OF THIS PROJECT GUTENBERG EBOOK"),
        F.lit("*** start of the project gutenberg ebook ***"),
    ]
    head = F.lit("")
    for k, m in enumerate(made):
        head = F.when(i == k, m).otherwise(head)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(head, F.when(i.isin(0, 3, 4), F.col("text")).otherwise("")).alias("text"))


def book_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = T.book_fields(_books(spark, d))
    return rows.withColumn("authors", F.array_join("authors", ";"))


def book_field_rates(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, accuracy, and accuracy where covered of the title and the date, against the catalogue's."""
    rows = T.book_fields(_books(spark, d)).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    parts = []
    for field, gold in (("title", F.col("source")), ("date", F.lit("2001-03-05"))):
        right = F.coalesce(F.regexp_replace(F.lower(field), r"\s+", " ").startswith(F.lower(gold)), F.lit(False))
        n = rows.agg(F.count("*").alias("n"), F.count(field).alias("covered"), F.count_if(right).alias("right"))
        parts.append(n.select(F.lit(field).alias("field"), F.round(F.col("covered") / F.col("n"), 6).alias("coverage"), F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), F.round(F.try_divide(F.col("right").cast("double"), F.col("covered").cast("double")), 6).alias("covered_accuracy")))
    return parts[0].unionByName(parts[1])


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of 200 characters, lines as sentences, and documents."""
    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text")
    at = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(200))).alias("start"))
    chunks = at.select("doc_id", (F.col("start") / 200).cast("int").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.least(F.col("start") + 200, F.length("text")).cast("long").alias("stop"), F.substring("text", F.col("start") + 1, F.lit(200)).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = lines.select("doc_id", before.alias("start"), (before + F.length("line")).alias("stop")).where("stop > start")
    return chunks, spans, docs


def chunk_boundary_stats(spark: SparkSession, d: str) -> DataFrame:
    out = T.boundary_stats(*_parts(spark, d))
    return out.select("cuts", *[F.round(c, 6).alias(c) for c in ("end_aligned", "start_aligned", "mid_word", "dangling")])


def chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    return T.pieces(*_parts(spark, d)).select("doc_id", "chunk_index", F.col("piece").cast("long").alias("piece"), F.md5("text").alias("digest"))


def chunk_coherence(spark: SparkSession, d: str) -> DataFrame:
    chunks, spans, docs = _parts(spark, d)
    out = T.summary_without_nan(T.coherence(T.pieces(chunks, spans, docs), chunks, C.word_vectors))
    return out.select("n", "n_nan", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p50", "p95")])


def coherence_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The coherence of made-up chunks of as many sentences as real ones have."""
    chunks, spans, docs = _parts(spark, d)
    sizes = T.pieces(chunks, spans, docs).groupBy("doc_id", "chunk_index").agg(F.count("*").cast("int").alias("k")).where("k >= 2")
    parts = T.random_chunks(spans, docs, sizes, 50).withColumn("doc_id", F.lit(0))
    made = parts.groupBy("doc_id", "chunk_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), " ").alias("text"))
    out = T.summary_without_nan(T.coherence(parts, made, C.word_vectors))
    return out.select("n", "n_nan", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p50", "p95")])


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(None)).otherwise(F.col("value")).alias("score"))
    out = T.summary_without_nan(rows)
    return out.select("n", "n_nan", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p50", "p95")])


def percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Linear percentiles of the distance between each event's value and the one before, by user."""
    gap = F.abs(F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id")))
    return table(spark, d, "events").select(gap.alias("d")).agg(*[F.round(F.percentile("d", F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 80, 95)])


def paragraph_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of texts with a blank line, by language."""
    has = F.col("text").rlike(r"\r?\n[ \t]*\r?\n")
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy("lang").agg(F.round(F.avg(has.cast("double")), 6).alias("share"), F.count("*").alias("n"))


def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks of each size fit what the longest prefix leaves of a context of 2048 tokens."""
    n = F.size(F.filter(F.split(F.coalesce("source", F.lit("")), r"[\s_-]+"), lambda x: x != ""))
    prefix = table(spark, d, "documents").agg(F.ceil(F.percentile(n, F.lit(0.95))).alias("h"))
    sizes = spark.createDataFrame([(x,) for x in (64, 128, 256, 512)], "size int")
    return sizes.crossJoin(prefix).select(F.col("size").cast("long").alias("size"), F.col("h").alias("prefix"), F.floor((2048 - F.col("h")) / (F.col("size") + F.col("h"))).alias("k_max"))


LINED = """n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i AS pos, (doc_id + i) % 9 AS f FROM n, unnest(range(n)) AS u(i)),
t AS (SELECT *, CASE f WHEN 0 THEN '## Head of ' || pos WHEN 1 THEN '1.2 Numbered ' || pos WHEN 2 THEN 'CHAPTER IV. Of' WHEN 3 THEN ' Abstract: ' WHEN 4 THEN '3. Ends with a dot.' WHEN 5 THEN 'Part one two three four five six seven eight' WHEN 6 THEN 'BOOK II' WHEN 7 THEN '4.1.1. Deep ' || pos ELSE 'plain line' END AS line FROM l),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(length(line) + 1) OVER (PARTITION BY doc_id)::BIGINT - 1 AS total FROM t),
h AS (SELECT doc_id, start, pos, total, CASE f WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 3 END::BIGINT AS level, CASE f WHEN 0 THEN 'Head of ' || pos WHEN 1 THEN 'Numbered ' || pos WHEN 2 THEN 'CHAPTER IV. Of' WHEN 3 THEN 'Abstract:' WHEN 6 THEN 'BOOK II' WHEN 7 THEN 'Deep ' || pos END AS title FROM p WHERE f IN (0, 1, 2, 3, 6, 7))"""
# a heading lies in the last one before it of each higher level, unless a still higher one came in between
PATHS = f"""{LINED}, a AS (SELECT *, max(start) FILTER (level = 1) OVER w AS s1, max(start) FILTER (level = 2) OVER w AS s2, max(title) FILTER (level = 1) OVER w AS unused FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT a.doc_id, a.start, a.level, coalesce((SELECT min(b.start) FROM h b WHERE b.doc_id = a.doc_id AND b.start > a.start AND b.level <= a.level), a.total) AS stop,
 concat_ws(' > ', CASE WHEN a.level > 1 THEN x.title END, CASE WHEN a.level > 2 AND a.s2 > coalesce(a.s1, -1) THEN y.title END, a.title) AS path
 FROM a LEFT JOIN h x ON x.doc_id = a.doc_id AND x.start = a.s1 LEFT JOIN h y ON y.doc_id = a.doc_id AND y.start = a.s2)"""
PARTS = """d AS (SELECT doc_id, text FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, s // 200 AS chunk_index, s AS start, least(s + 200, length(text)) AS stop, text[s + 1 : s + 200] AS text, text AS whole FROM d, unnest(range(0, length(text), 200)) AS u(s)),
n AS (SELECT doc_id, i, w[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM d), unnest(range(1, len(w) + 1)) AS u(i)),
q AS (SELECT doc_id, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(line) AS n FROM n), s AS (SELECT doc_id, start, start + n AS stop FROM q WHERE n > 0)"""
BOOK = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN coalesce(source, 'none') || ' second part' WHEN 1 THEN coalesce(source, 'none') WHEN 2 THEN 'A' END AS title, CASE doc_id % 5 WHEN 0 THEN 'label:title' WHEN 1 THEN 'header_line' WHEN 2 THEN 'label:title' ELSE 'not_found' END AS title_from,
CASE doc_id % 5 WHEN 0 THEN 'Ann Roe;Bo Doe' WHEN 2 THEN 'Bo and' WHEN 3 THEN 'Cy' END AS authors, CASE doc_id % 5 WHEN 0 THEN '2001-03-05' WHEN 1 THEN '1999-05-05' WHEN 2 THEN '2001-02-03' END AS date,
CASE doc_id % 5 WHEN 0 THEN 'March 5, 2001 [EBook #1]' WHEN 1 THEN '5 May 1999' WHEN 2 THEN '2001-02-03' WHEN 3 THEN 'no date' END AS date_raw, CASE doc_id % 5 WHEN 0 THEN 'label:release date' WHEN 1 THEN 'label:posting date' WHEN 2 THEN 'label:release date' WHEN 3 THEN 'label:release date' ELSE 'not_found' END AS date_from FROM documents WHERE text IS NOT NULL"""

QUERIES = {
    "headings_detect": (headings_detect, f"WITH {LINED} SELECT doc_id, start, level, title FROM h"),
    "sections": (sections, f"WITH {PATHS} SELECT doc_id, start, stop, level, path FROM s"),
    "section_path_asof": (section_path_asof, f"WITH {PATHS}, g AS (SELECT doc_id, max(total) AS n FROM p GROUP BY doc_id), m AS (SELECT doc_id, unnest(range(0, n + 1, 100)) AS pos FROM g) SELECT m.doc_id, m.pos, s.path FROM m ASOF LEFT JOIN s ON m.doc_id = s.doc_id AND m.pos >= s.start"),
    "heading_match": (
        heading_match,
        f"""WITH {LINED}, c AS (SELECT doc_id, level, title, count(*) AS p FROM h GROUP BY doc_id, level, title), k AS (SELECT doc_id, p, CASE WHEN level % 2 = 0 THEN p + 1 ELSE p - 1 END AS g FROM c), r AS (SELECT doc_id, sum(least(p, g)) AS hit, sum(p) AS p, sum(g) AS g FROM k GROUP BY doc_id)
        SELECT doc_id, round(hit / p, 6) AS precision, CASE WHEN g > 0 THEN round(hit / g, 6) END AS recall, hit = p AND hit = g AS perfect FROM r""",
    ),
    "book_fields": (book_fields, BOOK),
    "book_field_rates": (
        book_field_rates,
        f"""WITH b AS (SELECT b.*, d.source FROM ({BOOK}) b JOIN documents d USING (doc_id)), n AS (SELECT 'title' AS field, count(*) AS n, count(title) AS c, count(*) FILTER (starts_with(lower(title), lower(source))) AS r FROM b UNION ALL SELECT 'date', count(*), count(date), count(*) FILTER (date = '2001-03-05') FROM b)
        SELECT field, round(c / n, 6) AS coverage, round(r / n, 6) AS accuracy, round(r / c, 6) AS covered_accuracy FROM n""",
    ),
    "chunk_boundary_stats": (
        chunk_boundary_stats,
        f"""WITH {PARTS}, x AS (SELECT c.*, start IN (SELECT s.start FROM s WHERE s.doc_id = c.doc_id) AS a, stop IN (SELECT s.stop FROM s WHERE s.doc_id = c.doc_id) AS b, stop < length(whole) AS inner_end FROM c)
        SELECT count(*) FILTER (start > 0) AS cuts, round(count(*) FILTER (inner_end AND b) / count(*) FILTER (start > 0), 6) AS end_aligned, round(count(*) FILTER (start > 0 AND a) / count(*) FILTER (start > 0), 6) AS start_aligned,
        round(count(*) FILTER (inner_end AND regexp_matches(whole[stop : stop + 1], '^[\\p{{L}}\\p{{N}}]{{2}}$')) / count(*) FILTER (start > 0), 6) AS mid_word,
        round(count(*) FILTER (start > 0 AND lower(regexp_extract(text, '^[^\\p{{L}}\\p{{N}}_]*([\\p{{L}}\\p{{N}}_]+)', 1)) IN ({", ".join(f"'{w}'" for w in T.DANGLING)})) / count(*) FILTER (start > 0), 6) AS dangling FROM x""",
    ),
    "chunk_pieces": (
        chunk_pieces,
        f"""WITH {PARTS}, x AS (SELECT c.doc_id, chunk_index, greatest(s.start, c.start) AS a, trim(whole[greatest(s.start, c.start) + 1 : least(s.stop, c.stop)], ' ') AS piece FROM c JOIN s ON s.doc_id = c.doc_id AND s.start <= c.stop AND s.stop > c.start)
        SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY a) - 1 AS piece, md5(piece) AS digest FROM x WHERE piece <> ''""",
    ),
    "chunk_coherence": (chunk_coherence, None),
    "coherence_baseline": (coherence_baseline, None),
    "score_summary": (score_summary, "SELECT count(*) AS n, count(*) FILTER (event_id % 10 < 2) AS n_nan, round(avg(value) FILTER (event_id % 10 > 1), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {p}) FILTER (event_id % 10 > 1), 6) AS {n}" for p, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))) + " FROM events"),
    "percentile_threshold": (percentile_threshold, "SELECT " + ", ".join(f"round(quantile_cont(d, {p / 100}), 6) AS p{p}" for p in (50, 80, 95)) + " FROM (SELECT abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events)"),
    "paragraph_share": (paragraph_share, r"SELECT lang, round(avg(regexp_matches(text, '\r?\n[ \t]*\r?\n')::INT), 6) AS share, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang"),
    "token_budgets": (
        token_budgets,
        "WITH h AS (SELECT ceil(quantile_cont(len(list_filter(regexp_split_to_array(coalesce(source, ''), '[\\s_-]+'), lambda x: x <> '')), 0.95))::BIGINT AS h FROM documents) SELECT size::BIGINT AS size, h AS prefix, floor((2048 - h) / (size + h))::BIGINT AS k_max FROM h, unnest([64, 128, 256, 512]) AS u(size)",
    ),
}
