"""Documents as papers: the first line is the abstract, five lines are a section, questions ask for lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import bound
from textloom.functions.vector import unit
from textloom.operators import papers as P
from textloom.sources.tables import table

BUDGETS, WIDTH = [40, 80, 160], 16


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """Every document; sections are called by source and language, by nothing, or by their number."""
    x, i = F.col("x"), F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.split(F.coalesce("text", F.lit("")), "\n").alias("x"))
    name = lambda g: F.when(g % 3 == 0, F.concat(F.col("source"), F.lit(" ::: "), F.col("lang"), F.lit(". "))).when(g % 3 == 1, F.lit(" ")).otherwise(F.concat(F.lit("Part "), g.cast("string")))
    sections = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 5)), lambda g: F.struct(name(g).alias("section_name"), F.slice(x, (g * 5 + 2).cast("int"), F.lit(5)).alias("paragraphs")))
    middle, last = F.element_at(x, F.floor(F.size(x) / 2).cast("int") + 1), F.element_at(x, -1)
    answer = lambda no, *e: F.struct(F.lit(no).alias("unanswerable"), F.array(*e).cast("array<string>").alias("evidence"))
    first = F.struct(F.lit("a").alias("question_id"), F.substring(middle, 1, 60).alias("question"), F.array(answer(False, middle), answer(False, F.concat(F.lit("\t"), last, F.lit(" ")), F.lit("FLOAT SELECTED: Table 1")), answer(True, middle)).alias("answers"))
    second = F.struct(F.lit("b").alias("question_id"), F.element_at(x, 1).alias("question"), F.when(i % 2 == 0, F.array(answer(True))).otherwise(F.array(answer(False, F.lit("\u0001 nowhere")), answer(True))).alias("answers"))
    return rows.select(F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("title"), F.element_at(x, 1).alias("abstract"), sections.alias("full_text"), F.array(first, second).alias("qas"))


def _vector(text):
    """Counts of words by the first hexadecimal digit of their digest, normalised: a stand-in for a model."""
    digits = F.transform(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), lambda w: F.substring(F.md5(w), 1, 1))
    return unit(bound(digits, lambda x: F.transform(F.array(*[F.lit(f"{i:x}") for i in range(WIDTH)]), lambda c: F.size(F.filter(x, lambda y: y == c)).cast("double"))))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    papers = P.rendered(_papers(spark, d))
    blocks = papers.select("paper_id", "text", F.explode("blocks").alias("b"))
    blocks = blocks.select("paper_id", F.col("b.start").alias("start"), F.col("b.stop").alias("stop"), F.substring("text", (F.col("b.start") + 1).cast("int"), (F.col("b.stop") - F.col("b.start")).cast("int")).alias("t"))
    chunks = blocks.select("paper_id", "start", "stop", F.size(F.filter(F.split("t", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long").alias("n_tokens"), _vector(F.col("t")).alias("u"))
    asked = P.questions(papers).where("status = 'answered'")
    ranked = P.ranked_chunks(asked.select("paper_id", "question_id", _vector(F.col("question")).alias("q")), chunks, max(BUDGETS))
    return P.evidence_scores(ranked, asked.select("paper_id", "question_id", "gold"), BUDGETS)


def paper_headings(spark: SparkSession, d: str) -> DataFrame:
    """Every heading of the rendered papers, with what stands in the text at its place."""
    rows = P.rendered(_papers(spark, d)).select("paper_id", "text", F.posexplode("headings").alias("pos", "h"))
    there = F.substring("text", (F.col("h.start") + 1).cast("int"), F.length("h.title") + 2) == F.concat(F.lit("# "), F.col("h.title"))
    return rows.select("paper_id", F.col("pos").cast("long").alias("pos"), F.col("h.title").alias("title"), F.col("h.start").alias("start"), there.alias("there"), F.md5("text").alias("digest"))


def paper_accounts(spark: SparkSession, d: str) -> DataFrame:
    return P.accounts(P.rendered(_papers(spark, d)))


def paper_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of the blocks that a question's own paper gives at each budget."""
    return _scores(spark, d).select("paper_id", "question_id", "budget", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def paper_evidence_means(spark: SparkSession, d: str) -> DataFrame:
    return P.mean_scores(_scores(spark, d)).select("budget", "n", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


_STRIP = "regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
_TITLE = "CASE g % 3 WHEN 0 THEN trim(source, ' ') || ' > ' || lang WHEN 2 THEN 'Part ' || g END"
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_VECTOR = f"list_transform(range({WIDTH}), lambda i: len(list_filter(list_transform({_WORDS}, lambda w: md5(w)[1:1]), lambda c: c = ('0123456789abcdef')[i + 1:i + 1]))::DOUBLE)"

_BLOCKS = f"""x AS (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
 k AS (SELECT doc_id, -1 AS g, 0 AS o, '# Abstract' AS t, 'Abstract' AS title FROM x WHERE {_STRIP.format('x[1]')} <> '' UNION ALL SELECT doc_id, -1, 1, x[1], NULL FROM x WHERE {_STRIP.format('x[1]')} <> ''
  UNION ALL SELECT doc_id, g, 0, '# ' || {_TITLE}, {_TITLE} FROM (SELECT doc_id, source, lang, unnest(range(len(x) // 5 + 1)) AS g FROM x) WHERE {_TITLE} IS NOT NULL
  UNION ALL SELECT doc_id, g, o, p, NULL FROM (SELECT doc_id, (i - 2) // 5 AS g, i AS o, x[i] AS p FROM (SELECT doc_id, x, unnest(range(2, len(x) + 1)) AS i FROM x)) WHERE {_STRIP.format('p')} <> ''),
 b AS (SELECT *, coalesce(sum(length(t) + 2) OVER w, 0)::BIGINT AS start, row_number() OVER (PARTITION BY doc_id ORDER BY g, o) AS place FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY g, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 r AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY place) AS text FROM b GROUP BY doc_id)"""
# evidence: two answers of question a, one of question b for odd documents
_EVIDENCE = f"""{_BLOCKS}, e0 AS (SELECT doc_id, 'a' AS q, 0 AS a, x[len(x) // 2 + 1] AS e FROM x UNION ALL SELECT doc_id, 'a', 1, chr(9) || x[len(x)] || ' ' FROM x UNION ALL SELECT doc_id, 'b', 0, chr(1) || ' nowhere' FROM x WHERE doc_id % 2 = 1),
 e AS (SELECT e0.*, coalesce(r.text, '') AS text, CASE WHEN contains(coalesce(r.text, ''), e) THEN e WHEN contains(coalesce(r.text, ''), {_STRIP.format('e')}) THEN {_STRIP.format('e')} END AS f FROM e0 LEFT JOIN r USING (doc_id)),
 s AS (SELECT doc_id, q, a, CASE WHEN f = '' THEN 0 ELSE strpos(text, f) - 1 END AS start, length(f) AS n FROM e WHERE f IS NOT NULL)"""
_SCORES = f"""{_EVIDENCE}, c AS (SELECT doc_id, start, start + length(t) AS stop, len({_WORDS.format('t')}) AS n, {_VECTOR.format('t')} AS v FROM b), qv AS (SELECT doc_id, substring(x[len(x) // 2 + 1], 1, 60) AS question, {_VECTOR.format('substring(x[len(x) // 2 + 1], 1, 60)')} AS v FROM x),
 l AS (SELECT c.doc_id, c.start, c.stop, sum(c.n) OVER (PARTITION BY c.doc_id ORDER BY round(coalesce(list_inner_product(c.v, qv.v) / nullif(sqrt(list_inner_product(c.v, c.v)) * sqrt(list_inner_product(qv.v, qv.v)), 0), 0), 6) DESC, c.start) AS used FROM c JOIN qv USING (doc_id)),
 u AS (SELECT unnest([{', '.join(map(str, BUDGETS))}]) AS budget), h AS (SELECT doc_id, a, sum(n) AS g FROM s WHERE q = 'a' GROUP BY ALL),
 o AS (SELECT s.doc_id, s.a, budget, sum(greatest(0, least(l.stop, s.start + s.n) - greatest(l.start, s.start))) AS hit FROM s JOIN l USING (doc_id), u WHERE q = 'a' AND used <= budget GROUP BY ALL),
 t AS (SELECT doc_id, budget, sum(stop - start) AS t FROM l, u WHERE used <= budget GROUP BY ALL),
 z AS (SELECT h.doc_id, h.a, u.budget, coalesce(hit, 0) / nullif(g, 0) AS recall, coalesce(hit, 0) / t AS precision FROM h CROSS JOIN u LEFT JOIN o USING (doc_id, a, budget) LEFT JOIN t USING (doc_id, budget)),
 y AS (SELECT doc_id::VARCHAR AS paper_id, 'a' AS question_id, budget, recall, precision FROM z QUALIFY row_number() OVER (PARTITION BY doc_id, budget ORDER BY coalesce(recall, -1) DESC, a) = 1)"""

QUERIES = {
    "paper_headings": (paper_headings, f"WITH {_BLOCKS} SELECT doc_id::VARCHAR AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos, title, start, true AS there, md5(r.text) AS digest FROM b JOIN r USING (doc_id) WHERE title IS NOT NULL"),
    "paper_accounts": (
        paper_accounts,
        f"""WITH {_EVIDENCE} SELECT x.doc_id::VARCHAR AS paper_id, 2 AS n_questions, count(e.f) AS found, 1 AS float_selected, count(*) - count(e.f) AS not_found,
        CASE WHEN x.doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_unanswerable, CASE WHEN x.doc_id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN count(e.f) = 0 THEN 1 ELSE 0 END AS n_no_evidence_located FROM x JOIN e USING (doc_id) GROUP BY x.doc_id""",
    ),
    "paper_evidence": (paper_evidence, f"WITH {_SCORES} SELECT paper_id, question_id, budget, round(recall, 6) AS recall, round(precision, 6) AS precision FROM y"),
    "paper_evidence_means": (paper_evidence_means, f"WITH {_SCORES} SELECT budget, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM y GROUP BY budget"),
}
