"""Nested papers: rendering with headings in place, questions with located evidence, and retrieval inside each paper.

A paper has paper_id, title, abstract, full_text (array of section_name and paragraphs) and qas (array of
question_id, question and answers, each with unanswerable and evidence). Any of them may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.functions.text import bound, strip
from textloom.functions.vector import dot

# The mark of evidence that is a figure or table, the sign between levels of a section's name.
FLOAT, LEVELS = "FLOAT SELECTED", ":::"

PAPER = """paper_id string, title string, abstract string, full_text array<struct<section_name:string,paragraphs:array<string>>>,
qas array<struct<question_id:string,question:string,answers:array<struct<unanswerable:boolean,evidence:array<string>>>>>"""
SPANS = "array<struct<start:long,stop:long>>"
BLOCK = "array<struct<text:string,title:string>>"


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers from JSON lines."""
    return spark.read.schema(PAPER).json(path)


def _blank(t: Column) -> Column:
    return t.isNull() | (strip(t) == "")


def section_title(name: Column) -> Column:
    """The levels of a section's name, without outer white space and full stops at their ends, joined by ' > '."""
    return F.array_join(F.transform(F.split(name, LEVELS), lambda p: F.rtrim(strip(p), F.lit("."))), " > ")


def _block(text: Column, title: Column) -> Column:
    return F.struct(text.cast("string").alias("text"), title.cast("string").alias("title"))


def blocks_of(abstract: Column, full_text: Column) -> Column:
    """Array of struct(text, title): the blocks of a paper in order; title is that of a heading line, else null.

    A blank abstract, section name or paragraph gives no block.
    """
    none = F.array().cast(BLOCK)
    head = lambda t: F.array(_block(F.concat(F.lit("# "), t), t))
    plain = lambda t: _block(t, F.lit(None))

    def section(s: Column) -> Column:
        body = F.transform(F.filter(F.coalesce(s["paragraphs"], F.array().cast("array<string>")), lambda p: ~_blank(p)), plain)
        return F.concat(F.when(_blank(s["section_name"]), none).otherwise(head(section_title(s["section_name"]))), body)

    first = F.when(_blank(abstract), none).otherwise(F.concat(head(F.lit("Abstract")), F.array(plain(abstract))))
    return F.concat(first, F.coalesce(F.flatten(F.transform(full_text, section)), none))


def rendered(papers: DataFrame) -> DataFrame:
    """papers with text, the blocks with a blank line between, blocks (array of start, stop, title) and headings (level, title, start)."""

    def placed(blocks: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long,title:string>>").alias("x"))

        def step(acc: Column, b: Column) -> Column:
            stop = acc["at"] + F.length(b["text"])
            return F.struct((stop + 2).alias("at"), F.concat(acc["x"], F.array(F.struct(acc["at"].alias("start"), stop.alias("stop"), b["title"].alias("title")))).alias("x"))

        return F.aggregate(blocks, start, step, lambda acc: acc["x"])

    made = bound(blocks_of(F.col("abstract"), F.col("full_text")), lambda b: F.struct(F.array_join(F.transform(b, lambda x: x["text"]), "\n\n").alias("text"), placed(b).alias("blocks")))
    out = papers.withColumn("_made", made).withColumn("text", F.col("_made.text")).withColumn("blocks", F.col("_made.blocks")).drop("_made")
    found = F.filter("blocks", lambda b: b["title"].isNotNull())
    return out.withColumn("headings", F.transform(found, lambda b: F.struct(F.lit(1).alias("level"), b["title"].alias("title"), b["start"].alias("start"))))


def located(text: Column, evidence: Column) -> Column:
    """struct(spans, found, float_selected, not_found) of an array of evidence: as it is in the text, else without outer white space."""

    def place(e: Column) -> Column:
        s = strip(e)
        at = lambda x: F.struct((F.instr(text, x) - 1).cast("long").alias("start"), (F.instr(text, x) - 1 + F.length(x)).cast("long").alias("stop"))
        return F.when(e.startswith(FLOAT), F.lit(None)).when(F.instr(text, e) > 0, at(e)).when(F.instr(text, s) > 0, at(s))

    given = F.coalesce(evidence, F.array().cast("array<string>"))

    def counted(spans: Column) -> Column:
        floats = F.size(F.filter(given, lambda e: F.coalesce(e.startswith(FLOAT), F.lit(False))))
        return F.struct(spans.alias("spans"), F.size(spans).alias("found"), floats.alias("float_selected"), (F.size(given) - F.size(spans) - floats).alias("not_found"))

    return bound(F.filter(F.transform(given, place), lambda x: x.isNotNull()), counted)


def questions(papers: DataFrame) -> DataFrame:
    """(paper_id, question_id, question, gold, found, float_selected, not_found, status) of every question of rendered papers.

    gold has the spans of each answer with located evidence. status is answered, unanswerable (all answers
    say so) or no_evidence. Unanswerable answers count nothing.
    """
    q = F.col("q")
    rows = papers.select("paper_id", "text", F.explode("qas").alias("q"))
    answers = F.coalesce(q["answers"], F.array().cast("array<struct<unanswerable:boolean,evidence:array<string>>>"))
    answerable = F.filter(answers, lambda a: ~F.coalesce(a["unanswerable"], F.lit(False)))
    rows = rows.select("paper_id", q["question_id"].alias("question_id"), q["question"].alias("question"), F.size(answerable).alias("n"), F.transform(answerable, lambda a: located(F.col("text"), a["evidence"])).alias("l"))
    total = lambda name: F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x[name]).alias(name)
    gold = F.transform(F.filter("l", lambda x: F.size(x["spans"]) > 0), lambda x: x["spans"])
    rows = rows.withColumn("gold", gold)
    status = F.when(F.size("gold") > 0, "answered").when(F.col("n") == 0, "unanswerable").otherwise("no_evidence")
    return rows.select("paper_id", "question_id", "question", "gold", *map(total, ("found", "float_selected", "not_found")), status.alias("status"))


def accounts(papers: DataFrame) -> DataFrame:
    """What was found and dropped in each rendered paper, zeros for one without questions."""
    q = questions(papers)
    per = q.groupBy("paper_id").agg(
        F.count("*").alias("n_questions"), F.sum("found").alias("found"), F.sum("float_selected").alias("float_selected"), F.sum("not_found").alias("not_found"),
        F.count_if(F.col("status") == "unanswerable").alias("n_unanswerable"), F.count_if(F.col("status") == "no_evidence").alias("n_no_evidence_located"),
    )
    return papers.select("paper_id").join(per, "paper_id", "left").na.fill(0)


def ranked_chunks(asked: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(paper_id, question_id, place, start, stop, n_tokens): the best chunks of each question's own paper, most at most.

    asked has paper_id, question_id and q, chunks have paper_id, start, stop, n_tokens and u; ties go to the
    chunk that starts first. A question of a paper without chunks has no rows.
    """
    scored = asked.select("paper_id", "question_id", "q").join(chunks, "paper_id").withColumn("score", F.round(dot("u", "q"), 6)).drop("u", "q")
    place = F.row_number().over(W.partitionBy("paper_id", "question_id").orderBy(F.desc("score"), "start", "stop"))
    return scored.withColumn("place", place).where(F.col("place") <= most)


def evidence_scores(ranked: DataFrame, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """(paper_id, question_id, budget, recall, precision) of each answered question at each budget.

    Chunks are taken in order until the first that doesn't fit. Of the annotators the one with the best
    recall counts, of equal ones the first. recall is null where gold has no length, precision where nothing
    was taken. gold has paper_id, question_id and gold. With at least one token a chunk, a budget's chunks are no
    more than its tokens, so rank that many.
    """
    used = F.sum("n_tokens").over(W.partitionBy("paper_id", "question_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    fit = ranked.withColumn("used", used).where(F.col("used") <= max(budgets))
    taken = fit.groupBy("paper_id", "question_id").agg(F.collect_list(F.struct("used", "start", "stop")).alias("taken"))
    rows = gold.where(F.size("gold") > 0).join(taken, ["paper_id", "question_id"], "left").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    span = lambda x: F.struct(x["start"].cast("long").alias("start"), x["stop"].cast("long").alias("stop"))
    within = F.transform(F.filter(F.coalesce("taken", F.array().cast("array<struct<used:long,start:long,stop:long>>")), lambda x: x["used"] <= F.col("budget")), span)
    rows = rows.withColumn("t", S.merged_array(within)).withColumn("g", F.transform("gold", S.merged_array))

    def score(g: Column, i: Column) -> Column:
        hit = S.array_overlap(g, F.col("t"))
        recall = F.try_divide(hit.cast("double"), S.array_length(g).cast("double"))
        return F.struct(F.coalesce(recall, F.lit(-1.0)).alias("key"), (-i).alias("first"), recall.alias("recall"), F.try_divide(hit.cast("double"), S.array_length(F.col("t")).cast("double")).alias("precision"))

    best = F.array_max(F.transform("g", score))
    return rows.withColumn("best", best).select("paper_id", "question_id", "budget", F.col("best.recall").alias("recall"), F.col("best.precision").alias("precision"))


def mean_scores(scores: DataFrame) -> DataFrame:
    """(budget, n, recall, precision): means of what isn't null."""
    return scores.groupBy("budget").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))
