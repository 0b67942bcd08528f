"""Structure of documents: headings, sections, front matter, and how chunks lie on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.answers import mid_word
from textloom.functions.sampling import draw_key, sample_rows
from textloom.functions.text import parse_date, strip

# Heading patterns and names, front matter patterns, words that point back.
MARKDOWN = r"^(#{1,6})\s+(\S.*?)\s*$"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*?)\s*$"
CHAPTER = r"^(CHAPTER|Chapter|BOOK|Book|PART|Part)\s+([IVXLCDM]+|\d+|[A-Za-z]+)\b.*$"
KNOWN = ("abstract", "introduction", "background", "related work", "methods", "materials and methods", "results", "discussion", "conclusion", "conclusions", "references", "acknowledgments", "acknowledgements")
START_MARK = r"(?i)\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
LABEL = r"^\s*([A-Za-z][A-Za-z ]*?):\s*(.*)$"
HEADER = r"(?i)^The Project Gutenberg e-?book of (.+?)(?:, by .*)?$"
DANGLING = ("it", "its", "this", "these", "those", "they", "their", "such", "however", "moreover", "therefore", "furthermore", "he", "she")


def heading(line: Column) -> Column:
    """struct(level, title) of a line that is a heading, else null: markdown, numbered, chapter or a known name, in this order.

    A numbered line of over 10 words or with a full stop at its end is none, nor is a chapter line of over 8 words.
    """
    words = lambda c: F.size(F.split(strip(c), r"\s+"))
    as_struct = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"))
    number, rest = F.regexp_extract(line, NUMBERED, 1), F.regexp_extract(line, NUMBERED, 2)
    name = F.lower(F.rtrim(strip(line), F.lit(".:")))
    return (
        F.when(line.rlike(MARKDOWN), as_struct(F.length(F.regexp_extract(line, MARKDOWN, 1)), F.regexp_extract(line, MARKDOWN, 2)))
        .when(line.rlike(NUMBERED), F.when((words(rest) <= 10) & ~rest.endswith("."), as_struct(F.length(number) - F.length(F.replace(number, F.lit("."))) + 1, rest)))
        .when(line.rlike(CHAPTER), F.when(words(line) <= 8, as_struct(F.when(F.upper(F.regexp_extract(line, CHAPTER, 1)).isin("BOOK", "PART"), 1).otherwise(2), strip(line))))
        .when(name.isin(*KNOWN), as_struct(F.lit(1), strip(line)))
    )


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, start, level, title) of the lines of (doc_id, text) that are headings; start is the line's first character."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.sum(F.length("line") + 1).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    rows = lines.select("doc_id", F.coalesce(before, F.lit(0)).alias("start"), heading(F.regexp_replace("line", "\r$", "")).alias("h"))
    return rows.where("h IS NOT NULL").select("doc_id", "start", "h.level", "h.title")


def sections(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, start, stop, level, title, path) from headings and (doc_id, n), the lengths of documents.

    A section ends where the next heading of its level or a higher one starts, else with the document;
    its path holds the titles that it lies in, and its own. An ordered fold over the headings of a
    document; no text is moved.
    """
    per = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "level", "title"))).alias("h")).join(lengths.select("doc_id", "n"), "doc_id")
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[list] = []
            for doc, h, n in zip(b["doc_id"], b["h"], b["n"], strict=True):
                open_ones: list[list] = []
                for x in h:
                    while open_ones and open_ones[-1][3] >= x["level"]:
                        open_ones.pop()[2] = x["start"]
                    row = [doc, x["start"], n, x["level"], x["title"], [*(o[4] for o in open_ones), x["title"]]]
                    open_ones.append(row)
                    rows.append(row)
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "level", "title", "path"])

    return per.mapInPandas(run, f"doc_id {kind}, start long, stop long, level int, title string, path array<string>")


def front_matter(t: Column, lines: int = 100) -> Column:
    """The text before the start marker, else its first lines."""
    mark = F.regexp_instr(t, F.lit(START_MARK))
    return F.when(mark > 0, F.substring(t, F.lit(1), (mark - 1).cast("int"))).otherwise(F.array_join(F.slice(F.split(t, r"\r?\n"), 1, lines), "\n"))


def label_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, label, pos, value) of front matter: the first line of each label and the indented lines that continue it."""
    lines = docs.select("doc_id", F.posexplode(F.split(front_matter(F.col("text")), "\n")).alias("pos", "line")).where(strip(F.regexp_replace("line", r"\s", " ")) != "")
    label = F.when(F.col("line").rlike(LABEL), F.lower(strip(F.regexp_extract("line", LABEL, 1))))
    lines = lines.withColumn("label", label).withColumn("more", F.col("label").isNull() & F.col("line").rlike(r"^\s"))
    first = F.row_number().over(W.partitionBy("doc_id", "label").orderBy("pos")) == 1
    lines = lines.withColumn("opens", F.when(~F.col("more"), F.struct(F.when(F.col("label").isNotNull() & first, F.col("label")).alias("label"))))
    lines = lines.withColumn("under", F.last("opens", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))["label"])
    value = F.when(F.col("more"), strip("line")).otherwise(strip(F.regexp_extract("line", LABEL, 2)))
    return lines.where("under IS NOT NULL").select("doc_id", F.col("under").alias("label"), F.col("pos").cast("long").alias("pos"), value.alias("value"))


def book_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, title, title_from, authors, date, date_raw, date_from) of each document of (doc_id, text); what isn't found is null."""
    of = lambda label: F.transform(F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct("pos", "value")))), lambda x: x["value"])
    labels = {"title": "title", "author": "author", "release": "release date", "posting": "posting date"}
    found = label_lines(docs).groupBy("doc_id").agg(*[of(v).alias(k) for k, v in labels.items()])
    top = F.try_element_at(F.filter(F.split("text", r"\r?\n"), lambda x: strip(x) != ""), F.lit(1))
    rows = docs.select("doc_id", F.when(top.rlike(HEADER), strip(F.regexp_extract(top, HEADER, 1))).alias("top")).join(found, "doc_id", "left")
    has = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    names = F.filter(F.transform(F.flatten(F.transform("author", lambda a: F.split(a, " and "))), lambda x: strip(x)), lambda x: x != "")
    raw = F.when(has("release"), F.element_at("release", 1)).when(has("posting"), F.element_at("posting", 1))
    return rows.select(
        "doc_id", F.when(has("title"), F.array_join("title", " ")).otherwise(F.col("top")).alias("title"),
        F.when(has("title"), "label:title").when(F.col("top").isNotNull(), "header_line").otherwise("not_found").alias("title_from"), F.when(has("author"), names).alias("authors"),
        parse_date(raw).alias("date"), raw.alias("date_raw"), F.when(has("release"), "label:release date").when(has("posting"), "label:posting date").otherwise("not_found").alias("date_from"),
    )


def boundary_stats(chunks: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: (cuts, end_aligned, start_aligned, mid_word, dangling), shares of internal cuts; null without any.

    chunks: (doc_id, chunk_index, start, stop, text); spans: sentences (doc_id, start, stop). A document
    of n chunks has n - 1 internal cuts. Texts meet an array of their cuts once.
    """
    order = W.partitionBy("doc_id").orderBy("chunk_index")
    rows = chunks.withColumns({"_first": F.row_number().over(order) == 1, "_last": F.lead("chunk_index").over(order).isNull()})
    word = F.lower(F.regexp_extract("text", r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1))
    starts = rows.where(~F.col("_first")).select("doc_id", F.col("start").alias("at"), word.isin(*DANGLING).alias("dangling"))
    ends = rows.where(~F.col("_last")).select("doc_id", F.col("stop").alias("at"))
    known = lambda c: spans.select("doc_id", F.col(c).alias("at"), F.lit(1).alias("hit")).distinct()
    s = starts.join(known("start"), ["doc_id", "at"], "left").agg(F.count("*").alias("cuts"), F.count("hit").alias("a"), F.count_if("dangling").alias("d"))
    e = ends.join(known("stop"), ["doc_id", "at"], "left").agg(F.count("hit").alias("b"))
    cuts = ends.groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    m = docs.select("doc_id", "text").join(cuts, "doc_id").agg(F.coalesce(F.sum(F.size(F.filter("at", lambda x: mid_word(F.col("text"), x)))), F.lit(0)).alias("m"))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("cuts").cast("double"))
    return s.crossJoin(e).crossJoin(m).select("cuts", share("b").alias("end_aligned"), share("a").alias("start_aligned"), share("m").alias("mid_word"), share("d").alias("dangling"))


def pieces(chunks: DataFrame, spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, piece, text): sentence spans clipped to their chunk, without outer spaces; blank ones are dropped.

    A span that ends where the chunk starts is not part of it; a join on the document, then the interval.
    """
    x = chunks.select("doc_id", "chunk_index", F.col("start").alias("c0"), F.col("stop").alias("c1"))
    at = x.join(spans.select("doc_id", "start", "stop"), "doc_id").where("start <= c1 AND stop > c0")
    at = at.select("doc_id", "chunk_index", F.greatest("start", "c0").alias("a"), F.least("stop", "c1").alias("b"))
    per = at.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "a", "b"))).alias("p"))
    cut = docs.select("doc_id", "text").join(per, "doc_id").select("doc_id", F.explode(F.transform("p", lambda p: F.struct(p["chunk_index"].alias("chunk_index"), p["a"].alias("a"), strip(F.substring("text", (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))).alias("text")))).alias("p"))
    rows = cut.select("doc_id", "p.*").where("text <> ''")
    return rows.select("doc_id", "chunk_index", (F.row_number().over(W.partitionBy("doc_id", "chunk_index").orderBy("a")) - 1).alias("piece"), "text")


def coherence(parts: DataFrame, chunks: DataFrame, embed: Callable) -> DataFrame:
    """(doc_id, chunk_index, score): the mean inner product of a chunk's vector with those of its pieces; null under two pieces.

    embed turns a list of texts into rows of unit vectors, a batch at a time.
    """
    rows = parts.groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("p"))
    rows = chunks.select("doc_id", "chunk_index", "text").join(rows, ["doc_id", "chunk_index"], "left")

    @F.pandas_udf("double")
    def scores(texts: pd.Series, lists: pd.Series) -> pd.Series:
        found = []
        for text, p in zip(texts, lists, strict=True):
            found.append(float((embed([x["text"] for x in p]) @ embed([text])[0]).mean()) if p is not None and len(p) > 1 else None)
        return pd.Series(found, dtype=object)

    return rows.select("doc_id", "chunk_index", scores("text", "p").alias("score"))


def summary_without_nan(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: (n, n_nan, mean, p5, p50, p95); NaN and null scores count in n and n_nan only."""
    bad = F.isnan(score) | F.col(score).isNull()
    good = F.when(~bad, F.col(score))
    return scores.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_nan"), F.avg(good).alias("mean"), *[F.percentile(good, F.lit(p)).alias(name) for p, name in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))])


def random_chunks(spans: DataFrame, docs: DataFrame, sizes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(chunk_index, piece, text): up to n made-up chunks, each of sentences of as many documents as a row of sizes (k) says.

    A baseline for coherence. The documents with the smallest draw keys are dealt out to the chunks,
    so no document is used twice; with fewer documents than the chunks could ask for there are fewer
    chunks. The windows see n rows for each sentence of the largest size at most.
    """
    most = sizes.agg(F.max("k")).first()[0] or 0
    if not most:
        return docs.select(F.lit(0).alias("chunk_index"), F.lit(0).alias("piece"), "text").limit(0)
    number = lambda rows, *ids: F.row_number().over(W.orderBy(draw_key(seed, *ids), *ids)) - 1
    k = sample_rows(sizes.select("doc_id", "chunk_index", "k"), n, seed, "doc_id", "chunk_index")
    k = k.select(number(k, "doc_id", "chunk_index").alias("chunk_index"), "k")
    ids = sample_rows(spans.select("doc_id").distinct(), n * most, seed, "doc_id")
    dealt = ids.withColumn("_i", number(ids, "doc_id")).select("doc_id", F.expr(f"_i DIV {most}").cast("int").alias("chunk_index"), (F.col("_i") % most).alias("piece"))
    dealt = dealt.join(k, "chunk_index").where("piece < k")
    one = dealt.join(spans, "doc_id").groupBy("chunk_index", "piece", "doc_id").agg(F.min_by(F.struct("start", "stop"), draw_key(seed, "doc_id", "start")).alias("s"))
    text = F.substring("text", (F.col("s.start") + 1).cast("int"), (F.col("s.stop") - F.col("s.start")).cast("int"))
    return one.join(docs.select("doc_id", "text"), "doc_id").select("chunk_index", "piece", text.alias("text"))
