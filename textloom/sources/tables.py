"""Table access: parquet tables by name, JSONL, TSV and text sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import strip

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"
QRELS = "qid string, doc_id string, rel int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) from JSONL; text is the title, a space and the trimmed body."""
    rows = spark.read.schema(CORPUS).json(path)
    return rows.select(F.col("_id").alias("doc_id"), "title", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), strip(F.coalesce("text", F.lit("")))).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).json(path).select(F.col("_id").alias("qid"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) from a tab-separated file with a header."""
    return spark.read.schema(QRELS).csv(path, sep="\t", header=True)


def read_code_files(spark: SparkSession, folder: str, pattern: str = "*.py", min_chars: int = 500, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(path, text): whole files under folder, without paths that hold a blocked part and short files."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = rows.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(F.length("text") >= min_chars)
    for part in blocked:
        rows = rows.where(~F.col("path").contains(f"/{part}/"))
    return rows


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer, gold): gold is the number after the last ####, without commas."""
    rows = spark.read.schema("question string, answer string").json(path)
    last = F.element_at(F.split("answer", "####"), -1)
    return rows.withColumn("gold", F.regexp_replace(strip(last), ",", "").try_cast("double"))


def code_corpus(files: DataFrame, limit_chars: int) -> DataFrame:
    """(path, text): whole files in the order of their paths, as many as fit limit_chars.

    Running sums by partition see one number a file; texts are joined back by path.
    """
    from textloom.operators.token_stream import offsets

    placed = offsets(files.select("path", F.length("text").cast("long").alias("n")), ["path"], "n")
    return files.join(placed.where(F.col("offset") + F.col("n") <= limit_chars).select("path"), "path")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, label) from a CSV file with the header text,label; label in lower case, id in the order of the file's hash."""
    rows = spark.read.schema("text string, label string").csv(path, header=True, multiLine=True, escape='"')
    return rows.select(F.substring(F.sha2(F.concat_ws("\u0001", "text", "label"), 256), 1, 16).alias("id"), "text", F.lower(strip("label")).alias("label"))


def label_list(rows: DataFrame) -> list[str]:
    """The distinct labels in order."""
    return [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(id, tokens, tags) from JSON lines of token and tag arrays; rows whose arrays differ in length raise an error when read."""
    rows = spark.read.schema("id string, tokens array<string>, tags array<string>").json(path)
    same = F.size("tokens") == F.size("tags")
    return rows.withColumn("tags", F.when(same, F.col("tags")).otherwise(F.raise_error(F.concat(F.lit("tokens and tags differ in "), F.coalesce("id", F.lit("a row"))))))


def entities_of_tags(rows: DataFrame) -> DataFrame:
    """(id, entities array<struct(text, type)>): runs of B-X and I-X tags, joined by spaces; an I-X of another type starts a run too."""
    at = rows.select("id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "x")).select("id", "pos", F.col("x.tokens").alias("token"), F.col("x.tags").alias("tag"))
    w = W.partitionBy("id").orderBy("pos")
    kind = F.when(F.col("tag") != "O", F.substring("tag", 3, 100))
    at = at.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    starts = F.col("kind").isNotNull() & (F.col("tag").startswith("B-") | ~F.col("kind").eqNullSafe(F.col("before")))
    runs = at.withColumn("run", F.sum(starts.cast("int")).over(w)).where("kind IS NOT NULL")
    per = runs.groupBy("id", "run").agg(F.min("pos").alias("pos"), F.first("kind").alias("type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), " ").alias("text"))
    found = per.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text", "type"))), lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type"))).alias("entities"))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("entities", F.array().cast("array<struct<text:string,type:string>>")).alias("entities"))


def read_hops(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answer, titles, texts) of JSON lines with a context of titles and sentence lists."""
    rows = spark.read.schema("id string, question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>").json(path)
    return rows.select("id", "question", "answer", F.col("context.title").alias("titles"), F.transform("context.sentences", lambda s: F.array_join(s, "")).alias("texts"))


def context_paragraphs(titles, texts):
    """Column: 'title: text' of each pair, with a blank line between."""
    return F.array_join(F.zip_with(titles, texts, lambda t, x: F.concat(t, F.lit(": "), x)), "\n\n")


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, the queries that have judgements, and judgements of a folder in the usual layout."""
    qrels = read_qrels(spark, f"{folder}/qrels/{split}.tsv")
    return read_corpus(spark, f"{folder}/corpus.jsonl"), read_queries(spark, f"{folder}/queries.jsonl").join(qrels.select("qid").distinct(), "qid", "left_semi"), qrels


def read_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all JSON files in folder with run, the file's name without its ending."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.json*").json(folder)
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.jsonl?$", 1))


def run_ids(runs: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """The runs there are, in order; of wanted ones those, and an error for any that is missing."""
    known = [r["run"] for r in runs.select("run").distinct().orderBy("run").collect()]
    if wanted is None:
        return known
    if missing := [w for w in wanted if w not in known]:
        raise ValueError(f"no run {', '.join(missing)}")
    return [w for w in wanted if w in known]
