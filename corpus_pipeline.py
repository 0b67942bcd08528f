"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of documents. In every stage repeated rows are rows of their own, very long
texts are taken whole, other columns are carried along or not read, and an empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard_join, packing, quality, suffix_dedup, toxicity
from textloom.llm.common import cut, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text passes all rules. Null and empty texts go; a null id doesn't matter."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score is under one half, learned from the labelled rows among docs that are not held out.

    Null and empty texts stay; without labels of both kinds nothing is learned and all rows stay.
    """
    return toxicity.keep_civil(docs, toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the smallest id of their group of near duplicates; rows without words or without an id stay."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, texts without the bytes of repeated passages; n_chars follows the new text. A null text stays null."""
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece, with its place in a sequence; a null or empty text is the end token alone."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]

#: Token ids can't be had from SQL; tests/llm/test_contracts.py holds run() against five plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
