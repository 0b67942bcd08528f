"""Queries against their SQL on small tables made for a case."""

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.plans import registry


def both(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL) over tables, sorted, columns by name."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"file://{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(got, key=repr), sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr)


@pytest.fixture()
def spends(spark):
    """Replies without an answer whose costs reach the budget in three calls, the sums of doubles not."""
    ks = [(8, 71, 71, 9), (36, 43, 71, 9), (71, 8, 71, 60), (36, 71, 43, 1), (50, 50, 49, 70), (10, 20, 30, 80)]
    rows = [(6 * i + j, "purchase" if j == 3 else "view", 1.0, f'{{"k": {k}}}') for i, x in enumerate(ks) for j, k in enumerate(x)]
    return spark.createDataFrame(rows, "event_id long, event_type string, value double, props string")


def test_a_spend_that_equals_the_budget_reaches_it(spark, tmp_path, spends):
    got, want = both(spark, tmp_path, "answer_loop", events=spends)
    assert got == want


def test_summary_counts_a_spend_that_equals_the_budget(spark, tmp_path, spends):
    got, want = both(spark, tmp_path, "answer_summary", events=spends)
    assert got == want


def test_evidence_with_other_space_and_letters(spark, tmp_path):
    """The part of a text from its 20th character on begins or ends with a line or tab, or holds letters whose case changes their number."""
    parts = ["\n" + "word " * 5 + "tail", "word " * 5 + "tai\n\t", "\t" + "x" * 28 + "\r", "ſtraße İstanbul ΟΔΟΣ ﬁn ıµ ab", " " * 30, "Ͽς ŉ ǅ ΐ" + "a" * 22]
    rows = [(i, "a" * 19 + (parts[i % len(parts)] + "b" * 30)[:30] + ("e" if i % 4 else " ") * 20) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = both(spark, tmp_path, "evidence_locate", documents=docs)
    assert got == want


def test_articles_between_letters_beyond_ascii(spark, tmp_path):
    """An article that stands between two letters beyond ASCII is one; spaces beyond ASCII and their case are kept."""
    rows = [(1, "one two three éançré. Four, five six seven eight nine ten"), (2, "x one two three é çré four five six seven eight"), (3, "ΟΔΟΣ İ an b c d e f g h i the_j k l"), (4, "οδοσ i b c d e f g h i thej k l"), (5, None), (6, "a an the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    got, want = both(spark, tmp_path, "ngram8_leakage", documents=docs, benchmark=items)
    assert got == want and len(got) > 4
