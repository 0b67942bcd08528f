"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

from textloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    assert sorted(df.columns) == sorted(cols)
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall())
