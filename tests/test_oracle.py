"""Every graph query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from codeloom.plans import extraction, queries, questions, structure

DATA = os.environ.get("CODELOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def table(df):
    columns = sorted(df.columns)
    return df[columns].astype(str).sort_values(columns).reset_index(drop=True)


QUERIES = queries.QUERIES | questions.QUERIES | structure.QUERIES | extraction.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | questions.ORACLE_SQL | structure.ORACLE_SQL | extraction.ORACLE_SQL


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = table(QUERIES[name](spark, DATA).toPandas())
    want = table(duck.sql(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
