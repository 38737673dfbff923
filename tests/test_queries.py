"""Registered queries against their oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLE = entry_points.oracle_sql()
SLOW = ("live", "x11", "x8", "x12")


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", [n for n in entry_points.queries() if n in ORACLE and not any(s in n for s in SLOW)])
def test_query_matches_oracle(spark, oracle, name):
    df = entry_points.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = oracle.execute(ORACLE[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "cer" in df.columns
