"""Every registered query with SQL against DuckDB on the smallest tables; all others run."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted(tuple(canon(r[c]) for c in columns) for r in got.collect())
    if name not in SQL:
        return
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(canon(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
