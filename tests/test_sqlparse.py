from datetime import datetime, timedelta, timezone

import pytest

from barlake.errors import UnsupportedQueryError
from barlake.plans.predicate import AlwaysTrue, And, Comparison, In
from barlake.plans.sqlparse import parse

D = datetime(2024, 1, 10)


@pytest.mark.parametrize(
    "where, tree",
    [
        ("symbol = 'AAPL'", Comparison("symbol", "=", "AAPL")),
        ("price > 150", Comparison("close", ">", 150.0)),
        ("150 < Price", Comparison("close", ">", 150.0)),
        ("100 >= close", Comparison("close", "<=", 100.0)),
        ("t.close = -3.5", Comparison("close", "=", -3.5)),
        ("volume >= 1e3", Comparison("volume", ">=", 1000.0)),
        ("symbol IN ('A', 'B''C')", In("symbol", ("A", "B'C"))),
        ("\"symbol\" = 'x'", Comparison("symbol", "=", "x")),
        ("symbol = 'TIMESTAMP AS OF'", Comparison("symbol", "=", "TIMESTAMP AS OF")),
        ("date = '2024-01-10'", And((Comparison("timestamp", ">=", D), Comparison("timestamp", "<", D + timedelta(days=1))))),
        ("date <= '2024-01-10'", Comparison("timestamp", "<=", D)),
        ("timestamp = '2024-01-10T00:00:00'", Comparison("timestamp", "=", D)),
        ("timestamp >= '2024-01-10T00:00:00Z'", Comparison("timestamp", ">=", D.replace(tzinfo=timezone.utc))),
        ("symbol = 'A' AND (close > 1 AND volume <= 5)", And((Comparison("symbol", "=", "A"), Comparison("close", ">", 1.0), Comparison("volume", "<=", 5.0)))),
        ("timestamp IN ('2024-01-10 00:00:00')", In("timestamp", (D,))),
    ],
)
def test_conditions(spark, where, tree):
    assert parse(spark, f"SELECT * FROM data t WHERE {where}") == (tree, None)


@pytest.mark.parametrize("table", ["data", "db.data", "data /* TIMESTAMP AS OF 'x' */"])
def test_no_condition(spark, table):
    assert parse(spark, f"select * from {table}") == (AlwaysTrue(), None)


def test_as_of(spark):
    assert parse(spark, "SELECT * FROM db.data TIMESTAMP AS OF '2024-01-10' WHERE close > 1")[1] == D
    aware = parse(spark, "SELECT * FROM data TIMESTAMP AS OF '2024-01-10T02:00:00+02:00'")[1]
    assert aware.astimezone(timezone.utc) == D.replace(tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "sql, message",
    [
        ("SELECT * FROM d WHERE symbol = 'a' OR close > 1", "OR across columns is not supported"),
        ("SELECT * FROM (SELECT * FROM d)", "Subqueries are not supported"),
        ("SELECT * FROM d WHERE EXISTS (SELECT 1 FROM e)", "Subqueries are not supported"),
        ("SELECT * FROM d WHERE symbol IN (SELECT symbol FROM e)", "Subqueries are not supported"),
        ("SELECT * FROM d JOIN e ON d.symbol = e.symbol", "JOINs are not supported"),
        ("SELECT count(*) FROM d", "Aggregation functions are not supported"),
        ("SELECT max(close) OVER () FROM d", "Aggregation functions are not supported"),
        ("SELECT * FROM d WHERE close BETWEEN 1 AND 2", "Unsupported expression type"),
        ("SELECT * FROM d WHERE NOT close > 1", "Unsupported expression type"),
        ("SELECT * FROM d WHERE symbol <> 'a'", "Unsupported expression type"),
        ("SELECT * FROM d WHERE close IS NULL", "Unsupported expression type"),
        ("SELECT * FROM d ORDER BY close", "Unsupported expression type"),
        ("SELECT * FROM d LIMIT 3", "Unsupported expression type"),
        ("SELECT DISTINCT * FROM d", "Unsupported expression type"),
        ("SELECT symbol FROM d", "Unsupported expression type"),
        ("SELECT * FROM d UNION ALL SELECT * FROM e", "Unsupported expression type"),
        ("SELECT * FROM d WHERE close = open", "comparisons require exactly one column and one literal"),
        ("SELECT * FROM d WHERE 1 = 1", "comparisons require exactly one column and one literal"),
        ("SELECT * FROM d WHERE close > abs(1)", "expected a literal"),
        ("SELECT * FROM d WHERE abs(close) > 1", "expected a column reference"),
        ("SELECT * FROM d WHERE date IN ('2024-01-10')", "IN with date-only literals is not supported"),
        ("SELECT * FROM d TIMESTAMP AS OF symbol", "AS OF requires a literal"),
        ("SELECT * FROM d TIMESTAMP AS OF 5", "AS OF requires a literal"),
        ("SELECT * FROM d VERSION AS OF 5", "only TIMESTAMP AS OF is supported"),
    ],
)
def test_rejected(spark, sql, message):
    with pytest.raises(UnsupportedQueryError, match=message):
        parse(spark, sql)


@pytest.mark.parametrize("where, message", [("nope = 1", "unknown column"), ("date > 'soon'", "invalid datetime literal"), ("close > 'much'", "invalid floating-point literal")])
def test_bad_values(spark, where, message):
    with pytest.raises(ValueError, match=message):
        parse(spark, f"SELECT * FROM d WHERE {where}")
