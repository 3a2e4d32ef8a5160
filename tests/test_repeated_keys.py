"""Tables in which two events of one kind share an instant: what is loaded from files is still every row."""

import duckdb
import pytest

from tests.test_queries import QUERIES, SQL, canon


@pytest.fixture(scope="module")
def twice(spark, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("twice"))
    e = spark.read.parquet(f"{small}/events.parquet")
    e.unionByName(e.withColumn("event_id", e.event_id + 1_000_000)).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["csv_round_trip", "single_symbol_load", "command_line"])
def test_repeated_keys_are_loaded_whole(spark, twice, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{twice}/events.parquet/*.parquet'")
    want, got = con.sql(SQL[name]), QUERIES[name](spark, twice)
    rows = sorted(tuple(canon(r[c]) for c in want.columns) for r in got.collect())
    assert rows == sorted(tuple(map(canon, r)) for r in want.fetchall()) and rows
