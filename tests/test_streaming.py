from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlake.streaming.chunker import chunk_stream

SCHEMA = "symbol string, timestamp timestamp_ntz, close double, ingest_seq long, end_of_stream boolean"
T0 = datetime(2024, 1, 31, 22)


def play(spark, tmp_path, batches, **kw):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = chunk_stream(stream, **kw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    t = F.date_format("time_start", "dd HH:mm")
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("symbol", t, "min_price", "max_price", "row_count", "status").collect()))


def row(minutes, close, seq, symbol="A"):
    return (symbol, T0 + timedelta(minutes=minutes), close, seq, False)


def test_months_close_when_crossed_and_nan_bounds_nothing(spark, tmp_path):
    out = play(spark, tmp_path, [[row(0, 5.0, 1), row(60, float("nan"), 2), row(119, 3.0, 3), row(120, 9.0, 4)]])
    assert out == [("A", "31 22:00", 3.0, 5.0, 3, "closed")]


def test_late_rows_are_set_apart_or_fail(spark, tmp_path):
    rows = [[row(0, 5.0, 1), row(10, 6.0, 2), row(9, 7.0, 3), row(10, 8.0, 4), row(80, 1.0, 5)]]
    out = play(spark, tmp_path / "a", rows, width=timedelta(hours=1), strict=False)
    assert out == [("A", "31 22:00", 5.0, 8.0, 3, "closed"), ("A", "31 22:09", 7.0, 7.0, 1, "late")]
    with pytest.raises(Exception, match="non-decreasing order"):
        play(spark, tmp_path / "b", rows, width=timedelta(hours=1))
