import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barlake.operators.late_events import corrected_aggregates, late_rows

TS = "timestamp_ntz"
SCHEMA = f"chunk_id long, symbol string, time_start {TS}, time_end {TS}, min_price double, max_price double, row_count int, transaction_time_start {TS}, transaction_time_end {TS}, timestamps array<{TS}>, correction_transaction_times array<{TS}>, close_values array<double>, volume_values array<double>, late string, value int"
DAY = datetime(2024, 1, 10)
NAN = float("nan")


def chunk(i, symbol, ts, txn, volume, corr=True):
    t0 = txn[0] if corr and txn else (datetime(2024, 1, 1) if corr else None)
    return (i, symbol, None, None, 0.0, 0.0, len(ts), t0, t0, ts, txn if corr else None, [1.0] * len(ts), volume, "x", 1)


def test_cutoff_is_inclusive(spark):
    end = DAY + timedelta(days=1, hours=120)
    us = timedelta(microseconds=1)
    rows = [chunk(1, "A", [DAY + timedelta(hours=5)] * 3, [end - us, end, end + us], [1.0, 2.0, 3.0]), chunk(2, "A", [DAY], None, [9.0], False)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in late_rows(df).collect()] == [(1, 2)]
    assert corrected_aggregates(df).where("largest = 3").count() == 0


def brute(rows, cutoff=timedelta(hours=120)):
    last = {}
    for c in rows:
        corr = c[7] is not None or c[10] is not None
        for p, t in enumerate(c[9]):
            txn = c[10][p] if corr else t
            if c[1] is None or t is None or txn is None:
                continue
            day = datetime(t.year, t.month, t.day)
            if corr and txn > day + timedelta(days=1) + cutoff:
                continue
            key, order = (c[1], t), (txn, corr, c[0], p)
            if key not in last or last[key][0] < order:
                last[key] = (order, c[12][p], day)
    per = {}
    for (s, _), (_, v, day) in last.items():
        per.setdefault((s, day.date()), []).append(None if v is None or v != v else v)
    out = {}
    for k, vs in per.items():
        seen = [v for v in vs if v is not None]
        out[k] = (len(vs), len(seen), sum(seen), statistics.median(seen) if seen else None, len(set(seen)), min(seen, default=None), max(seen, default=None))
    return out


def test_aggregates_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        corr = i > 12
        n = r.randint(0, 6)
        ts = [r.choice([None] * (r.random() < 0.05) + [DAY + timedelta(days=r.randint(0, 3), hours=r.randint(0, 4))]) for _ in range(n)]
        txn = [None if r.random() < 0.05 else (t or DAY) + timedelta(days=r.choice([0, 1, 2, 6, 7, 9]), hours=r.randint(0, 3)) for t in ts]
        volume = [r.choice([None, NAN, 0.0, 5.0, 5.0, 7.0, 8.5]) for _ in ts]
        rows.append(chunk(i, r.choice(["A", "A", "B", None]), ts, txn, volume, corr))
    got = corrected_aggregates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x.symbol, x.day): tuple(x)[2:] for x in got} == brute(rows)


def test_null_lists_and_empty_tables(spark):
    nothing = (1, "A", None, None, 0.0, 0.0, 0, None, None, None, None, None, None, None, None)
    for rows in ([], [nothing], [chunk(2, "A", [], [], [])]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert late_rows(df).count() == corrected_aggregates(df).count() == 0


def test_unequal_lists_are_padded(spark):
    row = list(chunk(1, "A", [DAY, DAY + timedelta(hours=1)], None, [4.0], False))
    assert corrected_aggregates(spark.createDataFrame([tuple(row)], SCHEMA)).select("n_rows", "n_values", F.col("total")).first() == (2, 1, 4.0)
