from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.operators import chunking, timeshards
from barlake.operators.store import BarStore
from barlake.operators.timeshards import with_shards
from barlake.plans import zonemap
from barlake.plans.predicate import Comparison, conjunction

ROWS = "symbol string, timestamp timestamp_ntz, close double, ingest_seq long"


def frame(spark, n=3000, symbols=3, seed=5, minutes=40):
    rng = np.random.default_rng(seed)
    out, t0 = [], datetime(2024, 1, 1)
    for s in range(symbols):
        size = n if s == 0 else n // 20
        at = np.cumsum(rng.exponential(minutes * 60e6, size)).astype(np.int64)
        out += [(f"S{s}", t0 + timedelta(microseconds=int(a)), float(i), s * n + i) for i, a in enumerate(at)]
    return spark.createDataFrame(out, ROWS)


def brute(rows, width):
    out, begun = {}, {}
    for s, t in sorted((r.symbol, r.timestamp) for r in rows):
        if s not in begun or t - begun[s] >= width:
            begun[s] = t
        out[s, t] = begun[s]
    return out


@pytest.mark.parametrize("target", [10**9, 300, 40])
@pytest.mark.parametrize("hours", [1, 30, 200])
def test_anchored_equals_brute_force_however_history_is_cut(spark, target, hours):
    df = frame(spark)
    width = timedelta(hours=hours)
    got = {(r.symbol, r.timestamp): r.chunk_start for r in chunking.anchored(df, width, target).collect()}
    assert got == brute(df.collect(), width)


def test_anchored_is_not_epoch_aligned(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("A", t0 + timedelta(seconds=s), 1.0, s) for s in (50, 70, 120)]
    sizes = chunking.anchored(spark.createDataFrame(rows, ROWS), timedelta(seconds=60)).groupBy("chunk_start").count().orderBy("chunk_start").collect()
    assert [r["count"] for r in sizes] == [2, 1]


def test_gap_equal_times_and_custom_rule(spark):
    t = [datetime(2024, 7, 3, 16), datetime(2024, 7, 8, 9, 30), datetime(2024, 7, 8, 9, 30)]
    df = spark.createDataFrame([("A", x, 1.0, i) for i, x in enumerate(t)], ROWS)
    for cut in (chunking.anchored(df, timedelta(days=1)), chunking.custom(df, lambda a, b: b - a >= timedelta(days=1))):
        assert sorted(r["count"] for r in cut.groupBy("chunk_start").count().collect()) == [1, 2]
    with pytest.raises(ValueError):
        chunking.anchored(df, timedelta(0))


def test_null_keys_and_empty_table(spark):
    df = spark.createDataFrame([(None, datetime(2024, 1, 1), 1.0, 1), ("A", None, 1.0, 2)], ROWS)
    assert chunking.monthly(df).count() == chunking.anchored(df, timedelta(hours=1)).count() == 0


@pytest.mark.parametrize("shipped", [50_000, 0])
def test_shards_own_each_row_once_and_bring_the_neighbours(spark, shipped, monkeypatch):
    """Whether the plan of shards is small enough to be shipped or is joined by key."""
    monkeypatch.setattr(timeshards, "PLAN_ROWS", shipped)
    df = frame(spark)
    out = with_shards(df, "symbol", "timestamp", target_rows=400, halo_rows=25).toPandas()
    own = out[out._own]
    assert len(own) == df.count() and own.ingest_seq.is_unique and own[own.symbol == "S0"]._shard.nunique() > 4
    assert (out[out.symbol != "S0"]._shard == 0).all()
    for shard, part in out[out.symbol == "S0"].sort_values("timestamp").groupby("_shard"):
        mine = part[part._own]
        before, after = part[part.timestamp < mine.timestamp.min()], part[part.timestamp > mine.timestamp.max()]
        every = own[own.symbol == "S0"]
        assert len(before) >= min(25, (every.timestamp < mine.timestamp.min()).sum())
        assert len(after) >= min(25, (every.timestamp > mine.timestamp.max()).sum())


def test_zone_bounds_ignore_nan(spark):
    nan, t = float("nan"), datetime(2024, 1, 1)
    a = [("A", t, c, i) for i, c in enumerate([nan, 100.0, None, 90.0, 110.0, nan])]
    b = [("M", t, nan, 10 + i) for i in range(6)]
    z = zonemap.build(chunking.monthly(spark.createDataFrame(a + b, ROWS)))
    got = {r.symbol: (r.min_price, r.max_price, r.row_count) for r in z.collect()}
    assert got == {"A": (90.0, 110.0, 6), "M": (float("inf"), float("-inf"), 6)}
    for p, n in ((Comparison("close", ">=", 0.0), 1), (Comparison("close", ">", 110.0), 0), (Comparison("close", ">=", nan), 0), (Comparison("volume", ">", 1.0), 2), (Comparison("symbol", "<", "B"), 2)):
        assert zonemap.Pushdown(zonemap.mark_candidates(z, p)).candidate_count == n


def test_pushdown_counts(spark):
    rows = [(s, datetime(2024, m, 5), 100.0 * m, 100.0 * m, 100.0 * m, 100.0 * m, 1.0, m) for s in ("AAPL", "MSFT") for m in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, ingest_seq long")
    s = BarStore(df)
    p = s.pushdown(conjunction([Comparison("symbol", "=", "AAPL"), Comparison("timestamp", ">=", datetime(2024, 2, 1)), Comparison("close", "<", 350.0)]))
    assert (p.total_chunks, p.candidate_count, p.chunks_skipped_ratio) == (8, 2, 0.75)
    assert p.candidate_chunk_ids.count() == 2 and p.skipped_chunk_ids.count() == 6
    assert s.pushdown(conjunction([]), datetime(2024, 2, 5)).candidate_count == 4


def test_coarser_compaction_merges_more(spark):
    cols = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, ingest_seq long"
    base = spark.createDataFrame([("A", datetime(2022, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 0)], cols)
    late = [("A", datetime(2022, 1, 1) + timedelta(days=60 * k), 1.0, 1.0, 1.0, 1.0, 1.0, k, datetime(2025, 1, 1)) for k in range(1, 14)]
    late += [("B", datetime(2022, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 99, datetime(2025, 1, 1))]
    s = BarStore(base, spark.createDataFrame(late, f"{cols}, txn_time timestamp_ntz"))
    assert [(r.symbol, r.before, r.after) for r in s.compact()[1].collect()] == [("A", 13, 13)]
    wide, counts = s.compact(boundary=timedelta(days=1000))
    assert [(r.symbol, r.before, r.after) for r in counts.collect()] == [("A", 13, 1)]
    assert wide.zones().where(F.col("txn_start").isNotNull()).count() == 2
    assert wide.compact(symbol="B")[1].count() == 0
