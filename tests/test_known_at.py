import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barlake.operators.known_at import FOREVER, LEAF_BITS, known_close, leaf_bits, leaking_signals, nodes_of_instant, nodes_of_interval
from tests.test_late_events import SCHEMA

SIGNALS = "signal_id long, symbol string, decided_at timestamp_ntz, close_used double, known_close string, level int"
T0 = datetime(2024, 1, 10)
NAN = float("nan")


def chunk(i, symbol, ts, txn, close, corr):
    t0 = T0 if corr else None
    return (i, symbol, None, None, 0.0, 0.0, len(ts), t0, t0, ts, txn if corr else None, close, close, "x", 1)


def test_nodes_cover_exactly_once(spark):
    leaf = 1 << LEAF_BITS
    r = random.Random(2)
    spans = [(a * leaf + r.randint(0, leaf - 1), b * leaf + r.randint(1, leaf - 1)) for a, b in [(0, 0), (1, 2), (5, 77), (1000, 1001), (3, 100_000)]] + [(7 * leaf, FOREVER), (4 * leaf, 8 * leaf)]
    for a, b in spans:
        ends = [a, b - 1, (a + b) // 2]
        df = spark.createDataFrame([(a, b, t, int(a // leaf <= t // leaf <= (b - 1) // leaf)) for t in ends + [max(a - leaf, 0), min(b + leaf, FOREVER - 1)]], "a long, b long, t long, inside int")
        hits = df.withColumn("n", F.size(F.array_intersect(nodes_of_interval(F.col("a"), F.col("b")), nodes_of_instant(F.col("t")))))
        assert hits.where("n != inside").count() == 0, (a, b)
        assert hits.select(F.size(nodes_of_interval(F.col("a"), F.col("b"))).alias("n")).first().n <= 40


def brute(chunks, signals):
    out = {}
    for s in signals:
        best = None
        for c in chunks:
            corr = c[7] is not None
            for p, t in enumerate(c[9]):
                txn = c[10][p] if corr else t
                if c[1] is None or c[1] != s[1] or s[2] is None or t is None or txn is None or t > s[2] or txn > s[2]:
                    continue
                key = (t, txn, corr, c[0], p)
                if best is None or key > best[0]:
                    best = (key, c[11][p])
        v = best[1] if best else None
        out[s[0]] = None if v is None or v != v else v
    return out


def test_known_close_equals_brute_force(spark):
    r = random.Random(8)
    days = lambda: timedelta(days=r.randint(0, 80), hours=r.choice([0, 16]))
    chunks, signals = [], []
    for i in range(50):
        corr = i >= 15
        ts = [None if r.random() < 0.04 else T0 + days() for _ in range(r.randint(0, 7))]
        txn = [None if r.random() < 0.04 else (t or T0) + timedelta(days=r.choice([-1, 0, 0, 1, 5, 40])) for t in ts]
        chunks.append(chunk(i, r.choice(["A", "A", "A", "B", None]), ts, txn, [r.choice([None, NAN, 1.0, 2.0, 3.0, 4.0]) for _ in ts], corr))
    for i in range(300):
        signals.append((i, r.choice(["A", "B", "C", None]), None if r.random() < 0.02 else T0 + days() + timedelta(microseconds=r.choice([-1, 0, 1])), r.choice([None, NAN, 1.0, 2.0]), "x", 1))
    want = brute(chunks, signals)
    c, s = spark.createDataFrame(chunks, SCHEMA), spark.createDataFrame(signals, SIGNALS)
    assert {x.signal_id: x.known_close for x in known_close(s, c).collect()} == want
    used = {x[0]: None if x[3] is None or x[3] != x[3] else x[3] for x in signals}
    assert {x.signal_id for x in leaking_signals(s, c).collect()} == {k for k in want if want[k] != used[k]}


def test_splitting_busy_nodes_changes_nothing(spark):
    r = random.Random(9)
    rows = [T0 + timedelta(hours=k * 7) for k in range(60)]
    chunks = [chunk(1, "H", rows[:50], None, [float(k) for k in range(50)], False), chunk(2, "T", [T0], None, [7.0], False)]
    signals = [(i, "H" if i % 10 else "T", T0 + timedelta(minutes=r.randint(-500, 60_000)), None, "x", 1) for i in range(800)]
    c, s = spark.createDataFrame(chunks, SCHEMA), spark.createDataFrame(signals, SIGNALS)
    want = brute(chunks, signals)
    for most in (3, 40, 50_000):
        assert {x.signal_id: x.known_close for x in known_close(s, c, node_events=most).collect()} == want


def test_leaves_follow_the_busiest_source(spark):
    minute = [T0 + timedelta(minutes=k) for k in range(2000)]
    c = spark.createDataFrame([chunk(1, "M", minute, None, [1.0] * 2000, False)], SCHEMA).withColumns({"time_start": F.lit(minute[0]).cast("timestamp_ntz"), "time_end": F.lit(minute[-1]).cast("timestamp_ntz"), "row_count": F.lit(2000)})
    assert 1 << leaf_bits(c) <= 60_000_000 < 1 << (leaf_bits(c) + 2)
    signals = [(i, "M", T0 + timedelta(seconds=i * 50, microseconds=i % 3 - 1), None, "x", 1) for i in range(1, 1000)]
    got = {x.signal_id: x.known_close for x in known_close(spark.createDataFrame(signals, SIGNALS), c).collect()}
    assert all(v == 1.0 for v in got.values()) and len(got) == 999


def test_precedence_at_equal_times(spark):
    late = T0 + timedelta(days=1)
    chunks = [chunk(1, "A", [T0], None, [1.0], False), chunk(5, "A", [T0, T0], [T0, T0], [2.0, 3.0], True), chunk(4, "A", [T0], [T0], [9.0], True), chunk(6, "A", [T0], [late], [4.0], True)]
    signals = [(1, "A", T0 - timedelta(microseconds=1), None, "x", 1), (2, "A", T0, 3.0, "x", 1), (3, "A", late - timedelta(microseconds=1), 3.0, "x", 1), (4, "A", late, 3.0, "x", 1)]
    c, s = spark.createDataFrame(chunks, SCHEMA), spark.createDataFrame(signals, SIGNALS)
    assert [r.known_close for r in known_close(s, c).orderBy("signal_id").collect()] == [None, 3.0, 3.0, 4.0]
    assert [r.signal_id for r in leaking_signals(s, c).collect()] == [4]


def test_empty(spark):
    c, s = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "A", T0, 2.0, "x", 1), (2, "A", T0, NAN, "x", 1)], SIGNALS)
    assert [r.signal_id for r in leaking_signals(s, c).collect()] == [1]
    assert leaking_signals(s.limit(0), c).count() == 0
