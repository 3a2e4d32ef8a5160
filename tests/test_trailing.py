import random
from datetime import datetime, timedelta

from barlake.operators.trailing import quiet_weeks, trailing_totals

SCHEMA = "ingest_seq long, symbol string, timestamp timestamp_ntz, volume double, day string, d7 int"
NAN = float("nan")


def brute(rows):
    last = {}
    for seq, s, t, v, *_ in rows:
        if s is not None and t is not None and seq is not None and (seq >= last.get((s, t), (-1, None))[0]):
            last[s, t] = (seq, v)
    per = {}
    for (s, t), (_, v) in last.items():
        per.setdefault(s, {}).setdefault(t.date(), 0.0)
        per[s][t.date()] += 0.0 if v is None or v != v or v in (float("inf"), -float("inf")) else v
    out = {}
    for s, days in per.items():
        d = min(days)
        while d <= max(days):
            out[s, d] = tuple(sum(days.get(d - timedelta(days=k), 0.0) for k in range(n)) for n in (7, 30))
            d += timedelta(days=1)
    return out


def test_totals_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["A", "A", "B", None]), None if r.random() < 0.03 else datetime(2024, 1, 1, r.choice([10, 16])) + timedelta(days=r.choice([0, 1, 2, 3, 40, 41, 80, 81, 90, 200])), r.choice([None, NAN, 0.0, 0.1, 0.2, 100.0, 7.25, float("inf")]), "x", 1) for i in range(250)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = {(x.symbol, x.day): (x.total_7, x.total_30) for x in trailing_totals(df).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))
    quiet = {(x.symbol, x.trade_day) for x in quiet_weeks(df).collect()}
    assert quiet == {(s, d.isoformat()) for (s, d), (week, month) in want.items() if week == 0 and month > 0}


def test_sums_come_back_to_zero_and_latest_delivery_counts(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "A", t, 0.1, "x", 1), (2, "A", t + timedelta(days=1), 0.2, "x", 1), (3, "A", t + timedelta(days=20), 5.0, "x", 1), (4, "A", t + timedelta(days=20), None, "x", 1)]
    out = {x.day.day: x.total_7 for x in trailing_totals(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[2] == 0.3 and out[8] == 0.2 and out[9] == 0.0 and out[21] == 0.0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trailing_totals(df).count() == quiet_weeks(df).count() == 0


def test_tiny_and_huge_amounts_are_exact(spark):
    t = datetime(2024, 1, 1)
    day = lambda n: t + timedelta(days=n)
    rows = [(1, "A", day(0), 1e-7, "x", 1), (2, "A", day(8), 0.0, "x", 1)]
    rows += [(3, "B", day(0), 5.0, "x", 1), (4, "B", day(1), 1e23, "x", 1), (5, "B", day(9), 0.0, "x", 1), (6, "B", day(60), 2.5, "x", 1)]
    rows += [(7, "C", day(0), 1e-300, "x", 1), (8, "C", day(1), 1e300, "x", 1), (9, "C", day(8), 0.0, "x", 1)]
    rows += [(10, "D", day(0), 1e-320, "x", 1), (11, "D", day(9), 0.0, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {(x.symbol, (x.day - t.date()).days): (x.total_7, x.total_30) for x in trailing_totals(df).collect()}
    assert out["A", 8] == (0.0, 1e-7) and out["A", 6] == (1e-7, 1e-7)
    near = lambda x, y: abs(x - y) <= 1e-15 * y
    assert near(out["B", 1][0], 1e23) and near(out["B", 7][0], 1e23) and out["B", 8][0] == 0.0 and near(out["B", 8][1], 1e23)
    assert out["B", 59] == (0.0, 0.0) and abs(out["B", 60][0] - 2.5) <= 1e-29 * 1e23
    assert near(out["C", 7][0], 1e300) and out["C", 8][0] == 0.0 and out["C", 0][0] > 0
    quiet = {(x.symbol, x.trade_day) for x in quiet_weeks(df).collect()}
    assert ("A", "2024-01-09") in quiet and ("B", "2024-01-09") in quiet and ("D", "2024-01-10") in quiet and ("B", "2024-03-01") not in quiet


def test_days_come_together_by_key_once(spark):
    from barlake.operators.trailing import daily_amounts

    df = spark.createDataFrame([(1, "A", datetime(2024, 1, 1), 1.0, "x", 1)], SCHEMA)
    plan = trailing_totals(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "decimal" not in plan
    assert daily_amounts(df).columns == ["symbol", "day", "amount"]
