import random
from datetime import datetime, timedelta

import pytest

from barlake.operators.grid import missing_slots, regular_grid

BARS = "ingest_seq long, symbol string, timestamp timestamp_ntz, close double, slot string, _step int"
SYMBOLS = "symbol string, bar_minutes int, close string"
E0 = datetime(1970, 1, 1)
NAN = float("nan")


def pchip(x, y, t):
    """Monotone cubic through four knots around the middle pair, written out anew; None for a missing outer knot."""
    (x0, x1, x2, x3), (y0, y1, y2, y3) = x, y
    d = (y2 - y1) / (x2 - x1)

    def slope(xa, ya, xb, yb, xc, yc):
        p, q = (yb - ya) / (xb - xa), (yc - yb) / (xc - xb)
        if p * q <= 0:
            return 0.0
        w1, w2 = 2 * (xc - xb) + (xb - xa), (xc - xb) + 2 * (xb - xa)
        return (w1 + w2) / (w1 / p + w2 / q)

    m1 = d if x0 is None else slope(x0, y0, x1, y1, x2, y2)
    m2 = d if x3 is None else slope(x1, y1, x2, y2, x3, y3)
    h = x2 - x1
    s = (t - x1) / h
    return (2 * s**3 - 3 * s**2 + 1) * y1 + (s**3 - 2 * s**2 + s) * h * m1 + (-2 * s**3 + 3 * s**2) * y2 + (s**3 - s**2) * h * m2


def brute(rows, minutes, max_fill):
    out = {}
    for symbol in {r[1] for r in rows if r[1] in minutes}:
        step = minutes[symbol] * 60
        last = {}
        for r in sorted((r for r in rows if r[1] == symbol and r[2] is not None and r[3] is not None and r[3] == r[3]), key=lambda r: (r[2], r[0])):
            last[(r[2] - E0) / timedelta(seconds=1)] = r[3]
        xs = sorted(last)
        for i, x in enumerate(xs):
            slot = int(x // step)
            nxt = xs[i + 1] if i + 1 < len(xs) else None
            if nxt is None or nxt // step != slot:
                out[symbol, slot * step] = (last[x], "observed")
            if nxt is not None and nxt // 86400 == x // 86400:
                gap = range(slot + 1, int(nxt // step))
                at = [xs[i + k] if 0 <= i + k < len(xs) else None for k in (-1, 0, 1, 2)]
                for s in gap:
                    out[symbol, s * step] = (pchip(at, [last.get(a) for a in at], s * step), "filled") if len(gap) <= max_fill else (None, "gap")
    return out


@pytest.mark.parametrize("target", [10**6, 60])
def test_grid_equals_brute_force(spark, target):
    r = random.Random(11)
    rows, seq = [], 0
    for symbol, n in (("A", 400), ("B", 60), ("?", 5)):
        t = datetime(2024, 1, 1)
        for _ in range(n):
            t += timedelta(seconds=r.choice([0, 30, 200, 600, 900, 1500, 4000, 30000]), microseconds=r.randint(0, 999_999) if r.random() < 0.8 else 0)
            rows.append((seq, symbol, t, r.choice([None, NAN] + [round(100 + r.gauss(0, 3), 2)] * 8), "x", 1))
            seq += 1
    rows += [(seq, None, datetime(2024, 1, 1), 1.0, "x", 1), (seq + 1, "A", None, 1.0, "x", 1)]
    df, symbols = spark.createDataFrame(rows, BARS), spark.createDataFrame([("A", 10, "x"), ("B", 30, "x"), ("C", 5, "x"), (None, 5, "x"), ("?", None, "x")], SYMBOLS)
    got = {(x.symbol, x.slot_epoch): (x.close, x.status) for x in regular_grid(df, symbols, target_rows=target).collect()}
    want = brute(rows, {"A": 10, "B": 30}, 6)
    assert got.keys() == want.keys()
    for k, (v, status) in want.items():
        assert got[k][1] == status and (got[k][0] is None) == (v is None) and (v is None or abs(got[k][0] - v) < 1e-8)


def test_interpolation_keeps_the_shape(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "A", t + timedelta(minutes=m), c, "x", 1) for i, (m, c) in enumerate([(0, 1.0), (5, 1.0), (30, 2.0), (60, 10.0), (65, 10.0)])]
    out = regular_grid(spark.createDataFrame(rows, BARS), spark.createDataFrame([("A", 5, "x")], SYMBOLS)).orderBy("slot_epoch").collect()
    values = [r.close for r in out]
    assert len(out) == 14 and values == sorted(values) and min(values) == 1.0 and max(values) == 10.0


def test_ends_of_a_history_take_the_secant(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "A", t + timedelta(minutes=m), c, "x", 1) for i, (m, c) in enumerate([(0, 1.0), (15, 4.0), (20, 4.5), (35, 9.0)])] + [(9, "B", t, 1.0, "x", 1), (10, "B", t + timedelta(minutes=15), 4.0, "x", 1)]
    df = spark.createDataFrame(rows, BARS)
    got = {(x.symbol, x.slot_epoch): (x.close, x.status) for x in regular_grid(df, spark.createDataFrame([("A", 5, "x"), ("B", 5, "x")], SYMBOLS)).collect()}
    want = brute(rows, {"A": 5, "B": 5}, 6)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert abs(got["B", int((t - E0).total_seconds()) + 300][0] - 2.0) < 1e-9


def test_empty(spark):
    none, symbols = spark.createDataFrame([], BARS), spark.createDataFrame([], SYMBOLS)
    assert regular_grid(none, symbols).count() == missing_slots(none, symbols).count() == 0
