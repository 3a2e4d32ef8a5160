from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.functions.forest import Forest, cleaned
from barlake.operators.spikes import SHORT_RUN, _usual_run, mark_spikes
from barlake.operators.timeshards import with_shards

SCHEMA = "ingest_seq long, symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, _shard string, score int"
NAN = float("nan")


def walk(symbol, n, seed, first=0, step=0.001):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, step, n)))
    open_ = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(open_, close) * (1 + step / 2), np.minimum(open_, close) * (1 - step / 2)
    volume = np.round(np.exp(rng.normal(8, 0.5, n)))
    t0 = datetime(2024, 1, 1)
    return [[first + i, symbol, t0 + timedelta(minutes=15 * i), float(open_[i]), float(high[i]), float(low[i]), float(close[i]), float(volume[i]), "x", 1] for i in range(n)]


def planted():
    """One source with every kind of fault and every kind of look-alike; returns rows and the faulty ids."""
    rows, bad = walk("A", 1500, 1), set()
    O, H, L, C, V = 3, 4, 5, 6, 7
    for i in (100, 101):  # a spike of two readings, high stretched along
        rows[i][C] *= 1.2
        rows[i][H] = rows[i][C]
        bad.add(i)
    for k in (O, H, L, C):  # a misplaced decimal point, next to one the other way
        rows[200][k] *= 100
        rows[201][k] /= 100
    bad |= {200, 201}
    rows[300][H] *= 1.1  # a wick
    rows[310][L] *= 0.9
    bad |= {300, 310}
    rows[400][V] *= 3000  # a burst of volume
    bad.add(400)
    for i in range(501, 512):  # a stuck close
        for k in (O, H, L, C):
            rows[i][k] = rows[500][C]
        bad.add(i)
    for i in range(601, 612):  # a stuck volume
        rows[i][V] = rows[600][V]
        bad.add(i)
    rows[700][C] = -1.0
    rows[701][V] = -5.0
    rows[702][H], rows[702][L] = rows[702][L], rows[702][H]
    rows[703][C] = 0.0
    rows[704][V] = float("inf")
    bad |= {700, 701, 702, 703, 704}
    for i in range(800, 1500):  # a lasting revaluation is genuine
        for k in (O, H, L, C):
            rows[i][k] *= 0.5
    for i in range(900, 940):  # so is a busy stretch
        rows[i][V] *= 8
    for i in range(1000, 1010):  # and bars that saw no trade
        for k in (O, H, L, C):
            rows[i][k] = rows[999][C]
        rows[i][V] = 0.0
    rows[1100][C] = NAN
    rows[1101][V] = None
    rows[1102][C] = None
    again = [list(rows[i]) for i in (100, 300, 510, 50)]  # delivered again, unchanged
    for k, r in enumerate(again):
        r[0] = 5000 + k
    other = list(rows[100])  # and with a sound price
    other[0] = 6000
    other[O] = other[C] = rows[99][C]
    other[H], other[L] = other[C] * 1.0005, other[C] * 0.9995
    bad |= {5000, 5001, 5002}
    return rows + again + [other], bad


@pytest.mark.parametrize("target", [10**6, 400])
def test_planted_faults(spark, target):
    rows, bad = planted()
    df = spark.createDataFrame(rows + walk("B", 300, 2, first=10_000), SCHEMA)
    got = {r.ingest_seq for r in mark_spikes(df, flagged_only=True, target_rows=target).collect()}
    assert got == bad


def test_every_row_is_scored_once(spark):
    rows, _ = planted()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mark_spikes(df, target_rows=300)
    assert out.count() == len(rows) == out.select("ingest_seq").distinct().count()
    assert out.where("score IS NULL OR isnan(score)").count() == 0


def test_rows_without_source_or_time_meet_physical_limits_only(spark):
    rows = [[1, None, datetime(2024, 1, 1), 1.0, 2.0, 0.5, -1.0, 5.0, "x", 1], [2, "A", None, 1.0, 0.5, 2.0, 1.0, 5.0, "x", 1], [3, None, None, None, None, None, None, None, None, None], [None, "A", datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, -1.0, "x", 1]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.ingest_seq or 0) for r in mark_spikes(df, flagged_only=True).collect()) == [0, 1, 2]
    assert mark_spikes(df).count() == 4


def test_empty_and_tiny_sources(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mark_spikes(df).count() == mark_spikes(df, flagged_only=True).count() == 0
    one = spark.createDataFrame(walk("A", 1, 3) + walk("B", 2, 4, 10) + [[99, "C", datetime(2024, 1, 1), NAN, NAN, NAN, NAN, NAN, "x", 1]], SCHEMA)
    assert mark_spikes(one, flagged_only=True).count() == 0 and mark_spikes(one).count() == 4


def test_verdicts_do_not_depend_on_partitions(spark):
    rows, _ = planted()
    df = spark.createDataFrame(rows, SCHEMA)
    a = sorted(map(tuple, mark_spikes(df).select("ingest_seq", F.round("score", 9)).collect()))
    b = sorted(map(tuple, mark_spikes(df.repartition(7)).select("ingest_seq", F.round("score", 9)).collect()))
    assert a == b


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    pool = rng.normal(0, 1, (500, 4))
    pool[:, 3] = 1.0
    f = Forest(pool, 1)
    calm, odd = f.score(rng.normal(0, 1, (200, 4)) * [1, 1, 1, 0] + [0, 0, 0, 1]), f.score(np.array([[30.0, 0, 0, 1], [0, 0, 0, 40.0]]))
    assert odd.min() > np.quantile(calm, 0.95)
    assert (Forest(pool, 1).score(pool) == f.score(pool)).all()


def stretches(rows, sizes, column):
    """Repeats a value for each of ``sizes`` readings, spread over ``rows``; returns the ids after each stretch's first."""
    bad = set()
    for at, size in zip(np.linspace(20, len(rows) - 100, len(sizes)).astype(int), sizes):
        for i in range(at + 1, at + size):
            for k in (3, 4, 5, 6) if column == "close" else (7,):
                rows[i][k] = rows[at][6 if column == "close" else 7]
            bad.add(rows[i][0])
    return bad


@pytest.mark.parametrize("column", ["close", "volume"])
def test_many_stuck_stretches_do_not_become_the_norm(spark, column):
    sources = {"A": (2000, [20, 22, 25]), "B": (2000, [20, 22, 25, 30]), "C": (2000, list(range(20, 30))), "D": (2000, [7, 9, 12, 15, 20, 26]), "E": (600, [8] * 6), "F": (2000, [45] * 10)}
    rows, bad = [], set()
    for k, (name, (n, sizes)) in enumerate(sources.items()):
        own = walk(name, n, 20 + k, first=10_000 * k)
        bad |= stretches(own, sizes, column)
        rows += own
    got = {r.ingest_seq for r in mark_spikes(spark.createDataFrame(rows, SCHEMA), flagged_only=True).collect()}
    assert got == bad


def test_usual_run_ends_at_the_first_gap():
    usual = lambda *sizes: _usual_run(*np.unique(np.concatenate(sizes), return_counts=True))
    sticky = np.repeat(np.arange(1, 11), [1000, 500, 250, 120, 60, 30, 15, 8, 4, 2])
    assert usual(sticky) == 10 == usual(sticky, [18]) == usual(sticky, [18, 19, 22, 35, 36])
    daily = np.full(200, 20)  # what holds a large share of the readings is the source's habit
    assert usual(np.ones(5000, int), daily) == 20 and usual(np.ones(5000, int), daily, [60]) == 20
    assert usual([30]) == 30 and usual(np.array([], int)) == 1
    rng = np.random.default_rng(5)
    alarms = sum(max(s) > max(SHORT_RUN, usual(s)) for s in (rng.geometric(0.4, 2000) for _ in range(200)))
    assert alarms <= 5


@pytest.mark.parametrize("target", [10**6, 400])
def test_what_is_usual_is_the_sources_not_the_shards(spark, target):
    rows = walk("A", 3000, 31)
    for at in [*range(10, 2300, 25), 2900]:  # runs of up to 9 are usual, though the last shard has one only
        for i in range(at + 1, at + 4 + at % 6):
            for k in (3, 4, 5, 6):
                rows[i][k] = rows[at][6]
    for i in range(2700, 3000):  # volumes that vary little at the end
        rows[i][7] = 3000.0 + 2 * (i % 50)
    rows[2800][7] = 3e5
    for i in range(2300):
        rows[i][7] = float(round(rows[i][7] ** 2 / 1000 + i % 7))
    bad = stretches(rows[:2200], [40, 45], "close")
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.ingest_seq for r in mark_spikes(df, flagged_only=True, target_rows=target).collect()} == bad


@pytest.mark.parametrize("target", [10**6, 400])
def test_a_thin_day_at_the_cut_does_not_shorten_the_halo(spark, target):
    rows = walk("A", 1056, 41)
    rows = rows[:480] + rows[574:]  # the sixth day, first of the second shard at 400, has two readings
    bad = set()
    for i in range(478, 490):  # stuck from three readings before the border on
        for k in (3, 4, 5, 6):
            rows[i][k] = rows[477][6]
        bad.add(rows[i][0])
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.ingest_seq for r in mark_spikes(df, flagged_only=True, target_rows=target).collect()} == bad
    seen = with_shards(df, "symbol", "timestamp", 400, 64).toPandas()
    own = seen[seen._own].groupby("_shard").timestamp.agg(["min", "max"])
    everything = df.toPandas().timestamp
    for shard, (first, last) in own.iterrows():
        held = seen[seen._shard == shard].timestamp
        assert (held < first).sum() >= min(64, (everything < first).sum()) and (held > last).sum() >= min(64, (everything > last).sum())
    assert seen._own.sum() == len(rows) and not seen.duplicated(["_shard", "timestamp"]).any()


@pytest.mark.parametrize("target", [10**6, 400])
def test_other_volumes_of_later_deliveries_are_judged(spark, target):
    rows = walk("A", 900, 51)
    bad = stretches(rows[:400], [12], "volume")
    rows[700][7] = None
    again = {5000: (500, 3e7), 5001: (700, 3e7), 5002: (600, rows[600][7] * 1.5), 5003: (500, 0.0), 5004: (500, None), 5005: (700, 3000.0), 5006: (0, 3e7), 5007: (899, 3e7)}
    late = []
    for seq, (i, volume) in again.items():
        late.append([seq, *rows[i][1:7], volume, *rows[i][8:]])
    stuck = min(bad)  # the second delivery goes on with the stretch where the first leaves it
    late.append([5008, *rows[stuck + 3][1:]])
    rows[stuck + 3][7] += 1000.0
    bad = (bad - {stuck + 3}) | {5008, 5000, 5001, 5006, 5007}
    bad -= {stuck, stuck + 1, stuck + 2}  # by first deliveries three equal readings stand before, eight after
    bad -= {stuck + 4}
    df = spark.createDataFrame(rows + late, SCHEMA)
    assert {r.ingest_seq for r in mark_spikes(df, flagged_only=True, target_rows=target).collect()} == bad


def spoiled(seed, sources=12, n=1200):
    """Sources of different temper with faults of random size and place, no two within 40 readings."""
    rng = np.random.default_rng(seed)
    rows, bad = [], set()
    for s in range(sources):
        own = walk(f"S{s}", n, 1000 * seed + s, first=s * n, step=float(rng.choice([0.0003, 0.001, 0.004])))
        step = np.median(np.abs(np.diff(np.log([r[6] for r in own]))))
        for at in np.sort(rng.choice(np.arange(2, n // 40 - 1), 9, replace=False)) * 40:
            at, kind = int(at), rng.integers(4)
            if kind == 0:  # closes that jump and come back
                for i in range(at, at + int(rng.integers(1, 4))):
                    own[i][6] *= float(np.exp(rng.choice([-1, 1]) * step * rng.uniform(20, 60)))
                    own[i][4], own[i][5] = max(own[i][4], own[i][6]), min(own[i][5], own[i][6])
                    bad.add(own[i][0])
            elif kind == 1:  # a wick
                own[at][4] *= float(np.exp(step * rng.uniform(25, 80)))
                bad.add(own[at][0])
            elif kind == 2:  # a burst of volume
                own[at][7] *= float(np.exp(rng.uniform(5.5, 8)))
                bad.add(own[at][0])
            else:  # a stuck close
                for i in range(at + 1, at + int(rng.integers(8, 20))):
                    for k in (3, 4, 5, 6):
                        own[i][k] = own[at][6]
                    bad.add(own[i][0])
        rows += own
    return rows, bad


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_faults_of_unseen_sources_are_found(spark, seed):
    rows, bad = spoiled(seed)
    got = {r.ingest_seq for r in mark_spikes(spark.createDataFrame(rows, SCHEMA), flagged_only=True).collect()}
    assert len(got & bad) >= 0.95 * len(bad) and len(got & bad) >= 0.95 * len(got), (len(bad), len(got), len(got & bad))


def test_the_forest_decides(spark):
    """With every reading let through, the exact checks alone find far more; with none, only physical limits are left."""
    rows, bad = spoiled(4, sources=3)
    df = spark.createDataFrame(rows, SCHEMA)
    found = lambda odd: {r.ingest_seq for r in mark_spikes(df, flagged_only=True, odd=odd).collect()}
    assert found(2.0) == set() and found(0.72) == bad and len(found(0.0)) > 5 * len(bad)


@pytest.mark.parametrize("target", [10**6, 700, 150])
def test_one_forest_for_a_source_however_it_is_cut(spark, target):
    """One day of 3,000 readings: cut within the day, scores and verdicts as of the whole."""
    rows, bad = spoiled(5, sources=1, n=3000)
    t0 = datetime(2024, 1, 1)
    for i, r in enumerate(rows):
        r[2] = t0 + timedelta(seconds=20 * i)
    df = spark.createDataFrame(rows, SCHEMA)
    out = mark_spikes(df, target_rows=target).toPandas()
    assert len(out) == 3000 and set(out.ingest_seq[out.spike | out.stuck | out.impossible]) == bad
    seen = with_shards(df, "symbol", "timestamp", target, 64)
    most = seen.groupBy("_shard").count().agg(F.max("count")).first()[0]
    assert most <= (3000 if target > 3000 else 1.3 * target + 2 * 64 + target // 4)
    assert seen.where("_own").count() == 3000


def test_a_pool_full_of_faults_is_cleaned():
    rng = np.random.default_rng(3)
    pool = np.abs(rng.normal(0, 1, (300, 2)))
    pool[:12] += 40
    f = cleaned(pool, 1, [(0,), (1,)], 0.6)
    assert f.score(np.array([[41.0, 0.5], [0.5, 25.0]])).min() > 0.72 > f.score(np.abs(rng.normal(0, 1, (500, 2)))).max()
