"""States of the table: fixed cases, and the anti-join plan against the window form on generated ones."""

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlake.operators.store import BarStore
from barlake.plans.engine import Engine, FullScanEngine
from barlake.plans.predicate import Comparison

T0 = datetime(2024, 3, 1, 9, 30)
BASE = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, ingest_seq long"
LATE = f"{BASE}, txn_time timestamp_ntz"


def bar(symbol, t, close, seq):
    return (symbol, t, close - 0.5, close + 1, close - 1, close, 1000.0, seq)


def store(spark, base, late=(), **kw):
    return BarStore(spark.createDataFrame(base, BASE), spark.createDataFrame(list(late), LATE), **kw)


def closes(df):
    return sorted((r.symbol, r.timestamp, r.close) for r in df.collect())


@pytest.fixture(params=[Engine, FullScanEngine])
def engine(request):
    return request.param


def test_visibility_boundary(spark, engine):
    late = [(*bar("A", T0, 105.0, 10), datetime(2024, 3, 2, 12))]
    e = engine(store(spark, [bar("A", T0, 100.0, 1)], late))
    for at, want in (("2024-03-02T11:59:59.999999", 100.0), ("2024-03-02T12:00:00", 105.0)):
        assert closes(e.execute(f"SELECT * FROM d TIMESTAMP AS OF '{at}'").data) == [("A", T0, want)]
    assert closes(e.execute("SELECT * FROM d").data) == [("A", T0, 105.0)]
    assert e.execute("SELECT * FROM d TIMESTAMP AS OF '2024-03-01'").row_count == 0


def test_chain_tie_hidden_and_new_keys(spark, engine):
    day = timedelta(days=1)
    late = [(*bar("A", T0, 100.0 + k, 10 + k), T0 + k * day) for k in (1, 2, 3)]
    late += [(*bar("B", T0, 40.0, 20), T0), (*bar("C", T0, 77.0, 21), T0 + day)]
    e = engine(store(spark, [bar("A", T0, 100.0, 1), bar("B", T0, 60.0, 2)], late))
    for k in (1, 2, 3):
        assert ("A", T0, 100.0 + k) in closes(e.execute(f"SELECT * FROM d TIMESTAMP AS OF '{(T0 + k * day).isoformat()}'").data)
    # A correction at the row's own time wins; one that fails the condition hides the row it corrects; one without a base row is a row.
    assert ("B", T0, 40.0) in closes(e.execute(f"SELECT * FROM d TIMESTAMP AS OF '{T0.isoformat()}'").data)
    assert closes(e.execute("SELECT * FROM d WHERE close > 50").data) == [("A", T0, 103.0), ("C", T0, 77.0)]


def test_duplicates_stay_until_versions_are_resolved(spark, engine):
    s = store(spark, [bar("A", T0, 1.0, 1), bar("A", T0, 2.0, 2)])
    assert len(closes(engine(s).execute("SELECT * FROM d").data)) == 2
    assert closes(engine(s).execute("SELECT * FROM d TIMESTAMP AS OF '2024-04-01'").data) == [("A", T0, 2.0)]


def test_nan_matches_nothing(spark, engine):
    nan = float("nan")
    s = store(spark, [bar("A", T0, nan, 1), bar("A", T0 + timedelta(1), 110.0, 2)])
    for where, n in (("close > 100", 1), ("close >= 0", 1), ("close <= 1e9", 1), ("close = 'nan'", 0), ("close IN ('nan', 110)", 1)):
        assert engine(s).execute(f"SELECT * FROM d WHERE {where}").row_count == n


def test_empty_result_is_typed(spark, engine):
    r = engine(store(spark, [bar("A", T0, 1.0, 1)])).execute("SELECT * FROM d WHERE symbol = 'none'")
    assert r.row_count == 0 and r.selectivity == 0.0
    assert r.data.dtypes[:2] == [("timestamp", "timestamp_ntz"), ("symbol", "string")] and len(r.data.columns) == 7


def test_aware_store_reads_naive_literals_as_utc(spark, engine):
    df = spark.createDataFrame([bar("A", T0, 1.0, 1)], BASE).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    s = BarStore(df)
    assert engine(s).execute("SELECT * FROM d WHERE timestamp = '2024-03-01T09:30:00'").row_count == 1
    assert engine(s).execute("SELECT * FROM d WHERE timestamp = '2024-03-01T11:30:00+02:00'").row_count == 1
    assert s.state(datetime(2024, 3, 1, 9, 30, tzinfo=timezone.utc)).count() == 1
    assert engine(s).execute("SELECT * FROM d TIMESTAMP AS OF '2024-03-01T09:29:59'").row_count == 0


def test_plan_pushes_values_into_the_base_scan(spark, tmp_path):
    rows = [bar("A", T0 + timedelta(days=k), float(k), k) for k in range(20)]
    late = [(*bar("A", T0, 105.0, 100), T0 + timedelta(days=5))]
    store(spark, rows, late).write(str(tmp_path / "s"))
    s = BarStore.read(spark, str(tmp_path / "s"), base_unique=True)
    text = Engine(s, sort=False).describe("SELECT * FROM d TIMESTAMP AS OF '2024-03-10' WHERE close > 7 AND symbol = 'A'")
    assert "GreaterThan(close,7.0)" in text and "LeftAnti" in text and "EqualTo(symbol,A)" in text
    assert "Cartesian" not in text


def test_store_contracts(spark):
    df = spark.createDataFrame([bar("A", T0, 1.0, 1)], BASE)
    with pytest.raises(TypeError, match="chunk_boundary must provide"):
        BarStore(df, boundary=3)
    with pytest.raises(ValueError, match="must include 'close'"):
        BarStore(df, value_columns=["open"])
    aware = df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("txn_time", F.col("timestamp"))
    with pytest.raises(ValueError, match="timezone awareness"):
        BarStore(df, aware)
    s = BarStore(df)
    with pytest.raises(KeyError):
        s.chunk(12345)
    with pytest.raises(ValueError, match="non-decreasing order"):
        s.append(spark.createDataFrame([bar("A", T0 - timedelta(1), 1.0, 2)], BASE))
    assert s.append(spark.createDataFrame([bar("A", T0, 2.0, 2)], BASE)).base.count() == 2
    with pytest.raises(ValueError, match="cannot precede the event"):
        s.correct(spark.createDataFrame([(*bar("A", T0, 1.0, 2), T0 - timedelta(microseconds=1))], LATE))
    assert s.correct(spark.createDataFrame([(*bar("A", T0, 9.0, 2), T0)], LATE)).state().first().close == 9.0


bases = st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 8)), min_size=1, max_size=10, unique=True)
lates = st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 8), st.integers(0, 6)), max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(bases, lates, st.integers(-1, 16), st.sampled_from([0.0, 104.0, 203.0]))
def test_antijoin_equals_window_and_compaction_is_invisible(spark, base, late, cutoff, least):
    rows = [bar(s, T0 + timedelta(days=d), 100.0 + i, i) for i, (s, d) in enumerate(base)]
    fixes = [(*bar(s, T0 + timedelta(days=d), 200.0 + i, 100 + i), T0 + timedelta(days=d + lag)) for i, (s, d, lag) in enumerate(late)]
    s = store(spark, rows, fixes)
    p = Comparison("close", ">", least)
    at = T0 + timedelta(days=cutoff)
    compacted, _ = s.compact(boundary=timedelta(days=3))
    for as_of in (None, at):
        want = closes(s.state_by_window(as_of, p))
        assert closes(s.state(as_of, p)) == want
        assert closes(compacted.state(as_of, p)) == want


def test_acausal_and_undated_corrections_are_set_apart_in_both_plans(spark, tmp_path):
    base = [bar("A", T0 + timedelta(hours=i), 100.0 + i, i) for i in range(4)]
    late = [
        (*bar("A", T0, 200.0, 10), T0 - timedelta(hours=1)),  # before its event
        (*bar("A", T0 + timedelta(hours=1), 201.0, 11), None),  # undated
        (*bar("A", T0 + timedelta(hours=2), 202.0, 12), T0 + timedelta(hours=2)),  # at its event
        (*bar("B", T0, 203.0, 13), T0 - timedelta(hours=1)),  # before the event of a row that base never had
    ]
    s = store(spark, base, late)
    want = [("A", T0 + timedelta(hours=i), c) for i, c in enumerate((100.0, 101.0, 202.0, 103.0))]
    s.write(str(tmp_path / "s"))
    for made in (s, s.compact()[0], BarStore.read(spark, str(tmp_path / "s"))):
        for mostly_late in (False, True):
            made.__dict__["_mostly_late"] = mostly_late
            assert closes(made.state()) == want == closes(made.state_by_window())
        at = T0 + timedelta(days=9)
        assert closes(made.state(at)) == want == closes(made.state_by_window(at))
        assert sorted(r.ingest_seq for r in made.set_apart.collect()) == [10, 11, 13]


def test_plans_agree_on_the_given_corrections(spark, small):
    columns = ["symbol", "timestamp", "open", "high", "low", "close", "volume", "ingest_seq"]
    base = spark.read.parquet(f"{small}/../sf0.01/bars.parquet").select(columns)
    late = spark.read.parquet(f"{small}/../sf0.01/corrections.parquet").withColumnRenamed("seq", "ingest_seq")
    s = BarStore(base, late, base_unique=False)
    s.__dict__["_mostly_late"] = False
    a, b = s.state(), s.state_by_window()
    assert a.count() == b.count() > 0 and not s.set_apart.isEmpty()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
