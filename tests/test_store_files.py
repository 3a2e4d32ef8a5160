"""Written stores: file bounds rule out only what cannot match, and ingestion row by row shows what is finalised."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barlake.functions import tuning
from barlake.operators.live import LiveStore
from barlake.operators.store import BarStore
from barlake.plans.engine import Engine, FullScanEngine
from barlake.plans.predicate import AlwaysTrue, Comparison, In, conjunction
from barlake.sources.replay import Replay
from tests.test_engine import BASE, LATE, T0, bar, closes

DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three symbols over 100 days in a dozen files, with corrections; one hides a row, one shows one."""
    path = str(tmp_path_factory.mktemp("store"))
    rows = [bar(s, T0 + k * DAY, 10.0 * i + k, 1000 * i + k) for i, s in enumerate(("A", "B", "C")) for k in range(100)]
    late = [(*bar("A", T0 + k * DAY, 500.0 - k, 9000 + k), T0 + (k + 3) * DAY) for k in range(0, 100, 9)]
    s = BarStore(spark.createDataFrame(rows, BASE), spark.createDataFrame(late, LATE), timedelta(days=10), base_unique=True)
    s.write(path, partitions=12)
    return s, path


CLAUSES = st.lists(
    st.one_of(
        st.builds(Comparison, st.just("symbol"), st.sampled_from(["=", "<", ">", "<=", ">="]), st.sampled_from(["A", "B", "b", "Z"])),
        st.builds(Comparison, st.just("timestamp"), st.sampled_from(["=", "<", ">", "<=", ">="]), st.integers(-5, 110).map(lambda k: T0 + k * DAY)),
        st.builds(Comparison, st.just("close"), st.sampled_from(["=", "<", ">", "<=", ">="]), st.sampled_from([float("nan"), -1.0, 15.0, 60.0, 450.0, 600.0])),
        st.builds(In, st.just("symbol"), st.sampled_from([("A",), ("B", "Z"), ()])),
        st.builds(In, st.just("close"), st.sampled_from([(15.0, 491.0), (float("nan"),)])),
        st.builds(Comparison, st.just("volume"), st.just(">="), st.sampled_from([1.0, 2000.0])),
    ),
    max_size=3,
).map(conjunction)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(CLAUSES, st.one_of(st.none(), st.integers(-2, 120)))
def test_pruned_states_are_the_whole_ones(spark, stored, predicate, cutoff):
    _, path = stored
    s = BarStore.read(spark, path, base_unique=True)
    at = None if cutoff is None else T0 + cutoff * DAY
    assert closes(s.state(at, predicate)) == closes(s.state_by_window(at, predicate))


def test_plan_opens_candidate_files_only(spark, stored):
    _, path = stored
    s = BarStore.read(spark, path, base_unique=True)
    r = Engine(s, sort=False).execute(f"SELECT * FROM d WHERE symbol = 'B' AND date >= '{(T0 + 5 * DAY).date()}' AND date < '{(T0 + 8 * DAY).date()}'")
    opened, files = r.files
    assert files >= 10 and opened <= 2 and r.row_count == 3
    assert FullScanEngine(s, sort=False).execute("SELECT * FROM d").files is None
    assert Engine(s, sort=False).execute("SELECT * FROM d WHERE price > 1000000").files[0] == 0
    # Where a key has several base rows, or for corrections, a price rules nothing out.
    p = Comparison("close", ">", 1e6)
    assert len(s.files(p, table="corrections")) == len(s._files["corrections"].names)
    assert len(BarStore.read(spark, path, base_unique=False).files(p)) == files
    assert s.files(AlwaysTrue(), T0 - DAY) == [] == s.files(AlwaysTrue(), T0 - DAY, "corrections")


def test_written_zone_map_is_the_counted_one(spark, stored):
    s, path = stored
    read = BarStore.read(spark, path, base_unique=True)
    a, b = s.zones(), read.zones()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and read.stats().first() == s.stats().first()
    first = a.where("symbol = 'C' AND txn_start IS NULL").orderBy("time_start").first()
    one = a.where("txn_start IS NOT NULL").orderBy("time_start").first()
    for chunk in (first.chunk_id, one.chunk_id):
        assert closes(read.chunk(chunk)) == closes(s.chunk(chunk))
    rest = read.without_chunks([first.chunk_id, one.chunk_id])
    assert closes(rest.full_scan()) == closes(s.without_chunks([first.chunk_id, one.chunk_id]).full_scan())
    assert rest.full_scan().count() == read.full_scan().count() - first.row_count - 1
    for act in (read.chunk, lambda i: read.without_chunks([first.chunk_id, i])):
        with pytest.raises(KeyError):
            act(12345)
    assert closes(read.correct(spark.createDataFrame([(*bar("A", T0, 9.0, 99_999), T0 + 99 * DAY)], LATE)).state(None, Comparison("close", "=", 9.0)))[0][2] == 9.0


def test_live_rows_are_seen_when_their_chunk_closes(spark, tmp_path):
    live = LiveStore(spark, str(tmp_path / "live"), timedelta(hours=1), ["close"], batch_rows=3)
    seen = lambda: sorted((r.symbol, r.close) for r in live.store().state().collect())
    for k, m in enumerate((0, 30, 59)):
        live.ingest_row(T0 + timedelta(minutes=m), "A", [float(k)])
    assert seen() == []
    live.ingest_row(T0 + timedelta(minutes=60), "A", [3.0])
    live.ingest_row(T0, "B", [9.0])
    assert seen() == [("A", 0.0), ("A", 1.0), ("A", 2.0)]
    live.ingest_correction(T0, "A", [7.0], T0)
    live.ingest_correction(T0, "N", [8.0], T0 + DAY)
    assert seen() == [("A", 1.0), ("A", 2.0), ("A", 7.0), ("N", 8.0)]
    with pytest.raises(ValueError, match="non-decreasing order"):
        live.ingest_row(T0, "A", [0.0])
    assert live.flush_all() == 2 and len(seen()) == 6
    # A flush lets the next row begin a new chunk within the same hour.
    live.ingest_row(T0 + timedelta(minutes=61), "A", [4.0])
    assert len(seen()) == 6 and live.flush_all() == 1
    starts = live.store().chunked_base().where("symbol = 'A'").select("chunk_start").distinct().count()
    assert starts == 3 and len(seen()) == 7
    rows = spark.createDataFrame([("A", T0 + 2 * DAY, 1.0, 1), ("A", T0 + 3 * DAY, 2.0, 2)], "symbol string, timestamp timestamp_ntz, close double, ingest_seq long")
    assert live.ingest_from_replay(Replay(rows, ["close"])) == 2 and len(seen()) == 9


def test_tuning_reads_the_zone_map(spark, stored):
    s, _ = stored
    zones = s.zones().where("txn_start IS NULL")
    assert tuning.selectivity_threshold(zones, 1.0) == T0 and tuning.selectivity_threshold(zones, 0.0) == T0 + 99 * DAY
    assert tuning.selectivity_threshold(zones.limit(0), 0.5) is None
    r = tuning.price_attribution(zones, conjunction([Comparison("symbol", "=", "A"), Comparison("close", ">", 55.0)])).first()
    assert (r.total_chunks, r.with_price, r.without_price) == (30, 5, 10)
    assert tuning.median_threshold(s.base).first().threshold == np.median([10.0 * i + k for i in range(3) for k in range(100)])


def test_live_batches_are_files_written_without_a_job(spark, tmp_path):
    live = LiveStore(spark, str(tmp_path / "live"), timedelta(hours=1), ["close"], batch_rows=3)
    t = datetime(2024, 1, 1, 0, 0, 0, 5)
    group = f"live-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, "live")
    for k in range(12):
        live.ingest_row(t + timedelta(minutes=20 * k), "A", [float(k)])
        live.ingest_correction(t + timedelta(minutes=20 * k), "A", [k + 0.5], t + timedelta(days=1 + k % 2))
    live.flush_all()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(list((tmp_path / "live" / x).glob("*.parquet"))) for x in ("base", "corrections")] == [4, 4]
    s = live.store()
    assert sorted((r.timestamp, r.close) for r in s.state(t + timedelta(days=1)).collect()) == [(t + timedelta(minutes=20 * k), k + 0.5 * (k % 2 == 0)) for k in range(12)]
