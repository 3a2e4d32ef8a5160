"""Queries of what surrounds the engine: stored tables as given, written stores, ingestion, streams, errors and figures."""

from __future__ import annotations

import contextlib
import io
import uuid
import warnings
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.stats import overlap, trimmed_stats
from barlake.operators.live import LiveStore
from barlake.operators.store import BarStore
from barlake.plans import zonemap
from barlake.plans.engine import Engine, FullScanEngine
from barlake.plans.predicate import Comparison
from barlake.plans.sqlparse import parse
from barlake.queries.bitemporal import AT, CLICK, CTES, FROM, HOUR, LATE, MID, NUMBER, SHOWN, ZONES, _state_sql, bars, corrections, long_bars, shown, store
from barlake.session import checkpoint_dir, table
from barlake.sources import validate
from barlake.sources.bars_csv import load_bars, load_single
from barlake.sources.driver import local_rows, written_rows
from barlake.sources.replay import Replay
from barlake.sources.synthetic import late_corrections, random_walk_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


# The stored tables as they are: repeated keys, rows without key, corrections that claim to come before their event.


def given(spark: SparkSession, d: str) -> BarStore:
    columns = ["symbol", "timestamp", "open", "high", "low", "close", "volume"]
    late = table(spark, d, "corrections").select(*columns, F.col("seq").alias("ingest_seq"), "txn_time")
    return BarStore(table(spark, d, "bars").select(*columns, "ingest_seq"), late, base_unique=False)


_GIVEN = """WITH versions AS (
  SELECT symbol, timestamp, close, volume, timestamp AS txn, FALSE AS corr, ingest_seq AS seq FROM bars WHERE symbol IS NOT NULL AND timestamp IS NOT NULL
  UNION ALL SELECT symbol, timestamp, close, volume, txn_time, TRUE, seq FROM corrections WHERE symbol IS NOT NULL AND txn_time >= timestamp)
SELECT symbol, timestamp, CASE WHEN NOT isnan(close) THEN close END AS close, CASE WHEN NOT isnan(volume) THEN volume END AS volume
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp ORDER BY txn DESC, corr DESC, seq DESC) AS rn FROM versions {known}) WHERE rn = 1 {cond}"""


def _plain(df: DataFrame) -> DataFrame:
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return df.select("symbol", "timestamp", number("close"), number("volume"))


def _on_given(name: str, statement: str, known: str = "", cond: str = "", engine: type[Engine] = Engine) -> None:
    QUERIES[name] = lambda spark, d: _plain(engine(given(spark, d), sort=False).execute(statement).data)
    SQL[name] = _GIVEN.format(known=known, cond=cond)


_on_given("current_state_given", FROM)
_on_given("current_value_given", f"{FROM} WHERE close > 50", cond="AND close > 50 AND NOT isnan(close)")
_on_given("current_given_by_window", FROM, engine=FullScanEngine)
_on_given("asof_given", AT("2024-03-01"), "WHERE txn <= TIMESTAMP '2024-03-01'")
_on_given("asof_value_given", f"{AT('2024-03-01')} WHERE close > 50 AND date >= '2024-01-15'", "WHERE txn <= TIMESTAMP '2024-03-01'", "AND close > 50 AND NOT isnan(close) AND timestamp >= TIMESTAMP '2024-01-15'")

# Zone maps with chunks of corrections.

_ALL_ZONES = f"""{ZONES}, every AS (
  SELECT symbol, time_start, time_end, min_price, max_price, CAST(NULL AS TIMESTAMP) AS txn_start FROM zones
  UNION ALL SELECT symbol, timestamp, timestamp, coalesce(CASE WHEN {NUMBER} THEN close END, CAST('inf' AS DOUBLE)), coalesce(CASE WHEN {NUMBER} THEN close END, CAST('-inf' AS DOUBLE)), txn_time FROM corrections)"""


def _marked(name: str, where: str, cond: str, as_of: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = store(spark, d)
        predicate, at = parse(spark, f"{AT(as_of) if as_of else FROM}{' WHERE ' + where if where else ''}")
        return s.pushdown(predicate, at).zones.select("symbol", "time_start", "txn_start", "candidate")

    QUERIES[name] = run
    SQL[name] = f"{_ALL_ZONES} SELECT symbol, time_start, txn_start, ({cond}) AS candidate FROM every"


_marked("prune_asof_corrected", "", f"coalesce(txn_start, time_start) <= TIMESTAMP '{MID}'", MID)
_marked("prune_price_corrected", "price > 90 AND symbol = 'click'", "symbol = 'click' AND (txn_start IS NOT NULL OR max_price > 90)")


# Written stores: files are picked by their bounds, chunks looked up in the zone map.


def written(spark: SparkSession, d: str, corrected: bool = True) -> BarStore:
    path = folder(spark, "store")
    store(spark, d, corrected).write(path, partitions=6)
    return BarStore.read(spark, path, boundary=HOUR, base_unique=True)


def _on_written(name: str, statement: str, where: str, as_of: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: shown(Engine(written(spark, d), sort=False).execute(statement).data)
    SQL[name] = _state_sql(as_of, where)


_on_written("written_symbol_day", f"{FROM} WHERE {CLICK} AND date = '2024-01-10'", f"{CLICK} AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-11'")
_on_written("written_asof_price", f"{AT(MID)} WHERE symbol IN ('click', 'view') AND price > 90", f"symbol IN ('click', 'view') AND close > 90 AND {NUMBER}", MID)
_on_written("written_nothing", f"{FROM} WHERE symbol = 'nobody'", "FALSE")


@_register(f"{ZONES} SELECT {SHOWN} FROM chunked WHERE symbol = 'view' AND st = (SELECT max(time_start) FROM zones WHERE symbol = 'view')")
def written_chunk(spark, d):
    """One chunk by its name in the written zone map."""
    s = written(spark, d, False)
    last = s.zones().where("symbol = 'view'").orderBy(F.desc("time_start")).first()
    return shown(s.chunk(last.chunk_id))


@_register(f"{ZONES} SELECT {SHOWN} FROM chunked WHERE NOT (symbol = 'view' AND st = (SELECT max(time_start) FROM zones WHERE symbol = 'view'))")
def written_removal(spark, d):
    s = written(spark, d, False)
    last = s.zones().where("symbol = 'view'").orderBy(F.desc("time_start")).first()
    return shown(s.without_chunks([last.chunk_id]).state())


@_register(f"{ZONES} SELECT {SHOWN} FROM chunked WHERE symbol = 'click' AND st = (SELECT min(time_start) FROM zones WHERE symbol = 'click')")
def chunk_arrays(spark, d):
    """A chunk's columns as arrays, turned into rows again."""
    s = store(spark, d, False)
    arrays = s.column_arrays(s.zones().where(CLICK).orderBy("time_start").first().chunk_id)
    rows = [(str(a), b.astype("datetime64[us]").item(), float(c), float(v)) for a, b, c, v in zip(arrays["symbol"], arrays["timestamp"], arrays["close"], arrays["volume"])]
    return shown(spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, close double, volume double"))


# Ingestion.


@_register(f"{CTES} SELECT symbol, timestamp, CASE WHEN {NUMBER} THEN close END AS close, volume FROM bars")
def replay_rows(spark, d):
    """Every bar through the forward-only replay."""
    rows = ((x["symbol"], x["timestamp"], *x["values"]) for x in Replay(bars(spark, d), ["close", "volume"]))
    return shown(written_rows(spark, folder(spark, "replayed"), rows, "symbol string, timestamp timestamp_ntz, close double, volume double"))


_OPEN = f"{ZONES} SELECT {SHOWN} FROM chunked c WHERE st < (SELECT max(time_start) FROM zones z WHERE z.symbol = c.symbol)"


@_register(_OPEN)
def finalised_only(spark, d):
    """What is seen while each symbol's last chunk is open."""
    return shown(store(spark, d, False).finalised().state())


def _in_time():
    """As ``ingest_seq``, has rows delivered in order of time."""
    return F.struct("timestamp", "ingest_seq")


@_register(_OPEN)
def live_finalised(spark, d):
    """The same by row-by-row ingestion, before a flush."""
    live = LiveStore(spark, folder(spark, "live"), HOUR, ["close", "volume"])
    for x in Replay(bars(spark, d).withColumn("ingest_seq", _in_time()), ["close", "volume"]):
        live.ingest_row(x["timestamp"], x["symbol"], x["values"])
    return shown(live.store().state())


@_register(_state_sql(MID, "TRUE"))
def live_corrected(spark, d):
    """Rows and corrections one by one, flushed, as known at a time."""
    live = LiveStore(spark, folder(spark, "live"), HOUR, ["close", "volume"], batch_rows=2000)
    live.ingest_dataframe(bars(spark, d).select("symbol", "timestamp", "close", "volume", _in_time().alias("ingest_seq")))
    for symbol, timestamp, close, volume, txn_time in local_rows(corrections(spark, d).orderBy("ingest_seq").select("symbol", "timestamp", "close", "volume", "txn_time")):
        live.ingest_correction(timestamp, symbol, [close, volume], txn_time)
    return shown(live.store().state(datetime.fromisoformat(MID)))


@_register(_state_sql(LATE, "TRUE"))
def correction_stream(spark, d):
    """Corrections streamed into a written store in two batches."""
    from barlake.streaming.corrections import correction_sink

    path = folder(spark, "store")
    store(spark, d, False).write(path)
    late = corrections(spark, d)
    for part in (0, 1):
        late.where(F.pmod("ingest_seq", F.lit(2)) == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    correction_sink(stream, path, f"{path}/log").awaitTermination()
    return shown(BarStore.read(spark, path, boundary=HOUR, base_unique=True).state(datetime.fromisoformat(LATE)))


def _csv(spark: SparkSession, rows: DataFrame) -> str:
    path = folder(spark, "csv")
    text = rows.orderBy("timestamp", "ingest_seq").withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).drop("ingest_seq")
    text.coalesce(1).write.option("header", True).csv(path)
    return path


@_register(f"{CTES} SELECT timestamp, CASE WHEN {NUMBER} THEN close END AS close, volume FROM bars WHERE {CLICK}")
def single_symbol_load(spark, d):
    """A file of one symbol, without a symbol column."""
    path = _csv(spark, bars(spark, d).where(CLICK).drop("symbol"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        rows = load_single(spark, path, keep_repeated=True)
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.when(~F.isnan("close"), F.col("close")).alias("close"), "volume")


@_register(f"""{CTES} SELECT 'click over 50' AS query, count(*) AS n_rows FROM bars WHERE {CLICK} AND close > 50 AND {NUMBER}
UNION ALL SELECT 'one day', count(*) FROM bars WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-11' UNION ALL SELECT 'lines shown', 8""")
def command_line(spark, d):
    """A file loaded, cut and queried by the command line, with what it shows on the console."""
    from barlake import cli

    asked = {"click over 50": f"{FROM} WHERE {CLICK} AND close > 50", "one day": f"{FROM} WHERE date = '2024-01-10'"}
    with warnings.catch_warnings(), contextlib.redirect_stdout(io.StringIO()) as out:
        warnings.simplefilter("ignore", RuntimeWarning)
        figures = cli.main(["--data-csv", _csv(spark, bars(spark, d)), "--keep-repeated", *[x for q in asked.values() for x in ("--query", q)]])
    lines = len(out.getvalue().splitlines())
    rows = [(k, figures["queries"][q]["rows"]) for k, q in asked.items()] + [("lines shown", lines)]
    return spark.createDataFrame(rows, "query string, n_rows long")


# What results say about themselves.


@_register(f"{CTES} SELECT CAST(row_number() OVER (ORDER BY timestamp, symbol) AS INT) AS place, {SHOWN} FROM bars WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-11'")
def engine_sorted(spark, d):
    """Results come in order of time and symbol."""
    from pyspark.sql.window import Window

    rows = Engine(store(spark, d, False)).execute(f"{FROM} WHERE date = '2024-01-10'").data.withColumn("_at", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(Window.orderBy("_at")).alias("place"), "symbol", "timestamp", F.when(~F.isnan("close"), F.col("close")).alias("close"), "volume")


@_register(f"""{ZONES} SELECT (SELECT count(*) FROM bars WHERE {CLICK} AND close > 90 AND {NUMBER}) AS n_rows, (SELECT count(*) FROM bars WHERE {CLICK} AND close > 90 AND {NUMBER}) / (SELECT count(*) FROM bars) AS selectivity,
count(*) AS total_chunks, count(*) FILTER (WHERE symbol = 'click' AND max_price > 90) AS candidates, TRUE AS timed FROM zones""")
def query_metrics(spark, d):
    """Rows, selectivity, chunks and time of a result."""
    r = Engine(store(spark, d, False)).execute(f"{FROM} WHERE {CLICK} AND price > 90")
    out = (r.row_count, r.selectivity, r.pushdown.total_chunks, r.pushdown.candidate_count, r.elapsed_seconds > 0)
    return spark.createDataFrame([out], "n_rows long, selectivity double, total_chunks long, candidates long, timed boolean")


_STATEMENTS = {
    f"{FROM} WHERE {CLICK} AND 50 < price": "AS OF now: symbol = 'click' AND close > 50.0",
    f"{AT(MID)} WHERE symbol IN ('a', 'b')": f"AS OF {MID} 00:00:00: symbol IN ('a', 'b')",
    FROM: "AS OF now: TRUE",
}


@_register("SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in _STATEMENTS.items()) + ") AS t(statement, described)")
def described(spark, d):
    """The condition of a statement in words, as ``describe`` gives it above the plan."""
    e = Engine(store(spark, d, False))
    return spark.createDataFrame([(k, e.describe(k).splitlines()[0]) for k in _STATEMENTS], "statement string, described string")


@_register(f"{CTES} SELECT {SHOWN} FROM bars WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20'")
def zoned_literals(spark, d):
    """Against zoned data an offset is converted and a literal without zone is UTC."""
    zoned = bars(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    s = BarStore(zoned, None, HOUR, base_unique=True)
    rows = Engine(s, sort=False).execute(f"{FROM} WHERE timestamp >= '2024-01-10T02:00:00+02:00' AND timestamp < '2024-01-20T00:00:00'").data
    return shown(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


_TRIALS = """WITH r AS (SELECT event_type AS run, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT run, avg(value) - 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS low, avg(value) + 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS high FROM r WHERE k <= greatest(round(n * 0.85), 1) GROUP BY run)"""


@_register(f"{_TRIALS} SELECT a.run AS run, b.run AS other, a.low <= b.high AND b.low <= a.high AS overlap FROM s a JOIN s b ON a.run < b.run")
def interval_overlap(spark, d):
    """Which kinds of event have intervals that share a point."""
    s = trimmed_stats(table(spark, d, "events").select(F.col("event_type").alias("run"), "value"), "run", "value").select("run", "low", "high")
    other = s.select(F.col("run").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    return s.join(other, F.col("run") < F.col("other")).select("run", "other", overlap((F.col("low"), F.col("high")), (F.col("low2"), F.col("high2"))).alias("overlap"))


# Sources that make data up: what holds of them whatever the draws.


@_register("SELECT 7 AS symbols, 7 * 120 AS n_rows, 7 * 120 AS n_keys, 0 AS broken, TIMESTAMP '2023-01-02 16:00:00' AS first_time, TRUE AS same_again")
def synthetic_bars(spark, d):
    b = random_walk_bars(spark, 7, 120)
    broken = F.sum(((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("low") <= 0) | (F.dayofweek("timestamp").isin(1, 7))).cast("int"))
    out = b.agg(F.countDistinct("symbol").cast("int").alias("symbols"), F.count(F.lit(1)).cast("int").alias("n_rows"), F.countDistinct("symbol", "timestamp").cast("int").alias("n_keys"), broken.cast("int").alias("broken"), F.min("timestamp").cast("timestamp_ntz").alias("first_time"))
    return out.withColumn("same_again", F.lit(b.exceptAll(random_walk_bars(spark, 7, 120)).isEmpty()))


@_register(f"{CTES} SELECT max(timestamp) + INTERVAL 1 DAY AS txn_time, CAST(1.05 AS DOUBLE) AS factor, TRUE AS about_a_fifth, 0 AS strangers FROM bars")
def synthetic_corrections(spark, d):
    b = bars(spark, d).where(~F.isnan("close"))
    late = late_corrections(bars(spark, d), 0.2).where(~F.isnan("close"))
    j = late.join(b.select("symbol", "timestamp", F.col("close").alias("was"), F.lit(1).alias("known")), ["symbol", "timestamp"], "left")
    share = late.count() / max(b.count(), 1)
    return j.agg(F.max("txn_time").alias("txn_time"), F.round(F.max(F.when(F.col("was") != 0, F.col("close") / F.col("was"))), 6).alias("factor"), F.lit(0.12 < share < 0.28).alias("about_a_fifth"), F.count(F.when(F.col("known").isNull(), 1)).cast("int").alias("strangers"))


# Errors: what is refused, with which class, saying what.

_REFUSED = {
    f"{FROM} WHERE price > 1 OR price < 0": ("UnsupportedQueryError", "OR across columns is not supported"),
    f"{FROM} WHERE price > (SELECT 1)": ("UnsupportedQueryError", "Subqueries are not supported"),
    f"{FROM} WHERE symbol IN (SELECT symbol FROM data)": ("UnsupportedQueryError", "Subqueries are not supported"),
    f"{FROM} WHERE EXISTS (SELECT 1)": ("UnsupportedQueryError", "Subqueries are not supported"),
    "SELECT * FROM a JOIN b ON a.x = b.x": ("UnsupportedQueryError", "JOINs are not supported"),
    "SELECT max(price) FROM data": ("UnsupportedQueryError", "Aggregation functions are not supported"),
    "SELECT symbol FROM data": ("UnsupportedQueryError", "Unsupported expression type"),
    f"{FROM} ORDER BY symbol": ("UnsupportedQueryError", "Unsupported expression type"),
    f"{FROM} LIMIT 5": ("UnsupportedQueryError", "Unsupported expression type"),
    f"{FROM} UNION ALL {FROM}": ("UnsupportedQueryError", "Unsupported expression type"),
    f"{FROM} WHERE price BETWEEN 1 AND 2": ("UnsupportedQueryError", "Unsupported expression type"),
    f"{FROM} WHERE NOT price = 1": ("UnsupportedQueryError", "Unsupported expression type"),
    f"{FROM} WHERE symbol LIKE 'a%'": ("UnsupportedQueryError", "Unsupported expression type"),
    f"{FROM} WHERE open < close": ("UnsupportedQueryError", "comparisons require exactly one column and one literal"),
    f"{FROM} WHERE 1 < 2": ("UnsupportedQueryError", "comparisons require exactly one column and one literal"),
    f"{FROM} WHERE price > abs(1)": ("UnsupportedQueryError", "expected a literal"),
    f"{FROM} WHERE abs(price) > 1": ("UnsupportedQueryError", "expected a column reference"),
    f"{FROM} WHERE date IN ('2024-01-10')": ("UnsupportedQueryError", "IN with date-only literals is not supported"),
    "SELECT * FROM data TIMESTAMP AS OF current_date()": ("UnsupportedQueryError", "AS OF requires a literal"),
    "SELECT * FROM data TIMESTAMP AS OF": ("UnsupportedQueryError", "AS OF requires a literal"),
    "SELECT * FROM data VERSION AS OF 3": ("UnsupportedQueryError", "only TIMESTAMP AS OF is supported"),
    f"{FROM} WHERE colour = 'red'": ("ValueError", "unknown column"),
    f"{FROM} WHERE date > 'soon'": ("ValueError", "invalid datetime literal"),
    f"{FROM} WHERE price > 'much'": ("ValueError", "invalid floating-point literal"),
}
_CHECKS = {
    "missing columns": ("ValueError", "missing required columns"),
    "no column filled": ("ValueError", "columns without any value"),
    "schema of no table": ("TypeError", "a DataFrame is needed"),
    "timestamps as text": ("ValueError", "timestamp must be a datetime column"),
    "symbols as numbers": ("ValueError", "symbol must be a string column"),
    "replay of no table": ("TypeError", "a DataFrame is needed"),
    "replay twice a column": ("ValueError", "value columns must be unique"),
    "replay without columns": ("ValueError", "missing required columns"),
    "times of two kinds": ("ValueError", "timezone awareness"),
    "store without close": ("ValueError", "must include 'close'"),
    "store with names twice": ("ValueError", "must be unique"),
    "boundary that is none": ("TypeError", "chunk_boundary must provide"),
    "rows before stored ones": ("ValueError", "non-decreasing order"),
    "correction before event": ("ValueError", "cannot precede the event"),
    "unknown chunk": ("KeyError", "12345"),
    "removal of unknown chunk": ("KeyError", "12345"),
    "row that goes back": ("ValueError", "non-decreasing order"),
    "row that goes back after a flush": ("ValueError", "non-decreasing order"),
    "row with time as text": ("TypeError", "timestamp must be a datetime"),
    "row without symbol": ("TypeError", "symbol must be a non-empty string"),
    "row of wrong length": ("ValueError", "values are needed"),
    "row of other awareness": ("ValueError", "timezone awareness"),
    "late correction of its own past": ("ValueError", "cannot precede the event"),
    "unknown column in a predicate": ("ValueError", "unknown column"),
    "unknown operator in a predicate": ("ValueError", "unknown operator"),
    "missing file": ("FileNotFoundError", ""),
}


def _cases(spark: SparkSession, d: str) -> dict[str, Callable[[], object]]:
    s, b = store(spark, d, False), bars(spark, d)
    t, utc = datetime(2024, 1, 1), datetime.fromisoformat("2024-01-01T00:00:00+00:00")
    live = LiveStore(spark, folder(spark, "live"), HOUR, ["close"])
    live.ingest_row(t + timedelta(days=1), "A", [1.0])
    flushed = LiveStore(spark, folder(spark, "live"), HOUR, ["close"])
    flushed.ingest_row(t + timedelta(days=1), "A", [1.0])
    flushed.flush_all()
    late = b.withColumn("txn_time", F.col("timestamp") - F.expr("INTERVAL 1 DAY"))
    return {
        "missing columns": lambda: validate.validate_schema(b.drop("open")),
        "no column filled": lambda: validate.require_filled(b.withColumn("empty", F.lit(None).cast("string"))),
        "schema of no table": lambda: validate.validate_schema([1]),
        "timestamps as text": lambda: validate.validate_schema(b.withColumn("timestamp", F.col("timestamp").cast("string"))),
        "symbols as numbers": lambda: validate.validate_schema(b.withColumn("symbol", F.lit(1))),
        "replay of no table": lambda: Replay([1]),
        "replay twice a column": lambda: Replay(b, ["close", "close"]),
        "replay without columns": lambda: Replay(b.drop("close")),
        "times of two kinds": lambda: BarStore(b, b.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("txn_time", F.col("timestamp"))),
        "store without close": lambda: BarStore(b, value_columns=["open"]),
        "store with names twice": lambda: BarStore(b, value_columns=["close", "close"]),
        "boundary that is none": lambda: BarStore(b, boundary=3),
        "rows before stored ones": lambda: s.append(b.withColumn("timestamp", F.lit(t).cast("timestamp_ntz") - F.expr("INTERVAL 9 DAYS"))),
        "correction before event": lambda: s.correct(late),
        "unknown chunk": lambda: s.chunk(12345),
        "removal of unknown chunk": lambda: s.without_chunks([12345]),
        "row that goes back": lambda: live.ingest_row(t, "A", [1.0]),
        "row that goes back after a flush": lambda: flushed.ingest_row(t, "A", [1.0]),
        "row with time as text": lambda: live.ingest_row("2024-01-01", "A", [1.0]),
        "row without symbol": lambda: live.ingest_row(t, "", [1.0]),
        "row of wrong length": lambda: live.ingest_row(t, "B", [1.0, 2.0]),
        "row of other awareness": lambda: live.ingest_row(utc, "B", [1.0]),
        "late correction of its own past": lambda: live.ingest_correction(t, "A", [1.0], t - timedelta(microseconds=1)),
        "unknown column in a predicate": lambda: Comparison("colour", "=", 1),
        "unknown operator in a predicate": lambda: Comparison("close", "!=", 1.0),
        "missing file": lambda: load_bars(spark, f"{folder(spark, 'csv')}/none.csv"),
    }


def _said(run: Callable[[], object]) -> tuple[str, str]:
    try:
        run()
    except Exception as e:
        return type(e).__name__, str(e)
    return "none", ""


@_register("SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{e}', TRUE)" for k, (e, _) in (_REFUSED | _CHECKS).items()) + ") AS t(tried, error, says_why)")
def error_contract(spark, d):
    """What is refused: the class of the error, and whether its message has the words users match on."""
    engine = Engine(store(spark, d, False))
    tries = {q: (lambda q=q: engine.execute(q)) for q in _REFUSED} | _cases(spark, d)
    rows = []
    for name, (_, words) in (_REFUSED | _CHECKS).items():
        error, message = _said(tries[name])
        rows.append((name, error, words in message))
    return spark.createDataFrame(rows, "tried string, error string, says_why boolean")


# Corrections read off the written zone map after compaction.


@_register(f"{CTES} SELECT symbol, min(timestamp) AS time_start, max(timestamp) AS time_end, count(*) AS row_count, min(txn_time) AS txn_start, max(txn_time) AS txn_end FROM corrections GROUP BY symbol, date_trunc('month', timestamp)")
def written_compaction(spark, d):
    path = folder(spark, "store")
    store(spark, d).compact(boundary="monthly")[0].write(path)
    zones = BarStore.read(spark, path, boundary=HOUR, base_unique=True).zones().where("txn_start IS NOT NULL")
    return zones.select("symbol", "time_start", "time_end", "row_count", "txn_start", "txn_end")


@_register("SELECT CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('month', l_shipdate) AS month, count(*) AS row_count, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1, 2")
def zone_map_long(spark, d):
    """Zone map of a long table cut by month."""
    z = zonemap.build(BarStore(long_bars(spark, d), None, "monthly", base_unique=False).chunked_base(), "chunk_start")
    return z.select("symbol", F.col("chunk_start").alias("month"), "row_count", "min_price", "max_price")
