"""Queries of the general training-data operators, p1 to p7, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import bad_rows, grid, known_at, late_events, spikes, stamps, trailing
from barlake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.mark_spikes(table(spark, d, "bars"), flagged_only=True).select("ingest_seq")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return spikes.mark_spikes(table(spark, d, "bars"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.late_rows(table(spark, d, "chunks"))


def p2_corrected(spark: SparkSession, d: str) -> DataFrame:
    return late_events.corrected_aggregates(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.missing_slots(table(spark, d, "bars"), table(spark, d, "symbols"))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "bars"), table(spark, d, "symbols")).withColumn("close", F.round("close", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return stamps.instants(table(spark, d, "feed_stamps"))


def p4_normalised(spark: SparkSession, d: str) -> DataFrame:
    return stamps.normalise(table(spark, d, "feed_stamps"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return known_at.leaking_signals(table(spark, d, "signals"), table(spark, d, "chunks"))


def p5_known(spark: SparkSession, d: str) -> DataFrame:
    return known_at.known_close(table(spark, d, "signals"), table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.bad_lines(table(spark, d, "raw_lines"), table(spark, d, "symbols"))


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded = bad_rows.strict_load(table(spark, d, "raw_lines"), table(spark, d, "symbols"))
    return loaded.withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return trailing.quiet_weeks(table(spark, d, "daily_bars"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    return trailing.trailing_totals(table(spark, d, "daily_bars")).withColumns({f"mean_{n}": F.round(f"mean_{n}", 3) for n in trailing.WINDOWS})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_scores, p2_found, p2_corrected, p3_found, p3_grid, p4_found, p4_normalised, p5_found, p5_known, p6_found, p6_loaded, p7_found, p7_totals)
}

_CHUNK_ROWS = """
  SELECT chunk_id, pos - 1 AS row_pos, symbol, transaction_time_start IS NOT NULL AS corr,
         timestamps[pos] AS ts,
         CASE WHEN transaction_time_start IS NULL THEN timestamps[pos] ELSE correction_transaction_times[pos] END AS txn,
         close_values[pos] AS close, volume_values[pos] AS volume
  FROM (SELECT *, unnest(range(1, len(timestamps) + 1)) AS pos FROM chunks)
"""

_SLOTS = """
readings AS (
  SELECT b.symbol, b.timestamp, b.close, b.ingest_seq, CAST(s.bar_minutes AS BIGINT) * 60 AS step,
         epoch_us(b.timestamp) // (CAST(s.bar_minutes AS BIGINT) * 60000000) AS slot, CAST(b.timestamp AS DATE) AS day
  FROM bars b JOIN symbols s ON b.symbol = s.symbol
  WHERE b.timestamp IS NOT NULL AND b.close IS NOT NULL AND NOT isnan(b.close) AND s.bar_minutes > 0
),
spans AS (SELECT symbol, day, step, min(slot) AS a, max(slot) AS z FROM readings GROUP BY ALL),
slots AS (SELECT symbol, step, unnest(range(a, z + 1)) AS slot FROM spans),
seen AS (SELECT symbol, slot, arg_max(close, (timestamp, ingest_seq)) AS close FROM readings GROUP BY ALL)
"""

_GRID = f"""WITH {_SLOTS},
knots AS (SELECT symbol, step, epoch_us(timestamp) AS us, arg_max(close, ingest_seq) AS y FROM readings GROUP BY ALL),
around AS (
  SELECT symbol, step, us AS u1, y AS y1, lag(us) OVER w AS u0, lag(y) OVER w AS y0, lead(us) OVER w AS u2, lead(y) OVER w AS y2, lead(us, 2) OVER w AS u3, lead(y, 2) OVER w AS y3
  FROM knots WINDOW w AS (PARTITION BY symbol ORDER BY us)),
gaps AS (
  SELECT *, u1 // (step * 1000000) AS s1, u2 // (step * 1000000) AS s2, (u2 - u1) / 1e6 AS h, (y2 - y1) / ((u2 - u1) / 1e6) AS d,
         (u1 - u0) / 1e6 AS h0, (y1 - y0) / ((u1 - u0) / 1e6) AS d0, (u3 - u2) / 1e6 AS h3, (y3 - y2) / ((u3 - u2) / 1e6) AS d3
  FROM around WHERE u1 // 86400000000 = u2 // 86400000000),
slopes AS (
  SELECT *, CASE WHEN u0 IS NULL THEN d WHEN d0 * d > 0 THEN (3 * h + 3 * h0) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) ELSE 0 END AS m1,
         CASE WHEN u3 IS NULL THEN d WHEN d * d3 > 0 THEN (3 * h3 + 3 * h) / ((2 * h3 + h) / d + (h3 + 2 * h) / d3) ELSE 0 END AS m2
  FROM gaps WHERE s2 - s1 > 1),
missing AS (SELECT *, unnest(range(s1 + 1, s2)) AS slot FROM slopes),
placed AS (SELECT *, (slot * step - u1 / 1e6) AS t, (slot * step - u1 / 1e6) / h AS u FROM missing)
SELECT symbol, slot * step AS slot_epoch, CASE WHEN s2 - s1 - 1 <= 6 THEN round(y1 + t * (m1 + u * ((3 * d - 2 * m1 - m2) + u * (m1 + m2 - 2 * d))), 6) END AS close,
       CASE WHEN s2 - s1 - 1 <= 6 THEN 'filled' ELSE 'gap' END AS status FROM placed
UNION ALL SELECT symbol, slot * step, round(close, 6), 'observed' FROM seen JOIN (SELECT DISTINCT symbol, step FROM readings) USING (symbol)
"""

_KNOWN = f"""
WITH r AS (SELECT * FROM ({_CHUNK_ROWS}) WHERE ts IS NOT NULL AND txn IS NOT NULL),
k AS (
  SELECT s.signal_id, arg_max_null(r.close, (r.ts, r.txn, r.corr, r.chunk_id, r.row_pos)) AS close
  FROM signals s JOIN r ON r.symbol = s.symbol AND r.ts <= s.decided_at AND r.txn <= s.decided_at GROUP BY 1
)
SELECT s.signal_id, CASE WHEN NOT isnan(k.close) THEN k.close END AS known_close, CASE WHEN NOT isnan(s.close_used) THEN s.close_used END AS used
FROM signals s LEFT JOIN k USING (signal_id)
"""

_FIELD = r"""(?:"(?:[^"]|"")*"|[^",]*)"""
_STAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?"
_LINES = rf"""
q AS (
  SELECT line_id, line, regexp_full_match(line, '(?s){_FIELD}(?:,{_FIELD})*') AS sound,
         regexp_extract_all(',' || line, '(?s),({_FIELD})', 1) AS f FROM raw_lines
),
t AS (
  SELECT line_id, sound, len(f) AS n,
         list_transform(f, lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END, E' \t\r\n')) AS v FROM q
),
judged AS (
  SELECT t.*, CASE WHEN NOT sound THEN 'quoting' WHEN n <> 7 THEN 'column_count'
    WHEN NOT (regexp_full_match(v[1], '{_STAMP}') AND try_cast(v[1][1:10] AS DATE) IS NOT NULL) THEN 'timestamp'
    WHEN v[2] NOT IN (SELECT symbol FROM symbols) THEN 'symbol'
    WHEN NOT (v[7] = '' OR v[7] = 'NaN' OR (regexp_full_match(v[7], '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND try_cast(v[7] AS DOUBLE) >= 0)) THEN 'volume' END AS reason FROM t
)
"""

_TRAILING = """
WITH last AS (SELECT symbol, timestamp, arg_max_null(volume, ingest_seq) AS v FROM daily_bars WHERE symbol IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2),
days AS (SELECT symbol, CAST(timestamp AS DATE) AS day, sum(CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE v END) AS amount FROM last GROUP BY 1, 2),
calendar AS (SELECT symbol, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM days GROUP BY 1),
filled AS (SELECT c.symbol, c.day, coalesce(amount, 0) AS amount FROM calendar c LEFT JOIN days d ON c.symbol = d.symbol AND c.day = d.day),
totals AS (
  SELECT symbol, day, sum(amount) OVER (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING) AS total_7,
         sum(amount) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) AS total_30 FROM filled
)
"""

SQL: dict[str, str] = {
    "p2_found": f"SELECT chunk_id, CAST(row_pos AS INT) AS row_pos FROM ({_CHUNK_ROWS}) WHERE corr AND symbol IS NOT NULL AND txn > date_trunc('day', ts) + INTERVAL 144 HOUR",
    "p2_corrected": f"""
WITH r AS (SELECT *, CAST(ts AS DATE) AS day FROM ({_CHUNK_ROWS}) WHERE symbol IS NOT NULL AND ts IS NOT NULL AND txn IS NOT NULL
           AND NOT (corr AND txn > date_trunc('day', ts) + INTERVAL 144 HOUR)),
last AS (SELECT symbol, day, ts, arg_max_null(volume, (txn, corr, chunk_id, row_pos)) AS v FROM r GROUP BY 1, 2, 3),
vals AS (SELECT symbol, day, CASE WHEN NOT isnan(v) THEN v END AS v FROM last)
SELECT symbol, day, count(*) AS n_rows, count(v) AS n_values, coalesce(sum(v), 0.0) AS total, median(v) AS median,
       count(DISTINCT v) AS n_distinct, min(v) AS smallest, max(v) AS largest FROM vals GROUP BY 1, 2""",
    "p3_found": f"WITH {_SLOTS} SELECT symbol, slot * step AS slot_epoch FROM slots ANTI JOIN seen USING (symbol, slot)",
    "p3_grid": _GRID,
    "p5_found": f"SELECT signal_id FROM ({_KNOWN}) WHERE used IS DISTINCT FROM known_close",
    "p5_known": f"SELECT signal_id, known_close FROM ({_KNOWN})",
    "p6_found": f"WITH {_LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p6_loaded": f"""WITH {_LINES} SELECT line_id, CAST(regexp_replace(v[1], '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '') AS TIMESTAMP)
    - CASE WHEN regexp_matches(v[1], ':.*[+-][0-9]{{2}}:[0-9]{{2}}$') THEN to_minutes(CAST(v[1][-6:-6] || '1' AS BIGINT) * (CAST(v[1][-5:-4] AS BIGINT) * 60 + CAST(v[1][-2:] AS BIGINT))) ELSE INTERVAL 0 MINUTE END AS timestamp, v[2] AS symbol, try_cast(v[3] AS DOUBLE) AS open,
  try_cast(v[4] AS DOUBLE) AS high, try_cast(v[5] AS DOUBLE) AS low, try_cast(v[6] AS DOUBLE) AS close,
  CASE WHEN v[7] <> 'NaN' THEN try_cast(v[7] AS DOUBLE) END AS volume FROM judged WHERE reason IS NULL""",
    "p7_found": f"{_TRAILING} SELECT symbol, strftime(day, '%Y-%m-%d') AS trade_day FROM totals WHERE total_7 = 0 AND total_30 > 0",
    "p7_totals": f"{_TRAILING} SELECT symbol, day, total_7, total_30, round(total_7 / 7, 3) AS mean_7, round(total_30 / 30, 3) AS mean_30 FROM totals",
}
