"""Totals and averages over trailing periods, days without activity included.

Event-contribution deltas: a day's amount is added on its day and taken off when
the window has passed it; the running sum of the deltas over the calendar is the
window's total. Amounts are summed as fixed-point numbers in two longs, whose
unit follows the key's largest amount, so what was added is taken off exactly:
an idle window is exactly 0 whatever went through it before.

Defined cases: of repeated deliveries of one (symbol, timestamp) the highest
``ingest_seq`` counts, with its null or NaN volume as 0; rows without symbol or
timestamp are left out; a symbol's calendar runs from its first to its last
row; an empty table gives an empty result. Infinite volumes count as 0. Amounts
of any size are kept to 1e-29 of the key's largest; a smaller one counts as
that, so it never looks like no activity. Windows may hold up to 4,096 days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WINDOWS = (7, 30)
#: Decimal digits of the whole part of the largest amount, and bits of fraction; what is left of 63 bits is room for the days of a window.
DIGITS, BITS = 15, 50


def daily_amounts(rows: DataFrame, key: str = "symbol", ts: str = "timestamp", value: str = "volume", version: str = "ingest_seq") -> DataFrame:
    """(key, day, amount): superseded deliveries out. One shuffle by (key, day), so a hot key spreads over its days."""
    placed = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.to_date(ts).alias("day"), ts, value, version)
    last = placed.repartition(key, "day").groupBy(key, "day", ts).agg(F.max_by(value, version).alias("_v"))
    amount = F.when(F.isnan("_v") | (F.abs("_v") == float("inf")), 0.0).otherwise(F.coalesce(F.col("_v").cast("double"), F.lit(0.0)))
    return last.groupBy(key, "day").agg(F.sum(amount).alias("amount"))


def _scaled(x: Column, power: Column) -> Column:
    """``x`` times 10 ** ``power``, by the exact power of ten where there is one."""
    return F.when(power >= 0, x * F.pow(F.lit(10.0), power)).otherwise(x / F.pow(F.lit(10.0), -power))


def _limbs(amount: Column, power: Column) -> tuple[Column, Column]:
    """``amount`` times 10 ** ``power`` as a whole part and BITS bits of its fraction; what is not 0 does not become 0."""
    x = _scaled(amount, power)
    high = F.floor(x).cast("long")
    low = F.floor((x - high) * float(1 << BITS)).cast("long")
    return high, F.when((amount != 0) & (high == 0) & (low == 0), F.lit(1).cast("long")).otherwise(low)


def trailing_totals(rows: DataFrame, key: str = "symbol", windows: tuple[int, ...] = WINDOWS, **names: str) -> DataFrame:
    """(key, day, total_N, mean_N for each window N): every calendar day from the key's first to its last.

    Days are brought together by key once; deltas, calendar and running sums stay
    in that partitioning. It goes over a key's calendar days, which the length of
    history bounds, not over its rows: a hot key is already summed up to its days.
    """
    days = daily_amounts(rows, key, **names)
    of_key = W.partitionBy(key)
    placed = days.withColumns({"_next": F.lead("day").over(of_key.orderBy("day")), "_last": F.max("day").over(of_key), "_top": F.max(F.abs("amount")).over(of_key)})
    power = F.when(F.col("_top") > 0, F.greatest(F.lit(-290), F.least(F.lit(290), DIGITS - 1 - F.floor(F.log10("_top"))))).otherwise(0).cast("int")
    high, low = _limbs(F.col("amount"), F.col("_power"))
    placed = placed.withColumn("_power", power).withColumns({"_h": high, "_l": low})
    zero = F.lit(0).cast("long")

    def move(day: Column, of: tuple[int, ...], sign: int) -> Column:
        parts = [(sign * F.col(c) if n in of else zero).alias(f"{c[1]}{n}") for n in windows for c in ("_h", "_l")]
        return F.struct(day.alias("day"), *parts)

    idle = F.transform(F.when(F.col("_next") > F.date_add("day", 1), F.sequence(F.date_add("day", 1), F.date_sub("_next", 1))).otherwise(F.array().cast("array<date>")), lambda d: move(d, (), 1))
    passed = F.array_compact(F.array(*[F.when(F.date_add("day", w) <= F.col("_last"), move(F.date_add("day", w), (w,), -1)) for w in windows]))
    deltas = placed.select(key, "_power", F.inline(F.concat(F.array(move(F.col("day"), windows, 1)), idle, passed)))
    limbs = [f"{c}{n}" for n in windows for c in "hl"]
    per_day = deltas.groupBy(key, "_power", "day").agg(*[F.sum(c).alias(c) for c in limbs])
    run = of_key.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    held = per_day.withColumns({c: F.sum(c).over(run) for c in limbs})
    totals = {n: _scaled(F.col(f"h{n}") + F.col(f"l{n}") / float(1 << BITS), -F.col("_power")) for n in windows}
    return held.select(key, "day", *[totals[n].alias(f"total_{n}") for n in windows], *[(totals[n] / n).alias(f"mean_{n}") for n in windows])


def quiet_weeks(daily: DataFrame) -> DataFrame:
    """Days whose last 7 days saw nothing although the last 30 did."""
    found = trailing_totals(daily).where("total_7 = 0 AND total_30 > 0")
    return found.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("trade_day"))
