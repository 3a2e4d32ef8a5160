"""Per-period aggregates by event time, corrected as late records arrive.

The state of a period (symbol, UTC day of the event) is a multiset: how often
each value occurs. A record adds one to its value's count; a later version of
the same record takes one from the old value and adds one to the new one. All
aggregates, exact medians and distinct counts too, come from cumulative counts
over the multiset, so a correction never needs the period's records again.
Records that arrive later than the cut-off after the period's end are refused by
the state and change nothing; ``late_rows`` reads them off the same step.

Defined cases: rows without symbol or timestamp belong to no period and are
neither counted nor late; a correction without transaction time is not known to
have arrived and changes nothing; null and NaN values carry no value (they add
to ``n_rows`` only, so a correction to NaN takes the old value out); versions
with equal arrival are ordered base before correction, then by chunk and
position; empty input gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barlake.operators.chunkrows import chunk_rows

#: Lateness allowed after the end of the UTC day of the event, in hours; arrival at that very instant is in time.
CUTOFF_HOURS = 120
#: Shelves for each doubling of a value; a period has at most a few hundred thousand, a real one some thousand.
SHELVES = 64


def admitted(chunks: DataFrame, cutoff_hours: int = CUTOFF_HOURS) -> DataFrame:
    """Every stored row with its period ``day``, its ``deadline`` and whether it is ``late``."""
    rows = chunk_rows(chunks)
    deadline = F.date_trunc("day", "timestamp").cast("timestamp_ntz") + F.expr(f"make_dt_interval(1, {cutoff_hours}, 0, 0)")
    late = F.col("corr") & F.col("symbol").isNotNull() & (F.col("txn") > F.col("deadline"))
    return rows.withColumn("day", F.to_date("timestamp")).withColumn("deadline", deadline).withColumn("late", F.coalesce(late, F.lit(False)))


def apply_rows(chunks: DataFrame, value: str, cutoff_hours: int = CUTOFF_HOURS) -> DataFrame:
    """The state step: what every stored row does to the multiset of its period.

    Per record, one (symbol, timestamp), versions are taken in order of arrival,
    those after the cut-off last. ``version`` is the record's version in the state
    after the row, ``before`` the one before it: the state took the row if it went
    up and refused it if it stayed. ``new`` and ``old`` are the values the two
    stand for. A record's versions are bounded by how often it is corrected, so
    a hot symbol spreads over its timestamps.
    """
    rows = admitted(chunks, cutoff_hours).where(F.col("symbol").isNotNull() & F.col("timestamp").isNotNull() & F.col("txn").isNotNull())
    versions = W.partitionBy("symbol", "timestamp").orderBy("late", "txn", "corr", "chunk_id", "row_pos")
    upto = versions.rowsBetween(W.unboundedPreceding, 0)
    v = F.when(~F.isnan(value), F.col(value))
    steps = rows.withColumns({"version": F.count(F.when(~F.col("late"), 1)).over(upto), "new": v, "old": F.lag(v).over(versions)})
    taken = F.when(F.col("late"), 0).otherwise(1)
    return steps.withColumn("before", F.col("version") - taken).select("chunk_id", "row_pos", "symbol", "day", "corr", "before", "version", "old", "new")


def late_rows(chunks: DataFrame, value: str = "volume", cutoff_hours: int = CUTOFF_HOURS) -> DataFrame:
    """The rows of correction chunks that the state refused."""
    return apply_rows(chunks, value, cutoff_hours).where("corr AND version = before").select("chunk_id", "row_pos")


def count_deltas(chunks: DataFrame, value: str, cutoff_hours: int = CUTOFF_HOURS) -> DataFrame:
    """(symbol, day, value, delta, rows): what each row the state took changes in its period's multiset."""
    steps = apply_rows(chunks, value, cutoff_hours).where("version > before")
    moves = F.array(
        F.struct(F.col("new").alias("value"), F.when(F.col("new").isNotNull(), 1).otherwise(0).alias("delta"), (F.col("version") == 1).cast("int").alias("rows")),
        F.struct(F.col("old").alias("value"), F.when(F.col("old").isNotNull(), -1).otherwise(0).alias("delta"), F.lit(0).alias("rows")),
    )
    return steps.select("symbol", "day", F.inline(moves))


def multiset(deltas: DataFrame) -> DataFrame:
    """(symbol, day, value, n): the state. Counts are partly summed before the shuffle; counts of zero stay as the period's anchor."""
    return deltas.groupBy("symbol", "day", "value").agg(F.sum("delta").alias("n"), F.sum("rows").alias("rows"))


def _shelf(value: Column) -> Column:
    """A number that grows with the value and is the same for values that share sign, exponent and the first bits: SHELVES for each doubling."""
    size = F.log2(F.abs(value))
    steps = F.floor((size + 1100) * SHELVES).cast("long")
    return F.when(value > 0, steps).when(value < 0, -steps).otherwise(0)


def corrected_aggregates(chunks: DataFrame, value: str = "volume", cutoff_hours: int = CUTOFF_HOURS) -> DataFrame:
    """One row per symbol and UTC day: n_rows, n_values, total, median, n_distinct, smallest, largest.

    Counts are cumulated on two levels: over the shelves of a period, whose number
    is bounded, and within the one or two shelves in which the median lies. So no
    task holds all values of a period, however many a busy day has.
    """
    state = multiset(count_deltas(chunks, value, cutoff_hours)).withColumn("shelf", _shelf(F.col("value")))
    held = F.when((F.col("n") > 0) & F.col("value").isNotNull(), F.col("n")).otherwise(0)
    state = state.withColumn("held", held)
    live = F.when(F.col("held") > 0, F.col("value"))
    shelves = state.groupBy("symbol", "day", "shelf").agg(
        F.sum("rows").alias("rows"), F.sum("held").alias("held"), F.sum(live * F.col("held")).alias("total"), F.count(live).alias("distinct"), F.min(live).alias("low"), F.max(live).alias("high")
    )
    per = W.partitionBy("symbol", "day")
    all_ = F.sum("held").over(per)
    upto = F.sum("held").over(per.orderBy(F.col("shelf").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    ranked = shelves.withColumns({"all": all_, "upto": upto})
    # The ranks of the two middle values, as far as they lie on a shelf, counted from its beginning.
    before = F.col("upto") - F.col("held")
    on = lambda rank: F.when((rank > before) & (rank <= F.col("upto")), rank - before)
    ranked = ranked.withColumns({"_a": on(F.floor((F.col("all") + 1) / 2)), "_b": on(F.floor(F.col("all") / 2) + 1)})
    middle = ranked.where("held > 0 AND (_a IS NOT NULL OR _b IS NOT NULL)").select("symbol", "day", "shelf", "_a", "_b")
    within = W.partitionBy("symbol", "day", "shelf").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    near = state.where("held > 0").select("symbol", "day", "shelf", "value", F.sum("held").over(within).alias("_upto")).join(middle, ["symbol", "day", "shelf"])
    first = lambda rank: F.min(F.when(F.col("_upto") >= F.col(rank), F.col("value")))
    medians = near.groupBy("symbol", "day", "shelf").agg(first("_a").alias("_low"), first("_b").alias("_high")).groupBy("symbol", "day").agg(((F.max("_low") + F.max("_high")) / 2).alias("median"))
    out = ranked.groupBy("symbol", "day").agg(
        F.sum("rows").cast("long").alias("n_rows"), F.sum("held").cast("long").alias("n_values"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"),
        F.sum("distinct").cast("long").alias("n_distinct"), F.min("low").alias("smallest"), F.max("high").alias("largest"),
    )
    return out.join(medians, ["symbol", "day"], "left").select("symbol", "day", "n_rows", "n_values", "total", "median", "n_distinct", "smallest", "largest")
