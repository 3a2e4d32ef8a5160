"""Irregular readings of a source onto its regular grid.

A source's readings are put in order within time shards that also hold the
neighbouring readings (halo) of the shards beside them. Slots between two
readings of one UTC day that no reading falls into are missing; short stretches
are filled by shape-preserving monotone cubic interpolation (Fritsch-Carlson
with weighted harmonic means), long ones stay marked. Slopes at a segment's ends
use the readings before and after it, which the halo supplies at shard borders.

Defined cases: a reading is a row with symbol, timestamp and a close that is
neither null nor NaN; symbols without a positive bar length have no grid; of
several deliveries for one time the last counts; of several readings in a slot
the last is shown; single readings give one slot; empty input gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barlake.operators.timeshards import with_shards

#: Longest stretch of missing slots that is filled.
MAX_FILL = 6
#: Readings needed beyond a shard: two before, two after, and repeats of them.
HALO = 32


def _slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Slope at an inner knot between secants d0 (over h0) and d1 (over h1): 0 at a turn, else the weighted harmonic mean; null at the ends."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, (w0 + w1) / (w0 / d0 + w1 / d1)).when(d0 * d1 <= 0, 0.0)


def _cubic(t: Column, knot: dict[str, Column]) -> Column:
    """Value at ``t`` seconds after x1, on [x1, x2], with slopes from x0 and x3 where they exist."""
    h = knot["x2"] - knot["x1"]
    d = (knot["y2"] - knot["y1"]) / h
    h0, h3 = knot["x1"] - knot["x0"], knot["x3"] - knot["x2"]
    m1 = F.coalesce(_slope(h0, h, (knot["y1"] - knot["y0"]) / h0, d), d)
    m2 = F.coalesce(_slope(h, h3, d, (knot["y3"] - knot["y2"]) / h3), d)
    u = t / h
    return knot["y1"] + t * (m1 + u * ((3 * d - 2 * m1 - m2) + u * (m1 + m2 - 2 * d)))


def regular_grid(bars: DataFrame, symbols: DataFrame, max_fill: int = MAX_FILL, target_rows: int = 50_000) -> DataFrame:
    """(symbol, slot_epoch, close, status): status is observed, filled or gap (a long stretch, close null).

    Per symbol and UTC day from the slot of the first to that of the last
    reading. One shuffle by (symbol, shard); everything stays in the JVM.
    """
    size = symbols.where(F.col("symbol").isNotNull() & (F.col("bar_minutes") > 0)).groupBy("symbol").agg((F.max("bar_minutes").cast("long") * 60).alias("_step"))
    readings = bars.select("symbol", "timestamp", "ingest_seq", "close").where(
        F.col("symbol").isNotNull() & F.col("timestamp").isNotNull() & F.col("close").isNotNull() & ~F.isnan("close")
    )
    sharded = with_shards(readings.join(size, "symbol"), "symbol", "timestamp", target_rows, HALO)
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = sharded.select("symbol", "_shard", "_own", "_step", "ingest_seq", us.alias("us"), F.col("close").alias("y1"))
    order = W.partitionBy("symbol", "_shard").orderBy("us", "ingest_seq")
    knots = rows.withColumn("_next", F.lead("us").over(order)).where(F.col("_next").isNull() | (F.col("_next") > F.col("us")))
    knots = knots.withColumns(
        {
            "us2": F.lead("us").over(order), "y2": F.lead("y1").over(order), "us3": F.lead("us", 2).over(order), "y3": F.lead("y1", 2).over(order),
            "us0": F.lag("us").over(order), "y0": F.lag("y1").over(order),
        }
    ).where("_own")
    step = F.col("_step")
    day_us = F.lit(86_400_000_000)
    slot = F.floor(F.col("us") / 1_000_000 / step)
    slot2 = F.floor(F.col("us2") / 1_000_000 / step)
    same_day = F.coalesce(F.floor(F.col("us") / day_us) == F.floor(F.col("us2") / day_us), F.lit(False))
    # The slot of the reading itself, unless a later reading falls into it too, and the missing ones up to the next reading.
    placed = knots.withColumns({"s1": slot, "s2": F.when(same_day, slot2).otherwise(slot + 1)}).where("s2 > s1")
    every = placed.withColumn("slot", F.explode(F.sequence("s1", F.col("s2") - 1)))
    seen = F.col("slot") == F.col("s1")
    short = F.col("s2") - F.col("s1") - 1 <= max_fill
    x1 = F.col("us") / 1e6
    rel = {f"x{k}": (F.col("us" if k == 1 else f"us{k}") - F.col("us")) / 1e6 for k in range(4)} | {f"y{k}": F.col(f"y{k}") for k in range(4)}
    filled = _cubic((F.col("slot") * step).cast("double") - x1, rel)
    return every.select(
        "symbol",
        (F.col("slot") * step).cast("long").alias("slot_epoch"),
        F.when(seen, F.col("y1")).when(short, filled).alias("close"),
        F.when(seen, "observed").when(short, "filled").otherwise("gap").alias("status"),
    )


def missing_slots(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    return regular_grid(bars, symbols).where(F.col("status") != "observed").select("symbol", "slot_epoch")
