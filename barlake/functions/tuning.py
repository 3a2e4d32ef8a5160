"""Thresholds for trials of a store, and what a clause adds to its pruning."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.plans.predicate import Predicate
from barlake.plans.zonemap import mark_candidates


def median_threshold(bars: DataFrame, column: str = "close") -> DataFrame:
    """One row: the exact median, by which a price clause halves the rows; null and NaN have no say."""
    return bars.where(F.col(column).isNotNull() & ~F.isnan(column)).agg(F.median(column).alias("threshold"))


def selectivity_threshold(zones: DataFrame, target: float) -> datetime | None:
    """The time from which about a share ``target`` of the stored span remains, by the zone map's bounds alone; None for an empty store."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first, last = zones.agg(F.min(us("time_start")), F.max(us("time_end"))).first()
    if first is None:
        return None
    at = first + int((last * (1 - target) - first * (1 - target)) // 1)
    zoned = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=at)
    return zoned if zones.schema["time_start"].dataType.typeName() == "timestamp" else zoned.replace(tzinfo=None)


def price_attribution(zones: DataFrame, predicate: Predicate) -> DataFrame:
    """One row: total_chunks, and candidates with and without the predicate's price clause."""
    priced = mark_candidates(zones, predicate).withColumnRenamed("candidate", "_priced")
    both = mark_candidates(priced, predicate, use_price=False)
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("total_chunks"), count("_priced").alias("with_price"), count("candidate").alias("without_price"))
