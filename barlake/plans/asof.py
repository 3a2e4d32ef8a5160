"""States of a bitemporal table: the current one and the one known at a time.

A correction's transaction time is never before its event time, a base row's is
its event time, and ties go to the correction. So a base row is visible at T if
and only if ``timestamp <= T`` and no visible correction has its key, which is an
anti-join: base rows are never shuffled into a window, and predicates on their
values reach the base scan. The window form computes the same from first
principles and serves as the unpruned engine and the reference in tests.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barlake.plans.predicate import AlwaysTrue, Predicate, conjuncts, on_key

KEY = ["symbol", "timestamp"]


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """The last version per key: by transaction time, then by order of arrival."""
    per = W.partitionBy(*KEY).orderBy(F.col("txn_time").desc(), F.col("ingest_seq").desc())
    return corrections.withColumn("_rn", F.row_number().over(per)).where("_rn = 1").drop("_rn")


def last_delivery(base: DataFrame) -> DataFrame:
    """Of base rows with one key the last by ``ingest_seq``; aggregates before it shuffles."""
    rest = [c for c in base.columns if c not in KEY]
    best = base.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "ingest_seq").alias("_r"))
    return best.select(*KEY, "_r.*").select(*base.columns)


def visible(base: DataFrame, corrections: DataFrame | None, as_of: Column | None, predicate: Predicate | None = None, base_unique: bool = True) -> DataFrame:
    """The rows of the state at ``as_of`` (None: current) that satisfy ``predicate``, in the base's columns.

    Predicates on the key hold for all versions of a row or none and go to every
    side; predicates on values are applied to base rows in their scan and to the
    corrections only after the last version is chosen.
    """
    predicate = predicate or AlwaysTrue()
    types = _types(base)
    cond = predicate.on_rows(types)
    key_cond = _all([p.on_rows(types) for p in conjuncts(predicate) if on_key(p)])
    rows = base if as_of is None else base.where(F.col("timestamp") <= as_of)
    if not base_unique:
        rows = last_delivery(rows.where(key_cond))
    if corrections is None:
        return rows.where(cond)
    seen = (corrections if as_of is None else corrections.where(F.col("txn_time") <= as_of)).where(key_cond)
    keep = [c for c in base.columns if c in corrections.columns]
    uncorrected = rows.join(seen.select(*KEY), KEY, "left_anti").where(cond)
    return uncorrected.select(*keep).unionByName(latest_corrections(seen).where(cond).select(*keep))


def visible_by_window(base: DataFrame, corrections: DataFrame | None, as_of: Column | None, predicate: Predicate | None = None) -> DataFrame:
    """The same state by ranking all versions of all keys; predicates come last."""
    cond = (predicate or AlwaysTrue()).on_rows(_types(base))
    keep = [c for c in base.columns if corrections is None or c in corrections.columns]
    every = base.select(*keep, F.col("timestamp").alias("_txn"), F.lit(False).alias("_corr"))
    if corrections is not None:
        every = every.unionByName(corrections.select(*keep, F.col("txn_time").alias("_txn"), F.lit(True).alias("_corr")))
    if as_of is not None:
        every = every.where(F.col("_txn") <= as_of)
    per = W.partitionBy(*KEY).orderBy(F.col("_txn").desc(), F.col("_corr").desc(), F.col("ingest_seq").desc())
    return every.withColumn("_rn", F.row_number().over(per)).where("_rn = 1").where(cond).select(*keep)
