"""Zone maps: one row of bounds per chunk, and what a predicate can rule out by them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.chunking import chunk_key
from barlake.plans.predicate import Predicate, conjunction, conjuncts

COLUMNS = ["chunk_id", "symbol", "time_start", "time_end", "min_price", "max_price", "row_count", "txn_start", "txn_end"]


def build(chunked: DataFrame, *apart: str, salt: int = 0) -> DataFrame:
    """Bounds per chunk (and per value of the columns ``apart``, which are kept); closes that are NaN or null bound nothing, a chunk without others has (+inf, -inf).

    Corrections (rows with ``txn_time``) also get the bounds of their transaction
    times, by which a label is told from a base label.
    """
    price = F.when(~F.isnan("close"), F.col("close"))
    corr = "txn_time" in chunked.columns
    txn = F.col("txn_time") if corr else F.lit(None).cast(chunked.schema["timestamp"].dataType)
    keyed = chunked if "chunk_id" in chunked.columns else chunked.withColumn("chunk_id", chunk_key(salt))
    return keyed.groupBy("symbol", "chunk_id", *apart).agg(
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
        F.coalesce(F.min(price), F.lit(float("inf"))).alias("min_price"),
        F.coalesce(F.max(price), F.lit(float("-inf"))).alias("max_price"),
        F.count(F.lit(1)).alias("row_count"),
        F.min(txn).alias("txn_start"),
        F.max(txn).alias("txn_end"),
    ).select(*COLUMNS, *apart)


def merge(parts: DataFrame) -> DataFrame:
    """Zone-map rows of parts of chunks as one row per chunk."""
    fold = {"time_start": F.min, "time_end": F.max, "min_price": F.min, "max_price": F.max, "row_count": F.sum, "txn_start": F.min, "txn_end": F.max}
    return parts.groupBy("symbol", "chunk_id").agg(*[f(c).alias(c) for c, f in fold.items()]).select(*COLUMNS)


def may_be_visible(as_of: Column) -> Column:
    """A base chunk from its first row on, a correction chunk from its first arrival on."""
    return F.coalesce("txn_start", "time_start") <= as_of


def mark_candidates(zones: DataFrame, predicate: Predicate, as_of: Column | None = None, use_price: bool = True) -> DataFrame:
    """``zones`` with ``candidate``: false proves that no row of the chunk can match.

    Price bounds speak of the rows stored in a chunk, while a condition on values
    holds of the version that counts. A correction that does not match may hide a
    row that does, so chunks of corrections are never ruled out by price; base
    chunks are, unless ``use_price`` is false because the base itself holds several
    versions of a row.
    """
    types = {"timestamp": zones.schema["time_start"].dataType}
    keys = conjunction([p for p in conjuncts(predicate) if getattr(p, "column", "") != "close"])
    cond = keys.on_zones(types)
    if use_price:
        cond = cond & (F.col("txn_start").isNotNull() | predicate.on_zones(types))
    return zones.withColumn("candidate", cond if as_of is None else cond & may_be_visible(as_of))


@dataclass
class Pushdown:
    """What pruning does, counted when asked."""

    zones: DataFrame

    @cached_property
    def _totals(self) -> tuple[int, int]:
        r = self.zones.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("candidate").cast("int")).alias("c")).first()
        return r.n, r.c or 0

    @property
    def total_chunks(self) -> int:
        return self._totals[0]

    @property
    def candidate_count(self) -> int:
        return self._totals[1]

    @property
    def chunks_skipped_ratio(self) -> float:
        n, c = self._totals
        return (n - c) / n if n else 0.0

    @property
    def candidate_chunk_ids(self) -> DataFrame:
        return self.zones.where("candidate").select("chunk_id")

    @property
    def skipped_chunk_ids(self) -> DataFrame:
        return self.zones.where(~F.col("candidate")).select("chunk_id")
