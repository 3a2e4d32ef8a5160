"""Which files of a written table a predicate can rule out.

A store is written with one row of bounds per file. They are few (as many as the
file listing every scan holds on the driver anyway), so they are kept there as
arrays and a statement opens candidate files only. Within a file Parquet's own
statistics go on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.plans.predicate import Predicate, conjunction, conjuncts

#: Beyond so many files their bounds are not held; statements then scan with Parquet's statistics alone.
MOST_FILES = 1_000_000


def bounds(parts: DataFrame) -> DataFrame:
    """One row per file from zone-map rows that name their file; times in microseconds."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return parts.groupBy("file").agg(
        F.sum("row_count").alias("n"), F.min("symbol").alias("symbol_low"), F.max("symbol").alias("symbol_high"), F.min(us("time_start")).alias("time_low"),
        F.max(us("time_end")).alias("time_high"), F.min("min_price").alias("price_low"), F.max("max_price").alias("price_high"), F.min(us("txn_start")).alias("txn_low"),
    )


@dataclass
class FileIndex:
    """Bounds per file: ``low`` and ``high`` by symbol, time and price; ``known_from``: when the first row of a file is known."""

    folder: str
    names: list[str]
    rows: np.ndarray
    low: dict[str, np.ndarray]
    high: dict[str, np.ndarray]
    known_from: np.ndarray

    @classmethod
    def load(cls, spark: SparkSession, path: str, folder: str) -> FileIndex | None:
        table = spark.read.parquet(path).limit(MOST_FILES + 1).toArrow()
        if table.num_rows > MOST_FILES:
            return None
        return cls.of(table, folder)

    @classmethod
    def of(cls, t: pa.Table, folder: str) -> FileIndex:
        get = lambda c: t[c].to_numpy(zero_copy_only=False)
        low = {k: get(f"{k}_low") for k in ("symbol", "time", "price")}
        high = {k: get(f"{k}_high") for k in ("symbol", "time", "price")}
        known = np.array([a if b is None else b for a, b in zip(t["time_low"].to_pylist(), t["txn_low"].to_pylist())], dtype=np.int64)
        return cls(folder, t["file"].to_pylist(), get("n"), low, high, known)

    def candidates(self, predicate: Predicate, types: dict, as_of_us: int | None = None, use_price: bool = True) -> np.ndarray:
        """A mask over the files; false proves that no row of the file can match."""
        if not use_price:
            predicate = conjunction([p for p in conjuncts(predicate) if getattr(p, "column", "") != "close"])
        mask = np.broadcast_to(np.asarray(predicate.on_bounds(self.low, self.high, types), dtype=bool), len(self.names))
        return mask if as_of_us is None else mask & (self.known_from <= as_of_us)

    def paths(self, mask: np.ndarray) -> list[str]:
        return [f"{self.folder}/{self.names[i]}" for i in np.flatnonzero(mask)]
