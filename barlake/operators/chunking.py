"""Cutting each symbol's rows into chunks: by month, by fixed duration, by a rule of one's own.

A chunk is named by its symbol and its anchor ``chunk_start``. Windows of fixed
duration are anchored at each chunk's first row, so a chunk depends on where the
one before it began. Long histories are still cut in parallel: every time shard
is summarised as a step function from "no chunk may begin before" at its start
to the same at its end, the few steps are chained per symbol, and each shard then
cuts its own rows.

Defined cases: rows without symbol or timestamp are in no chunk and left out;
rows of equal time share a chunk; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.operators.timeshards import with_shards

UNBOUND = -(1 << 62)


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("symbol").isNotNull() & F.col("timestamp").isNotNull())


def monthly(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chunk_start``, the first instant of their month; no shuffle."""
    kind = rows.schema["timestamp"].dataType
    return _placed(rows).withColumn("chunk_start", F.date_trunc("month", "timestamp").cast(kind))


def starts(us: np.ndarray, width: int, bound: int) -> np.ndarray:
    """The chunk start of each of the ascending times, no chunk beginning before ``bound``; earlier rows belong to an open chunk (UNBOUND)."""
    out = np.full(len(us), UNBOUND, dtype=np.int64)
    i = int(np.searchsorted(us, bound))
    while i < len(us):
        j = int(np.searchsorted(us, us[i] + width))
        out[i:j] = us[i]
        i = j
    return out


def step_function(us: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry times, bound after the shard): entering at or before entry k, after k - 1, leaves with bound k."""
    n = len(us)
    nxt = np.searchsorted(us, us + width)
    leave = np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        leave[i] = us[i] + width if nxt[i] == n else leave[nxt[i]]
    reach = int(np.searchsorted(us, us[0] + width)) + 1
    entry, leave = us[:reach], leave[:reach]
    last = np.append(leave[1:] != leave[:-1], True)
    return entry[last], leave[last]


def anchored(rows: DataFrame, width: timedelta, target_rows: int = 50_000) -> DataFrame:
    """``rows`` with ``chunk_start``: a chunk holds what lies less than ``width`` after its first row."""
    span = width // timedelta(microseconds=1)
    if span <= 0:
        raise ValueError("a chunk's duration must be positive")
    kind = rows.schema["timestamp"].dataType
    sharded = with_shards(_placed(rows), "symbol", "timestamp", target_rows, 0).where("_own").withColumn("_us", _us("timestamp"))
    names = [f.name for f in rows.schema.fields]

    def summarise(table: pa.Table) -> pa.Table:
        entry, leave = step_function(np.unique(table["_us"].to_numpy()), span)
        return pa.table({"symbol": table["symbol"].slice(0, 1), "_shard": table["_shard"].slice(0, 1), "entry": pa.array([entry]), "leave": pa.array([leave])})

    def chain(table: pa.Table) -> pa.Table:
        order = np.argsort(table["_shard"].to_numpy())
        bound, bounds = UNBOUND, np.empty(len(order), dtype=np.int64)
        entry, leave = table["entry"].to_pylist(), table["leave"].to_pylist()
        for k in order:
            bounds[k] = bound
            at = int(np.searchsorted(entry[k], bound))
            # Entering behind every step of the summary cannot happen: a chunk begun before the shard ends within ``width`` of it.
            bound = leave[k][at] if at < len(entry[k]) else bound
        return pa.table({"symbol": table["symbol"], "_shard": table["_shard"], "_bound": bounds})

    def cut(table: pa.Table) -> pa.Table:
        us, bound = table["_us"].to_numpy(), table["_bound"][0].as_py()
        order = np.argsort(us, kind="stable")
        begun = starts(us[order], span, bound)
        begun = np.where(begun == UNBOUND, bound - span, begun)
        out = np.empty_like(begun)
        out[order] = begun
        return table.select(names).append_column("_start", pa.array(out))

    summary = sharded.select("symbol", "_shard", "_us").groupBy("symbol", "_shard")
    bounds = summary.applyInArrow(summarise, "symbol string, _shard int, entry array<long>, leave array<long>").groupBy("symbol").applyInArrow(chain, "symbol string, _shard int, _bound long")
    schema = T.StructType([*rows.schema.fields, T.StructField("_start", T.LongType())])
    done = sharded.join(bounds, ["symbol", "_shard"]).groupBy("symbol", "_shard").applyInArrow(cut, schema)
    start = F.timestamp_micros("_start")
    return done.select(*names, (start.cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else start).alias("chunk_start"))


def custom(rows: DataFrame, crosses: Callable[[datetime, datetime], bool]) -> DataFrame:
    """``rows`` with ``chunk_start`` by a rule ``crosses(chunk_start, time)``.

    The rule may look at anything, so a symbol is cut in one task in order of
    time; use ``anchored`` or ``monthly`` where they say the same.
    """
    names = [f.name for f in rows.schema.fields]
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk_start", rows.schema["timestamp"].dataType)])

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["timestamp", "ingest_seq"] if "ingest_seq" in frame else ["timestamp"], kind="stable")
        begun, out = None, []
        for t in frame["timestamp"]:
            if begun is None or crosses(begun, t):
                begun = t
            out.append(begun)
        return frame[names].assign(chunk_start=out)

    return _placed(rows).groupBy("symbol").applyInPandas(cut, schema)


def chunk_key(salt: int = 0) -> Column:
    """A stable 64-bit name of a chunk; (symbol, chunk_start) is the exact one, and a written store takes a ``salt`` under which no two names meet."""
    return F.xxhash64("symbol", _us("chunk_start"), F.lit(salt)) if salt else F.xxhash64("symbol", _us("chunk_start"))
