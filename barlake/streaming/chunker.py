"""Replay of bars as a stream: rows in order of delivery, chunks emitted as they close.

State per symbol is the open chunk: its anchor, bounds and count. A row that
crosses the boundary closes the chunk and opens the next; a row that lies before
the last one of its symbol is an error (strict) or is set apart with its reason.
No watermark is used, as it would drop such rows without a word and is one for
all symbols.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CLOSED = "symbol string, time_start timestamp, time_end timestamp, min_price double, max_price double, row_count long, status string"
_STATE = "start long, last long, low double, high double, n long"
_INF = float("inf")


def rocksdb(spark: SparkSession) -> None:
    """The provider that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# The worker that sets up stateful processors has no access to shipped files; this module travels with its classes.
register_pickle_by_value(sys.modules[__name__])


class ChunkProcessor(StatefulProcessor):
    """Closes a symbol's chunk at the month's end (``width_us`` None) or when ``width_us`` has passed since its first row."""

    def __init__(self, width_us: int | None, strict: bool):
        self.width_us, self.strict = width_us, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _STATE)

    def _crosses(self, start: int, at: int) -> bool:
        if self.width_us is not None:
            return at - start >= self.width_us
        a, b = pd.Timestamp(start, unit="us"), pd.Timestamp(at, unit="us")
        return (a.year, a.month) != (b.year, b.month)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        symbol = key[0]
        state = self.open.get() if self.open.exists() else None
        out: list[tuple] = []
        frames = pd.concat(list(rows)).sort_values("ingest_seq", kind="stable")
        flush = False
        for us, close, end in zip(frames["us"], frames["close"], frames["end_of_stream"]):
            if end:
                flush = True
                continue
            us = int(us)
            if state is not None and us < state[1]:
                if self.strict:
                    raise ValueError(f"rows of {symbol} must come in non-decreasing order of time")
                out.append((symbol, us, us, close, close, 1, "late"))
                continue
            if state is not None and self._crosses(state[0], us):
                out.append((symbol, *state, "closed"))
                state = None
            start, _, low, high, n = state if state is not None else (us, us, _INF, -_INF, 0)
            seen = close is not None and close == close
            state = (start, us, min(low, close) if seen else low, max(high, close) if seen else high, n + 1)
        if flush and state is not None:
            out.append((symbol, *state, "closed"))
            state = None
        if state is None:
            if self.open.exists():
                self.open.clear()
        else:
            self.open.update(state)
        frame = pd.DataFrame(out, columns=["symbol", "time_start", "time_end", "min_price", "max_price", "row_count", "status"])
        for c in ("time_start", "time_end"):
            frame[c] = pd.to_datetime(frame[c], unit="us", utc=True)
        yield frame

    def close(self) -> None:
        pass


def chunk_stream(bars: DataFrame, width: timedelta | None = None, strict: bool = True) -> DataFrame:
    """Closed chunks of a stream of bars (symbol, timestamp, close, ingest_seq); ``width`` None cuts by month.

    A row with ``end_of_stream`` true closes its symbol's open chunk.
    """
    rocksdb(bars.sparkSession)
    end = F.col("end_of_stream") if "end_of_stream" in bars.columns else F.lit(False)
    rows = bars.select("symbol", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "close", "ingest_seq", end.alias("end_of_stream"))
    us = None if width is None else width // timedelta(microseconds=1)
    return rows.groupBy("symbol").transformWithStateInPandas(ChunkProcessor(us, strict), outputStructType=CLOSED, outputMode="Append", timeMode="None")
