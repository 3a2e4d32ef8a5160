"""Bars one by one in order of delivery: forward only, one reader, no length and no look ahead.

For feeding code that takes rows; rows come to the driver partition by
partition, in Arrow batches. Streams (``streaming.chunker``) use the whole cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.schema import VALUES
from barlake.sources.driver import local_rows
from barlake.sources.validate import require_columns

NAN = float("nan")


class Replay:
    """Iterates over {timestamp, symbol, values}; ``reset`` starts again from the first row."""

    def __init__(self, bars: DataFrame, value_columns: Sequence[str] = VALUES):
        if not isinstance(bars, DataFrame):
            raise TypeError("a DataFrame is needed")
        if len(set(bars.columns)) != len(bars.columns):
            raise ValueError("column names must be unique")
        names = list(value_columns)
        if len(set(names)) != len(names):
            raise ValueError("value columns must be unique")
        require_columns(bars.columns, ["timestamp", "symbol", "ingest_seq", *names])
        self._rows = bars.select("timestamp", "symbol", *[F.col(n).cast("double").alias(n) for n in names], "ingest_seq").orderBy("ingest_seq").drop("ingest_seq")
        self.reset()

    def reset(self) -> None:
        self._source: Iterator = local_rows(self._rows)
        self._next = next(self._source, None)

    @property
    def has_next(self) -> bool:
        return self._next is not None

    def next_row(self) -> dict:
        row = self._next
        if row is None:
            raise StopIteration
        timestamp, symbol, *values = row
        if timestamp is None or not symbol:
            raise ValueError("a bar needs a timestamp and a symbol")
        self._next = next(self._source, None)
        return {"timestamp": timestamp, "symbol": symbol, "values": [NAN if v is None else v for v in values]}

    def __iter__(self) -> Replay:
        return self

    def __next__(self) -> dict:
        return self.next_row()
