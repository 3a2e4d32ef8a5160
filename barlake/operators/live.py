"""Row by row ingestion in front of a store, for code that holds one row at a time.

Every row meets the row contract and is cut into its symbol's chunk as it comes.
Rows of closed chunks go to Parquet in batches, each one file that the driver writes
without a job; rows of chunks that are still open are held and not seen before
``flush_all`` or the row that closes them, while corrections are seen at once. What
is held is one open chunk per symbol and one batch, so this is for feeds; tables of
any size go through ``BarStore.append`` and streams through ``streaming``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from barlake.operators.store import BarStore, Boundary
from barlake.schema import VALUES
from barlake.sources.driver import BATCH_ROWS, BatchFolder
from barlake.sources.replay import Replay


def crossing(boundary: Boundary) -> Callable[[datetime, datetime], bool]:
    """The rule by which a row no longer belongs to the chunk that began at a time."""
    if boundary == "monthly":
        return lambda start, at: (start.year, start.month) != (at.year, at.month)
    if isinstance(boundary, timedelta):
        return lambda start, at: at - start >= boundary
    rule = getattr(boundary, "crosses", boundary)
    if not callable(rule):
        raise TypeError("chunk_boundary must provide crosses(chunk_start, time)")
    return rule


class LiveStore:
    """Takes rows one by one and shows what is finalised as a ``BarStore``; files go to ``path``, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, boundary: Boundary = "monthly", value_columns: Sequence[str] = VALUES, batch_rows: int = BATCH_ROWS):
        self.spark, self.path, self.boundary, self.value_columns, self.batch_rows = spark, path, boundary, list(value_columns), batch_rows
        self._crosses = crossing(boundary)
        self._open: dict[str, list[tuple]] = {}
        self._starts: dict[str, datetime] = {}
        self._last: dict[str, datetime] = {}
        self._closed: list[tuple] = []
        self._late: list[tuple] = []
        self._seq, self._aware = 0, None
        self._folders: dict[str, BatchFolder] = {}

    def _row(self, timestamp: datetime, symbol: str, values: Sequence[float]) -> tuple[datetime, str, list[float]]:
        """The row contract: a datetime of the store's kind, a non-empty symbol, one number for each value column."""
        if not isinstance(timestamp, datetime):
            raise TypeError("timestamp must be a datetime")
        if not isinstance(symbol, str) or not symbol:
            raise TypeError("symbol must be a non-empty string")
        numbers = [float(v) for v in values]
        if len(numbers) != len(self.value_columns):
            raise ValueError(f"{len(self.value_columns)} values are needed, {len(numbers)} were given")
        aware = timestamp.tzinfo is not None
        if self._aware not in (None, aware):
            raise ValueError("times must be of one kind of timezone awareness")
        return timestamp, symbol, numbers

    def ingest_row(self, timestamp: datetime, symbol: str, values: Sequence[float]) -> None:
        """Adds a row to its symbol's open chunk; a failed row leaves no trace."""
        timestamp, symbol, numbers = self._row(timestamp, symbol, values)
        if symbol in self._last and timestamp < self._last[symbol]:
            raise ValueError(f"rows of {symbol} must come in non-decreasing order of time")
        if symbol in self._starts and self._crosses(self._starts[symbol], timestamp):
            self._close(symbol)
        self._aware = timestamp.tzinfo is not None
        start = self._starts.setdefault(symbol, timestamp)
        self._open.setdefault(symbol, []).append((symbol, timestamp, *numbers, self._seq, start))
        self._last[symbol] = timestamp
        self._seq += 1

    def ingest_correction(self, timestamp: datetime, symbol: str, values: Sequence[float], transaction_time: datetime) -> None:
        """Adds a version of a row, which need not exist; it may not arrive before its event."""
        timestamp, symbol, numbers = self._row(timestamp, symbol, values)
        if not isinstance(transaction_time, datetime):
            raise TypeError("transaction_time must be a datetime")
        if (transaction_time.tzinfo is None) != (timestamp.tzinfo is None):
            raise ValueError("times must be of one kind of timezone awareness")
        if transaction_time < timestamp:
            raise ValueError("a correction's transaction time cannot precede the event")
        self._aware = timestamp.tzinfo is not None
        self._late.append((symbol, timestamp, *numbers, self._seq, transaction_time))
        self._seq += 1
        if len(self._late) >= self.batch_rows:
            self._late = self._spill("corrections", self._late)

    def ingest_from_replay(self, replay: Replay) -> int:
        """Takes all rows of a replay and flushes; how many there were."""
        n = 0
        for row in replay:
            self.ingest_row(row["timestamp"], row["symbol"], row["values"])
            n += 1
        self.flush_all()
        return n

    def ingest_dataframe(self, rows: DataFrame) -> int:
        return self.ingest_from_replay(Replay(rows, self.value_columns))

    def flush_all(self) -> int:
        """Closes all open chunks; the next row of a symbol begins a new one. How many were closed."""
        open_ = list(self._open)
        for symbol in open_:
            self._close(symbol)
        return len(open_)

    def _close(self, symbol: str) -> None:
        self._closed += self._open.pop(symbol)
        del self._starts[symbol]
        if len(self._closed) >= self.batch_rows:
            self._closed = self._spill("base", self._closed)

    def _schema(self, table: str) -> T.StructType:
        kind = "timestamp" if self._aware else "timestamp_ntz"
        values = ", ".join(f"`{c}` double" for c in self.value_columns)
        return T._parse_datatype_string(f"symbol string, timestamp {kind}, {values}, ingest_seq long, {'chunk_start' if table == 'base' else 'txn_time'} {kind}")

    def _spill(self, table: str, rows: list[tuple]) -> list[tuple]:
        if table not in self._folders:
            self._folders[table] = BatchFolder(self.spark, f"{self.path}/{table}", self._schema(table))
        self._folders[table].add(rows)
        return []

    def _frame(self, table: str, held: list[tuple]) -> DataFrame:
        frame = self.spark.createDataFrame(held, self._schema(table))
        return self._folders[table].frame().unionByName(frame) if table in self._folders else frame

    def store(self) -> BarStore:
        """Finalised rows and all corrections."""
        return BarStore(self._frame("base", self._closed), self._frame("corrections", self._late), self.boundary, self.value_columns)
