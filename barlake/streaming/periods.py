"""Per-period aggregates of a stream of stored rows, corrected as late rows arrive.

State per period (symbol, UTC day of the event): per record the version that counts.
A later version of a record takes its place; rows after the cut-off are set apart
with status ``late``. Whenever rows of a period come, its aggregates are emitted anew.

A symbol's periods of one quarter are worked on together, as arrays, and kept as one
entry of the state while they have at most SMALL records, then as one entry a day. So
a call to the state serves many small periods, and what a change writes anew follows
the records of its period or is bounded by SMALL.

A period is final when the cut-off has passed. With ``lag_hours``, by which a stream
may run behind the arrival of its rows, the state of a period is let go when nothing
has changed it for the time a row can take to come in time: the day, the cut-off and
the lag (small periods that share an entry: nothing has changed any of them). That needs a clock, so it is for streams that run on; a trigger that ends
when all input is read (``availableNow``) would wait for the clock for ever, and
state is kept unless a lag is given.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barlake.operators.late_events import CUTOFF_HOURS, admitted
from barlake.streaming.chunker import rocksdb

RESULT = "symbol string, day date, status string, n_rows long, n_values long, total double, median double, n_distinct long, smallest double, largest double"


# The worker that sets up stateful processors has no access to shipped files; this module travels with its classes.
register_pickle_by_value(sys.modules[__name__])


#: Records up to which a symbol's quarter is one entry of the state, and the key of that entry.
SMALL, WHOLE = 4096, (-1,)
_RECORD = np.dtype([("ts", "i8"), ("txn", "i8"), ("corr", "?"), ("chunk_id", "i8"), ("row_pos", "i4"), ("value", "f8")])
_DAY_US, _EPOCH = 86_400_000_000, date(1970, 1, 1)


def _latest(held: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Each record's last version in order of time: by arrival, base before correction, chunk and position; what is held stays on a tie."""
    both = np.concatenate([new, held])
    both = both[np.lexsort([both[c] for c in ("row_pos", "chunk_id", "corr", "txn", "ts")])]
    return both[np.append(both["ts"][1:] != both["ts"][:-1], True)] if len(both) else both


def _aggregates(records: np.ndarray) -> list[tuple]:
    """(day, n_rows, n_values, total, median, n_distinct, smallest, largest) of each day in ``records``."""
    day = records["ts"] // _DAY_US
    order = np.lexsort((records["value"], day))  # NaN last
    day, value = day[order], records["value"][order]
    first = np.append(True, day[1:] != day[:-1])
    start = np.flatnonzero(first)
    seen = ~np.isnan(value)
    n = np.add.reduceat(seen.astype(np.int64), start)
    changed = seen & (first | np.append(True, value[1:] != value[:-1]))
    total, distinct = np.add.reduceat(np.where(seen, value, 0.0), start), np.add.reduceat(changed.astype(np.int64), start)
    at = lambda k: value[np.minimum(start + np.maximum(k, 0), len(value) - 1)]
    columns = (day[start], np.diff(np.append(start, len(day))), n, total, (at((n - 1) // 2) + at(n // 2)) / 2, distinct, at(n * 0), at(n - 1))
    return [r if r[2] else (*r[:4], None, 0, None, None) for r in zip(*[c.tolist() for c in columns])]


class PeriodProcessor(StatefulProcessor):
    """The periods of a symbol's quarter; versions of a record are ordered by arrival, base before correction, chunk and position."""

    def __init__(self, keep_ms: int | None = None, small: int = SMALL):
        self.keep_ms, self.small = keep_ms, small

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.keep_ms} if self.keep_ms else {}
        self.periods = handle.getMapState("periods", "day int", "records binary", **ttl)

    def _update(self, days: list[int], new: np.ndarray) -> np.ndarray:
        """The records of ``days`` after ``new`` ones, which the state then has too."""
        read = lambda kept: np.frombuffer(bytes(kept[0]), _RECORD)
        kept = self.periods.getValue(WHOLE)
        by_day = kept is None and self.periods.exists()
        parts = [read(x) for x in ([kept] if kept is not None else [self.periods.getValue((d,)) for d in days] if by_day else []) if x is not None]
        records = _latest(np.concatenate([np.empty(0, _RECORD), *parts]), new)
        day = records["ts"] // _DAY_US
        if len(new) and not by_day and len(records) <= self.small:
            self.periods.updateValue(WHOLE, (bytearray(records.tobytes()),))
        elif len(new):
            for d in np.unique(day if not by_day else new["ts"] // _DAY_US).tolist():
                self.periods.updateValue((d,), (bytearray(records[day == d].tobytes()),))
            if kept is not None:
                self.periods.removeKey(WHOLE)
        return records[np.isin(day, days)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts: list[np.ndarray] = []
        late: dict[int, int] = {}
        touched: set[int] = set()
        for frame in rows:
            is_late, day = frame["late"].to_numpy(bool), frame["day_no"].to_numpy(np.int64)
            touched.update(day.tolist())
            for d in day[is_late].tolist():
                late[d] = late.get(d, 0) + 1
            part = np.empty(int((~is_late).sum()), _RECORD)
            for c in _RECORD.names:
                part[c] = frame[c].to_numpy(_RECORD[c], na_value=np.nan)[~is_late] if c == "value" else frame[c].to_numpy(_RECORD[c])[~is_late]
            parts.append(part)
        out = []
        records = self._update(sorted(touched), np.concatenate(parts))
        if len(records):
            out = [(d, "period", *rest) for d, *rest in _aggregates(records)]
        out += [(d, "late", n, 0, 0.0, None, 0, None, None) for d, n in late.items()]
        frame = pd.DataFrame(out, columns=["day", "status", "n_rows", "n_values", "total", "median", "n_distinct", "smallest", "largest"])
        frame["day"] = [_EPOCH + timedelta(days=d) for d in frame["day"]]
        frame.insert(0, "symbol", key[0])
        yield frame

    def close(self) -> None:
        pass


def period_stream(chunks: DataFrame, value: str = "volume", cutoff_hours: int = CUTOFF_HOURS, lag_hours: int | None = None) -> DataFrame:
    """A stream of chunks as a stream of corrected periods (update mode): the last row of a period is its state."""
    rocksdb(chunks.sparkSession)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = admitted(chunks, cutoff_hours).where("symbol IS NOT NULL AND timestamp IS NOT NULL AND txn IS NOT NULL")
    day_no, quarter = F.unix_date("day").alias("day_no"), F.date_trunc("quarter", "day").cast("date").alias("quarter")
    rows = rows.select("symbol", quarter, day_no, us("timestamp").alias("ts"), us("txn").alias("txn"), "corr", "chunk_id", "row_pos", F.col(value).alias("value"), "late")
    keep = None if lag_hours is None else (24 + cutoff_hours + lag_hours) * 3_600_000
    return rows.groupBy("symbol", "quarter").transformWithStateInPandas(PeriodProcessor(keep), outputStructType=RESULT, outputMode="Update", timeMode="None" if keep is None else "ProcessingTime")
