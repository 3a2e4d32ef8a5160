"""Checks on bars, each a relational query that returns or counts the violating rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from barlake.schema import VALUES


#: Sequence numbers that one symbol's deliveries are compared within.
DELIVERED = 1_000_000


def require_columns(columns: list[str], required: list[str]) -> None:
    missing = sorted(set(required) - set(columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def require_filled(df: DataFrame) -> None:
    """No column may be null throughout; one pass over all columns."""
    reject_empty(df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict())


def reject_empty(counts: dict[str, int]) -> None:
    empty = sorted(c for c, n in counts.items() if not n)
    if empty:
        raise ValueError(f"columns without any value: {', '.join(empty)}")


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp"), keep: bool = False) -> None:
    """No key may come twice; with ``keep`` that is a warning."""
    bad = duplicate_keys(df, keys)
    example = bad.first()
    if example is not None:
        said = f"duplicate ({', '.join(keys)}) rows: {bad.count()} keys, for example {tuple(example)[:-1]}"
        if not keep:
            raise ValueError(said)
        warnings.warn(said, RuntimeWarning, stacklevel=3)


def out_of_order(df: DataFrame, span: int = DELIVERED) -> DataFrame:
    """Rows that lie before the row of their symbol delivered just before, as ``previous``.

    A symbol's deliveries are compared within spans of ``span`` sequence numbers
    and, at a span's start, with the last row of the span before; so a hot
    symbol's rows never meet in one task.
    """
    rows = df.withColumn("_span", F.floor(F.col("ingest_seq") / span))
    ends = rows.groupBy("symbol", "_span").agg(F.max_by("timestamp", "ingest_seq").alias("_end"))
    ends = ends.select("symbol", "_span", F.lag("_end").over(W.partitionBy("symbol").orderBy("_span")).alias("_before"))
    within = F.lag("timestamp").over(W.partitionBy("symbol", "_span").orderBy("ingest_seq"))
    marked = rows.withColumns({"_lag": within, "_first": F.row_number().over(W.partitionBy("symbol", "_span").orderBy("ingest_seq")) == 1}).join(ends, ["symbol", "_span"])
    previous = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))
    return marked.withColumn("previous", previous).where("previous > timestamp").select(*df.columns, "previous")


def require_order(rows: DataFrame, base: DataFrame | None = None) -> None:
    """Per symbol times do not decrease in order of delivery, nor below what is stored already."""
    if not out_of_order(rows).isEmpty():
        raise ValueError("rows of a symbol must come in non-decreasing order of time")
    if base is not None:
        last = base.groupBy("symbol").agg(F.max("timestamp").alias("_last"))
        if not rows.join(last, "symbol").where("timestamp < _last").isEmpty():
            raise ValueError("rows of a symbol must come in non-decreasing order of time after those stored")


def acausal(corrections: DataFrame) -> DataFrame:
    return corrections.where("txn_time < timestamp")


def require_causality(corrections: DataFrame) -> None:
    if not acausal(corrections).isEmpty():
        raise ValueError("a correction's transaction time cannot precede the event")


def same_awareness(*frames: DataFrame | None) -> None:
    """All times of a table are zoned or none is."""
    kinds = {type(f.schema[c].dataType) for f in frames if f is not None for c in ("timestamp", "txn_time") if c in f.columns}
    if len(kinds) > 1:
        raise ValueError("times must be of one kind of timezone awareness")


def validate_schema(df: DataFrame) -> DataFrame:
    """``df`` with double values, if it has the bar columns in usable types."""
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    require_columns(df.columns, ["timestamp", "symbol", *VALUES])
    if not isinstance(df.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError("timestamp must be a datetime column")
    if not isinstance(df.schema["symbol"].dataType, T.StringType):
        raise ValueError("symbol must be a string column")
    return df.withColumns({c: F.col(c).cast("double") for c in VALUES})
