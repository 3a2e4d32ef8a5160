"""CSV sources of bars: one named file, checked before anything uses it."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.schema import VALUES
from barlake.session import cut_lineage, prepare
from barlake.sources import validate

TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under normalised names, with ``ingest_seq``, the row's place in the file."""
    prepare(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    if fs.getFileStatus(hadoop).isFile() and fs.getFileStatus(hadoop).getLen() == 0:
        raise ValueError(f"empty file: {os.path.basename(path)}")
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = [c.strip().lower() for c in raw.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after normalisation: {names}")
    return raw.toDF(*names).withColumn("ingest_seq", F.monotonically_increasing_id())


def _typed(df: DataFrame) -> DataFrame:
    """UTC times and doubles; missing numbers are NaN, impossible ones an error.

    The text is parsed once, into the checkpoint that all checks and everything after them read.
    """
    text = F.trim("timestamp")
    numbers = {c: F.trim(c).try_cast("double") for c in VALUES}
    parsed = df.select(
        *[F.when(text.rlike(TIME), F.expr("try_cast(trim(timestamp) AS timestamp)")).alias(c) if c == "timestamp" else F.coalesce(numbers[c], F.lit(float("nan"))).alias(c) if c in VALUES else F.col(f"`{c}`") for c in df.columns],
        F.struct(*[F.col(f"`{c}`").isNotNull().alias(c) for c in df.columns]).alias("_given"),
        F.struct(*[(F.col(c).isNotNull() & (F.trim(c) != "") & numbers[c].isNull()).alias(c) for c in VALUES]).alias("_wrong"),
    )
    parsed = cut_lineage(parsed)
    names = [c for c in df.columns if c != "ingest_seq"]
    seen = parsed.agg(
        F.struct(*[F.count(F.when(F.col("_given")[c], 1)).alias(c) for c in names]).alias("given"),
        F.sum(F.col("timestamp").isNull().cast("int")).alias("timestamp"),
        F.struct(*[F.sum(F.col("_wrong")[c].cast("int")).alias(c) for c in VALUES]).alias("wrong"),
    ).first()
    validate.reject_empty({c: seen.given[c] for c in names})
    if seen["timestamp"]:
        raise ValueError(f"timestamp must be ISO 8601 in every row; {seen['timestamp']} rows are not")
    bad = [c for c in VALUES if seen.wrong[c]]
    if bad:
        raise ValueError(f"columns with values that are no number: {', '.join(bad)}")
    warnings.warn(f"read as double: {', '.join(VALUES)}", RuntimeWarning, stacklevel=3)
    return parsed.drop("_given", "_wrong")


def load_bars(spark: SparkSession, path: str, keep_repeated: bool = False) -> DataFrame:
    """A merged file of many symbols: timestamp, symbol, values, ``ingest_seq``; other columns are kept.

    A key that comes twice is an error, or with ``keep_repeated`` a warning: all its rows are
    kept, and a store takes the last delivered for the version that counts.
    """
    df = read_csv(spark, path)
    validate.require_columns(df.columns, ["timestamp", "symbol", *VALUES])
    df = _typed(df)
    validate.require_unique(df, keep=keep_repeated)
    validate.require_order(df)
    return validate.validate_schema(df)


def load_single(spark: SparkSession, path: str, keep_repeated: bool = False) -> DataFrame:
    """A file of one symbol, without a symbol column, in order of time; repeated times as in ``load_bars``."""
    df = read_csv(spark, path)
    validate.require_columns(df.columns, ["timestamp", *VALUES])
    df = _typed(df)
    validate.require_unique(df, ("timestamp",), keep_repeated)
    validate.require_order(df.withColumn("symbol", F.lit("")))
    return df


def load_summary(df: DataFrame) -> DataFrame:
    """One row: rows, number of symbols, first and last time."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))
