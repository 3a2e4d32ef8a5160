"""Synthetic bars and corrections, made where they are needed and the same every time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def random_walk_bars(spark: SparkSession, symbols: int, rows_per_symbol: int, seed: int = 7, start: str = "2023-01-02") -> DataFrame:
    """Daily bars on weekdays at 16:00: closes follow a geometric random walk per symbol, volumes are lognormal."""
    n = spark.range(symbols * rows_per_symbol).select((F.col("id") / rows_per_symbol).cast("long").alias("s"), (F.col("id") % rows_per_symbol).alias("k"))

    def uniform(salt: int):
        return (F.pmod(F.xxhash64("s", "k", F.lit(seed + salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(uniform(2) * 6.283185307179586)
    walk = F.sum("r").over(W.partitionBy("s").orderBy("k"))
    day = F.date_add(F.lit(start).cast("date"), (F.floor(F.col("k") / 5) * 7 + F.col("k") % 5).cast("int"))
    rows = n.withColumn("r", 0.02 * normal).withColumn("close", 100 * F.exp(walk)).withColumn("open", F.col("close") * (1 - F.col("r") / 2))
    span = F.abs("r") * F.col("close") * uniform(3)
    return rows.select(
        F.concat(F.lit("SYN"), F.lpad(F.col("s").cast("string"), 6, "0")).alias("symbol"), (day.cast("timestamp") + F.expr("INTERVAL 16 HOURS")).alias("timestamp"),
        "open", (F.greatest("open", "close") + span).alias("high"), (F.least("open", "close") - span).alias("low"), "close",
        F.round(F.exp(12 + uniform(4) * 2)).alias("volume"), (F.col("k") * symbols + F.col("s")).alias("ingest_seq"),
    )


def late_corrections(bars: DataFrame, share: float) -> DataFrame:
    """A share of the bars, chosen by hash, with the close raised by 5 % one day after the last bar."""
    last = bars.agg(F.max("timestamp").alias("t")).first().t
    chosen = bars.where(F.pmod(F.xxhash64("symbol", "timestamp"), F.lit(10_000)) < round(share * 10_000))
    arrival = F.lit(last).cast(bars.schema["timestamp"].dataType) + F.expr("INTERVAL 1 DAY")
    return chosen.withColumn("close", F.col("close") * 1.05).withColumn("txn_time", arrival)
