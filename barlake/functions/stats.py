"""Trial statistics: the slowest share is dropped, then mean, spread and a normal 95 % interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEPT, NORMAL_95 = 0.85, 1.96


def trimmed_stats(trials: DataFrame, group: str, value: str, kept: float = KEPT) -> DataFrame:
    """(group, n, mean, std, low, high) over the ``kept`` share of smallest values of each group; null and NaN values are no trials."""
    rows = trials.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(group), F.col(value).alias("_v"))
    ranked = rows.withColumns({"_k": F.row_number().over(W.partitionBy(group).orderBy("_v")), "_n": F.count(F.lit(1)).over(W.partitionBy(group))})
    kept_rows = ranked.where(F.col("_k") <= F.greatest(F.round(F.col("_n") * kept), F.lit(1)))
    out = kept_rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std"))
    half = NORMAL_95 * F.col("std") / F.sqrt("n")
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def overlap(a, b):
    """Whether two closed intervals share a point; bounds may be numbers or Columns."""
    return (a[0] <= b[1]) & (b[0] <= a[1])
