"""Cut the history of busy sources into time shards with halo readings.

Operators that look at a reading's neighbours need its source in time order.
One group per source would put a hot source (a third of all rows, say) into one
task. Here a source with more than ``target_rows`` rows is cut between days,
and within days that alone exceed the target between equal parts of the day,
into shards of about that many rows. Each shard also receives the neighbouring
days or parts that hold the ``halo_rows`` readings before and after it. Sources
below the target keep one shard, so most rows are not copied at all.

The cut needs one narrow pass: rows per source and day (a second one over the
days above the target, if there are any). Sources are cut by running sums over
these counts, whose number per source is bounded by the calendar and by rows
over target, never by the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A plan of at most so many entries is shipped to every task; beyond, it is joined by key.
PLAN_ROWS = 50_000
DAY_US = 86_400_000_000
#: A day above the target is cut into at least so many parts for each target it holds, but never finer than 2**FINEST.
PARTS, FINEST = 4, 22


def _part(ts: str, parts: Column) -> Column:
    """Which of the ``parts`` equal parts of its day a time falls into."""
    return F.floor(F.pmod(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(DAY_US)) * parts / DAY_US).cast("int")


def shard_plan(df: DataFrame, key: str, ts: str, target_rows: int, halo_rows: int) -> tuple[DataFrame, bool] | None:
    """(key, _day, _parts, _of): for the days of sources above the target, how many parts a day has and for each the shards that need it, the first being the owner.

    With it comes whether it is small enough to be shipped; None if no source is above the target.
    """
    spark = df.sparkSession
    days = df.groupBy(key, F.to_date(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    hot = days.withColumn("_all", F.sum("_n").over(W.partitionBy(key))).where(F.col("_all") > target_rows).drop("_all")
    rows = hot.take(PLAN_ROWS + 1)
    if not rows:
        return None
    small = len(rows) <= PLAN_ROWS
    if small:
        hot = spark.createDataFrame(rows, hot.schema)
    fine = F.least(F.lit(FINEST), F.ceil(F.log2(F.col("_n") * PARTS / target_rows)))
    hot = hot.withColumn("_parts", F.when(F.col("_n") > target_rows, F.pow(F.lit(2.0), fine)).otherwise(1).cast("int"))
    long_days = hot.where("_parts > 1")
    units = hot.where("_parts = 1").select(key, "_day", "_parts", F.lit(0).alias("_part"), "_n")
    if any(r["_n"] > target_rows for r in rows) if small else not long_days.isEmpty():
        of_day = long_days.select(F.col(key).alias("_key"), F.col("_day").alias("_d"), "_parts")
        busy = df.join(F.broadcast(of_day) if small else of_day, (df[key] == F.col("_key")) & (F.to_date(ts) == F.col("_d")))
        units = units.unionByName(busy.groupBy(key, F.col("_d").alias("_day"), "_parts", _part(ts, F.col("_parts")).alias("_part")).agg(F.count(F.lit(1)).alias("_n")))
    in_order = W.partitionBy(key).orderBy("_day", "_part")
    upto = F.sum("_n").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    spans = units.select(key, "_day", "_parts", "_part", upto.alias("_end"), (upto - F.col("_n")).alias("_start")).withColumn("_own", F.floor(F.col("_start") / target_rows).cast("int"))
    # Running sums leave no holes: a unit starts at the end of the one before. So a shard's border is met at the end of the unit before its first, and at the start of the unit after its last.
    near = max(halo_rows - 1, 0)
    ringed = spans.withColumns({"_before": F.lag("_own").over(in_order), "_after": F.lead("_own").over(in_order)})
    earlier = F.collect_set("_before").over(W.partitionBy(key).orderBy("_start").rangeBetween(-near, 0))
    later = F.collect_set("_after").over(W.partitionBy(key).orderBy("_end").rangeBetween(0, near))
    ringed = ringed.withColumns({"_e": earlier, "_l": later}).withColumn("_shards", F.array_distinct(F.concat(F.array("_own"), "_e", "_l")))
    plan = ringed.groupBy(key, "_day", "_parts").agg(F.map_from_entries(F.collect_list(F.struct("_part", "_shards"))).alias("_of"))
    if small:
        rows = plan.take(PLAN_ROWS + 1)
        small = len(rows) <= PLAN_ROWS and sum(len(r["_of"]) for r in rows) <= PLAN_ROWS
        if small:
            plan = spark.createDataFrame(rows, plan.schema)
    return plan, small


def with_shards(df: DataFrame, key: str, ts: str, target_rows: int = 50_000, halo_rows: int = 64) -> DataFrame:
    """``df`` with ``_shard``, ``_own`` (false for halo copies) and ``_cut`` (whether its source is cut at all).

    Rows without key or time must be taken out before. The largest shard holds
    about the target, one part of a day and the halo; only rows of equal time cannot be parted.
    """
    found = shard_plan(df, key, ts, target_rows, halo_rows)
    if found is None:
        return df.withColumns({"_shard": F.lit(0), "_own": F.lit(True), "_cut": F.lit(False)})
    plan, small = found
    plan = plan.withColumnRenamed(key, "_key")
    joined = df.join(F.broadcast(plan) if small else plan, (df[key] == F.col("_key")) & (F.to_date(df[ts]) == F.col("_day")), "left")
    shards = F.coalesce(F.element_at("_of", _part(ts, F.col("_parts"))), F.array(F.lit(0)))
    return (
        joined.withColumn("_cut", F.col("_of").isNotNull())
        .withColumn("_all_shards", shards)
        .withColumn("_first", F.get("_all_shards", F.lit(0)))
        .withColumn("_shard", F.explode("_all_shards"))
        .withColumn("_own", F.col("_shard") == F.col("_first"))
        .drop("_key", "_day", "_parts", "_of", "_first", "_all_shards")
    )
