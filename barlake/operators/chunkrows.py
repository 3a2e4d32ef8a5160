"""Stored chunks as rows: the lists of a chunk, aligned by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """One row per stored reading: chunk_id, row_pos, symbol, timestamp, txn, corr, close, volume.

    ``txn`` is when the store learned of the row: the row's own time in base
    chunks (those without transaction times), the row's transaction time in
    correction chunks, where a null means it is not known to have arrived.
    Lists of unequal length are padded with nulls; a null list counts as empty
    beside the others. Chunks without timestamps give no rows.
    """
    zipped = F.arrays_zip(
        F.coalesce("timestamps", F.array().cast("array<timestamp_ntz>")).alias("timestamps"),
        F.coalesce("correction_transaction_times", F.array().cast("array<timestamp_ntz>")).alias("txns"),
        F.coalesce("close_values", F.array().cast("array<double>")).alias("closes"),
        F.coalesce("volume_values", F.array().cast("array<double>")).alias("volumes"),
    )
    corr = F.col("transaction_time_start").isNotNull() | F.col("correction_transaction_times").isNotNull()
    rows = chunks.select("chunk_id", "symbol", corr.alias("corr"), F.posexplode(zipped).alias("row_pos", "_r"))
    ts = F.col("_r.timestamps")
    return rows.select(
        "chunk_id", "row_pos", "symbol", ts.alias("timestamp"),
        F.when(F.col("corr"), F.col("_r.txns")).otherwise(ts).alias("txn"), "corr",
        F.col("_r.closes").alias("close"), F.col("_r.volumes").alias("volume"),
    )
