"""A stream of corrections into a written store.

Corrections touch no open chunk: each batch is appended beside the store and seen
by the next ``BarStore.read``. A batch is written under its own number, so one that
is run again after a failure replaces itself. Corrections that arrive before their
event or lack a time go on to the store, which sets them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from barlake.schema import VALUES


def correction_sink(corrections: DataFrame, path: str, checkpoint: str, values: tuple[str, ...] = VALUES, **trigger) -> StreamingQuery:
    """Starts the query; ``trigger`` as for ``DataStreamWriter.trigger`` (by default all that is there)."""
    rows = corrections.select("symbol", "timestamp", *values, "ingest_seq", "txn_time")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
