"""Rows that have to pass through the driver one by one: brought to it and written from it in batches.

The driver holds a partition or two of Arrow batches on the way in, and one batch on
the way out. A written batch is one complete Parquet file, put into its folder
through Spark's file system and without a job.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from datetime import timezone
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_ROWS = 50_000
_KINDS = {T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.LongType(): pa.int64(), T.TimestampNTZType(): pa.timestamp("us"), T.TimestampType(): pa.timestamp("us", "UTC")}


def _values(column: pa.ChunkedArray) -> list:
    """As rows have them: None for null, times of zoned columns in the process's own zone."""
    kind = column.type
    if pa.types.is_timestamp(kind):
        zoned, column = kind.tz is not None, column.cast(pa.int64()).cast(pa.timestamp("us"))
        times = column.to_numpy().astype("datetime64[us]").astype(object)
        if not zoned:
            return times.tolist()
        return [None if t is None else t.replace(tzinfo=timezone.utc).astimezone().replace(tzinfo=None) for t in times]
    if column.null_count or not (pa.types.is_floating(kind) or pa.types.is_integer(kind)):
        return column.to_pylist()
    return np.asarray(column.to_numpy()).tolist()


def local_rows(df: DataFrame) -> Iterator[tuple]:
    """The rows of ``df`` as tuples, in its order."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    for row in df.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
        yield from zip(*map(_values, pa.ipc.open_stream(row.batch).read_all().columns))


class BatchFolder:
    """A folder that takes rows batch by batch, each as one Parquet file that is seen whole or not at all."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema, self.n_rows = spark, path, schema, 0
        self._name = spark._jvm.org.apache.hadoop.fs.Path  # looked up once, which takes longer than to write a batch
        self._fs = self._name(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def add(self, rows: Sequence[tuple]) -> None:
        columns = [pa.array(values, _KINDS[f.dataType]) for values, f in zip(zip(*rows), self.schema)]
        sink = pa.BufferOutputStream()
        pq.write_table(pa.table(columns, names=self.schema.names), sink)
        name = f"part-{uuid.uuid4().hex}.parquet"
        made = self._name(f"{self.path}/_{name}")
        out = self._fs.create(made, False)
        try:
            out.write(sink.getvalue().to_pybytes())
        finally:
            out.close()
        if not self._fs.rename(made, self._name(f"{self.path}/{name}")):
            raise OSError(f"{self.path}/{name} cannot be written")
        self.n_rows += len(rows)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.n_rows else self.spark.createDataFrame([], self.schema)


def written_rows(spark: SparkSession, path: str, rows: Iterable[tuple], schema: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``rows``, however many, as a DataFrame that reads the folder ``path``, where they are put as they come."""
    folder, rows = BatchFolder(spark, path, T._parse_datatype_string(schema)), iter(rows)
    while held := list(islice(rows, batch_rows)):
        folder.add(held)
    return folder.frame()
