"""The table handle: base rows, corrections, their chunks and zone maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators import chunking
from barlake.plans import asof, fileindex, zonemap
from barlake.plans.fileindex import FileIndex
from barlake.plans.predicate import AlwaysTrue, Predicate, conjunction, conjuncts, instant_us, literal, on_key
from barlake.schema import VALUES
from barlake.session import cut_lineage
from barlake.sources import validate

Boundary = str | timedelta | Callable[[datetime, datetime], bool]


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def cut(rows: DataFrame, boundary: Boundary) -> DataFrame:
    """``rows`` with ``chunk_start`` by month, by a duration from each chunk's first row, or by a rule."""
    if boundary == "monthly":
        return chunking.monthly(rows)
    if isinstance(boundary, timedelta):
        return chunking.anchored(rows, boundary)
    rule = getattr(boundary, "crosses", boundary)
    if not callable(rule):
        raise TypeError("chunk_boundary must provide crosses(chunk_start, time)")
    return chunking.custom(rows, rule)


class BarStore:
    """Append-only bars with late corrections, all lazy.

    ``base``: symbol, timestamp, values and ``ingest_seq``; ``corrections``: the same
    with ``txn_time``. ``base_unique`` may be given where keys are known to be
    unique; otherwise it is found once, when a state is first asked for.
    Base rows without symbol or timestamp have no key and belong to no state, chunk
    or count. Neither do corrections that lack either, arrive before their event or at
    no known time: they are versions of nothing and kept in ``set_apart``.

    A store that was written keeps its zone map and the bounds of its files, and
    statements open only the files that can hold an answer.
    """

    def __init__(self, base: DataFrame, corrections: DataFrame | None = None, boundary: Boundary = "monthly", value_columns: Sequence[str] = VALUES, base_unique: bool | None = None):
        names = list(value_columns)
        if not names or not all(isinstance(n, str) for n in names) or len(set(names)) != len(names):
            raise ValueError("value columns must be unique names")
        if "close" not in names:
            raise ValueError("value columns must include 'close'")
        if not (boundary == "monthly" or isinstance(boundary, timedelta) or callable(boundary) or callable(getattr(boundary, "crosses", None))):
            raise TypeError("chunk_boundary must provide crosses(chunk_start, time)")
        validate.same_awareness(base, corrections)
        self.value_columns, self.boundary = names, boundary
        columns = ["symbol", "timestamp", *names, "ingest_seq"]
        keyed = F.col("symbol").isNotNull() & F.col("timestamp").isNotNull()
        self.base = base.select(*columns, *[c for c in ("chunk_start",) if c in base.columns]).where(keyed)
        given = None if corrections is None else corrections.select(*columns, "txn_time", *[c for c in ("chunk_start",) if c in corrections.columns])
        causal = F.col("symbol").isNotNull() & F.coalesce(F.col("txn_time") >= F.col("timestamp"), F.lit(False))
        self._corrections = None if given is None else given.where(causal)
        self.set_apart = None if given is None else given.where(~causal).select(*columns, "txn_time")
        self._unique = base_unique
        self.path: str | None = None
        self._files: dict[str, FileIndex] = {}

    def _with_apart(self, store: BarStore) -> BarStore:
        """``store``, made from this one, with the corrections set apart here."""
        store.set_apart = self.set_apart
        return store

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    @cached_property
    def has_corrections(self) -> bool:
        return self._corrections is not None and not self._corrections.isEmpty()

    @property
    def corrections(self) -> DataFrame | None:
        return self._corrections if self.has_corrections else None

    @property
    def base_unique(self) -> bool:
        if self._unique is None:
            self._unique = validate.duplicate_keys(self.base).isEmpty()
        return self._unique

    def _plain(self) -> DataFrame:
        return self.base.drop("chunk_start")

    def time(self, at: datetime | None) -> Column | None:
        return None if at is None else literal(at, self.base.schema["timestamp"].dataType)

    @property
    def price_prunes(self) -> bool:
        """Whether price bounds may rule out base chunks: only where a key has one base row, which is then the version that counts or none."""
        return self.base_unique

    def files(self, predicate: Predicate | None = None, as_of: datetime | None = None, table: str = "base") -> list[str] | None:
        """The files of a written store that can hold rows of the state; None where no bounds are held."""
        index = self._files.get(table)
        if index is None:
            return None
        predicate = predicate or AlwaysTrue()
        types = {f.name: f.dataType for f in self.base.schema.fields}
        if table != "base":
            predicate = conjunction([p for p in conjuncts(predicate) if on_key(p)])
        use_price = table == "base" and "close" in {getattr(p, "column", "") for p in conjuncts(predicate)} and self.price_prunes
        return index.paths(index.candidates(predicate, types, None if as_of is None else instant_us(as_of, types["timestamp"]), use_price))

    def _scan(self, table: str, whole: DataFrame | None, predicate: Predicate | None, as_of: datetime | None) -> DataFrame | None:
        """``whole``, or its candidate files alone."""
        picked = None if whole is None else self.files(predicate, as_of, table)
        if picked is None or len(picked) == len(self._files[table].names):
            return whole
        if not picked:
            return whole.limit(0)
        return self.spark.read.schema(whole.schema).parquet(*picked)

    def state(self, as_of: datetime | None = None, predicate: Predicate | None = None) -> DataFrame:
        """The anti-join plan.

        Versions are resolved if a time is given or the table has corrections,
        else base rows are shown as they are.
        """
        # Where keys are unique, corrections that turn out empty change nothing, so they need not be looked at first.
        corrections = self._corrections if self._unique else self.corrections
        unique = True if as_of is None and corrections is None else self.base_unique
        base = self._scan("base", self.base, predicate, as_of).drop("chunk_start")
        late = self._scan("corrections", corrections, predicate, as_of)
        return asof.visible(base, late, self.time(as_of), predicate, unique).select("timestamp", "symbol", *self.value_columns)

    def state_by_window(self, as_of: datetime | None = None, predicate: Predicate | None = None) -> DataFrame:
        corrections = self._corrections if self._unique else self.corrections
        if as_of is None and corrections is None:
            return asof.visible(self._plain(), None, None, predicate).select("timestamp", "symbol", *self.value_columns)
        return asof.visible_by_window(self._plain(), corrections, self.time(as_of), predicate).select("timestamp", "symbol", *self.value_columns)

    def chunked_base(self) -> DataFrame:
        return self.base if "chunk_start" in self.base.columns else cut(self.base, self.boundary)

    def chunked_corrections(self) -> DataFrame | None:
        """Until compaction a correction is a chunk of its own, named by its arrival number."""
        c = self.corrections
        if c is None or "chunk_start" in c.columns:
            return c
        return c.withColumn("chunk_start", F.col("timestamp")).withColumn("chunk_id", F.xxhash64("symbol", "ingest_seq", F.lit("correction")))

    def _zone_parts(self) -> DataFrame | None:
        """The written zone map: one row per chunk and file."""
        return None if self.path is None else self.spark.read.parquet(f"{self.path}/zones")

    def zones(self) -> DataFrame:
        """One row of bounds per chunk: as written, or counted."""
        parts = self._zone_parts()
        if parts is not None:
            return zonemap.merge(parts)
        base = zonemap.build(self.chunked_base())
        late = self.chunked_corrections()
        return base if late is None else base.unionByName(zonemap.build(late))

    def pushdown(self, predicate: Predicate, as_of: datetime | None = None) -> zonemap.Pushdown:
        return zonemap.Pushdown(zonemap.mark_candidates(self.zones(), predicate, self.time(as_of), self.price_prunes))

    def _named(self, df: DataFrame | None) -> DataFrame | None:
        return df if df is None or "chunk_id" in df.columns else df.withColumn("chunk_id", chunking.chunk_key())

    def chunk(self, chunk_id: int) -> DataFrame:
        """The rows of one chunk; KeyError if there is none of that name.

        A written store looks the name up in its zone map and opens the chunk's files;
        any other is cut whole, as its chunks are nowhere but in the cut.
        """
        columns = ["timestamp", "symbol", *self.value_columns]
        parts = self._zone_parts()
        if parts is not None:
            found = parts.where(F.col("chunk_id") == chunk_id).select("symbol", _us("chunk_start").alias("us"), "table", "file").collect()
            if not found:
                raise KeyError(chunk_id)
            table = found[0]["table"]
            whole = self.base if table == "base" else self._corrections
            rows = self.spark.read.schema(whole.schema).parquet(*[f"{self.path}/{table}/{f}" for f in sorted({r.file for r in found})])
            here = (F.col("symbol") == found[0].symbol) & (_us("chunk_start") == found[0].us if table == "base" else F.col("chunk_id") == chunk_id)
            return rows.where(here).select(*columns)
        rows = self._named(self.chunked_base()).where(F.col("chunk_id") == chunk_id).select(*columns)
        late = self._named(self.chunked_corrections())
        if late is not None:
            rows = rows.unionByName(late.where(F.col("chunk_id") == chunk_id).select(*columns))
        if rows.isEmpty():
            raise KeyError(chunk_id)
        return rows

    def column_arrays(self, chunk_id: int) -> dict:
        """One chunk's columns as numpy arrays, in order of time."""
        table = self.chunk(chunk_id).orderBy("timestamp").toArrow()
        return {name: table[name].to_numpy() for name in table.column_names}

    def without_chunks(self, chunk_ids: Sequence[int]) -> BarStore:
        """A store without the named chunks; KeyError if one is unknown, and then nothing changes.

        A written store takes the names from its zone map; any other is cut once.
        """
        ids = list(dict.fromkeys(chunk_ids))
        parts = self._zone_parts()
        base, late = self.chunked_base(), self._named(self.chunked_corrections())
        if parts is not None:
            found = parts.where(F.col("chunk_id").isin(ids)).select("chunk_id", "symbol", _us("chunk_start").alias("us"), "table").distinct().collect()
            known = {r.chunk_id for r in found}
            gone = [(r.symbol, r.us) for r in found if r.table == "base"]
            dropped = self.spark.createDataFrame(gone, "symbol string, _us long")
            kept = base.withColumn("_us", _us("chunk_start")).join(F.broadcast(dropped), ["symbol", "_us"], "left_anti").select(*base.columns) if gone else base
        else:
            base = cut_lineage(self._named(base))
            known = {r.chunk_id for df in (base, late) if df is not None for r in df.where(F.col("chunk_id").isin(ids)).select("chunk_id").distinct().collect()}
            kept = base.where(~F.col("chunk_id").isin(ids)).drop("chunk_id")
        for i in ids:
            if i not in known:
                raise KeyError(i)
        rest = None if late is None else late.where(~F.col("chunk_id").isin(ids)).drop("chunk_id", "chunk_start")
        return self._with_apart(BarStore(kept, rest, self.boundary, self.value_columns, self._unique))

    def finalised(self) -> BarStore:
        """What is seen before a flush: each symbol's last chunk is still open and its rows are left out; corrections are seen at once."""
        base = self.chunked_base()
        last = base.groupBy("symbol").agg(F.max("chunk_start").alias("_open"))
        closed = base.join(last, "symbol").where("chunk_start < _open").select(*base.columns)
        return self._with_apart(BarStore(closed, self._corrections, self.boundary, self.value_columns, self._unique))

    def full_scan(self, rule: Callable[[dict], bool] | None = None) -> DataFrame:
        """All stored rows, superseded ones too, or those a Python rule accepts (row by row; a Column filter is the fast way)."""
        rows = self._plain()
        if self.corrections is not None:
            rows = rows.unionByName(self.corrections.drop("txn_time", "chunk_start", "chunk_id"))
        rows = rows.select("timestamp", "symbol", *self.value_columns)
        if rule is None:
            return rows
        accept = F.udf(lambda r: bool(rule(r.asDict())), "boolean")
        return rows.where(accept(F.struct("*")))

    def append(self, rows: DataFrame) -> BarStore:
        """A store with further base rows, which may not lie before their symbol's last one."""
        validate.require_order(rows, self.base)
        return self._with_apart(BarStore(self._plain().unionByName(rows.select(*self._plain().columns)), self._corrections, self.boundary, self.value_columns))

    def correct(self, rows: DataFrame) -> BarStore:
        """A store with further corrections; none may arrive before its event."""
        validate.require_causality(rows)
        new = rows.select("symbol", "timestamp", *self.value_columns, "ingest_seq", "txn_time")
        if self._corrections is not None:
            new = self._corrections.drop("chunk_start", "chunk_id").unionByName(new)
        return self._with_apart(BarStore(self.base, new, self.boundary, self.value_columns, self._unique))

    def compact(self, symbol: str | None = None, boundary: Boundary | None = None) -> tuple[BarStore, DataFrame]:
        """Correction chunks merged per symbol in order of event time, and (symbol, before, after) per compacted symbol.

        Only chunk names change, never rows, times of arrival or order, so no
        state changes. Symbols with fewer than two correction chunks are left.
        """
        late = self.chunked_corrections()
        if late is None:
            return self, self.spark.createDataFrame([], "symbol string, before long, after long")
        late = late if "chunk_id" in late.columns else late.withColumn("chunk_id", chunking.chunk_key())
        before = late.groupBy("symbol").agg(F.countDistinct("chunk_id").alias("before"))
        due = before.where("before >= 2")
        due = due if symbol is None else due.where(F.col("symbol") == symbol)
        merged = cut(late.drop("chunk_start", "chunk_id").join(due.select("symbol"), "symbol", "left_semi"), boundary or self.boundary).withColumn("chunk_id", chunking.chunk_key())
        rest = late.join(due.select("symbol"), "symbol", "left_anti")
        after = merged.groupBy("symbol").agg(F.countDistinct("chunk_id").alias("after"))
        store = self._with_apart(BarStore(self.base, None, self.boundary, self.value_columns, self._unique))
        store._corrections = merged.unionByName(rest.select(*merged.columns))
        return store, due.join(after, "symbol").select("symbol", "before", "after")

    def stats(self) -> DataFrame:
        """One row: total_chunks, total_rows (superseded ones too), total_column_bytes, has_corrections."""
        z = self.zones()
        return z.agg(
            F.count(F.lit(1)).alias("total_chunks"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
            (F.coalesce(F.sum("row_count"), F.lit(0)) * len(self.value_columns) * 8).alias("total_column_bytes"),
            F.lit(self.has_corrections).alias("has_corrections"),
        )

    def write(self, path: str, partitions: int | None = None) -> None:
        """Base, corrections, zone map and bounds of files as Parquet.

        Rows are laid out by month, symbol and time, so both a symbol's and a
        month's rows lie in few files. The zone map is read off the written files.
        """

        def lay(df: DataFrame) -> DataFrame:
            keys = [F.date_trunc("month", "timestamp"), F.col("symbol"), F.col("timestamp")]
            spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
            return spread.sortWithinPartitions(*keys, "ingest_seq")

        late = self.chunked_corrections()
        tables = {"base": self.chunked_base()} | ({} if late is None else {"corrections": self._named(late)})
        written = {}
        for name, df in tables.items():
            lay(df).write.mode("overwrite").parquet(f"{path}/{name}")
            written[name] = self.spark.read.parquet(f"{path}/{name}")
        if self.set_apart is not None and not self.set_apart.isEmpty():
            self.set_apart.write.mode("overwrite").parquet(f"{path}/set_apart")
        # Names are hashes; should two chunks meet in one, all are named anew with another salt.
        salt = 0
        while True:
            parts = [
                zonemap.build(df.withColumn("file", F.col("_metadata.file_name")), "chunk_start", "file", salt=salt).withColumn("table", F.lit(name)) for name, df in written.items()
            ]
            zones = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            zones.repartitionByRange("symbol", "time_start").sortWithinPartitions("symbol", "time_start").write.mode("overwrite").parquet(f"{path}/zones")
            zones = self.spark.read.parquet(f"{path}/zones")
            met = zones.where(F.col("table") == "base").groupBy("chunk_id").agg(F.min(F.struct("symbol", "chunk_start")).alias("a"), F.max(F.struct("symbol", "chunk_start")).alias("z")).where("a != z")
            if met.isEmpty():
                break
            salt += 1
        for name in written:
            fileindex.bounds(zones.where(F.col("table") == name)).coalesce(1).write.mode("overwrite").parquet(f"{path}/files/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, **options) -> BarStore:
        """A written store, with the corrections a stream has added to it since (``streaming.corrections``)."""

        def there(name: str) -> bool:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)

        late = spark.read.parquet(f"{path}/corrections") if there("corrections") else None
        streamed = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/late") if there("late") else None
        if streamed is not None and late is not None:
            late = late.drop("chunk_id", "chunk_start")
        store = cls(spark.read.parquet(f"{path}/base"), late if streamed is None else streamed if late is None else late.unionByName(streamed.select(*late.columns)), **options)
        if there("set_apart"):
            store.set_apart = spark.read.parquet(f"{path}/set_apart")
        if late is not None and streamed is None:
            store._corrections = late
        if streamed is None:
            store.path = path
        for name in ["base"] + ["corrections"] * (late is not None and streamed is None):
            index = FileIndex.load(spark, f"{path}/files/{name}", f"{path}/{name}") if there(f"files/{name}") else None
            if index is not None:
                store._files[name] = index
        return store
