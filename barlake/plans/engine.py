"""Two engines over a store: the pruned one and the unpruned one it is held against."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame

from barlake.operators.store import BarStore
from barlake.plans.predicate import Predicate
from barlake.plans.sqlparse import parse
from barlake.plans.zonemap import Pushdown


@dataclass
class QueryResult:
    """A lazy frame; counts, times and what pruning does are taken when asked for."""

    data: DataFrame
    store: BarStore
    predicate: Predicate
    as_of: datetime | None
    prunes: bool
    elapsed_seconds: float | None = field(default=None)

    @cached_property
    def row_count(self) -> int:
        began = time.perf_counter()
        n = self.data.count()
        self.elapsed_seconds = time.perf_counter() - began
        return n

    @cached_property
    def pushdown(self) -> Pushdown | None:
        return self.store.pushdown(self.predicate, self.as_of) if self.prunes else None

    @property
    def files(self) -> tuple[int, int] | None:
        """How many of the base's files the plan opens, and how many there are; None where the store was not written."""
        picked = self.store.files(self.predicate, self.as_of) if self.prunes else None
        return None if picked is None else (len(picked), len(self.store._files["base"].names))

    @property
    def selectivity(self) -> float:
        """Share of the stored rows, superseded ones included."""
        stored = self.store.stats().first().total_rows
        return self.row_count / stored if stored else 0.0


class Engine:
    """Anti-join plan; value predicates reach the base scan. ``sort`` orders results by time and symbol."""

    prunes = True

    def __init__(self, store: BarStore, sort: bool = True):
        self.store, self.sort = store, sort

    def _state(self, as_of, predicate) -> DataFrame:
        return self.store.state(as_of, predicate)

    def execute(self, sql: str) -> QueryResult:
        predicate, as_of = parse(self.store.spark, sql)
        data = self._state(as_of, predicate)
        return QueryResult(data.orderBy("timestamp", "symbol") if self.sort else data, self.store, predicate, as_of, self.prunes)

    def describe(self, sql: str) -> str:
        """The parsed condition and the physical plan, for reading."""
        predicate, as_of = parse(self.store.spark, sql)
        plan = self._state(as_of, predicate)._jdf.queryExecution().explainString(self.store.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return f"AS OF {as_of or 'now'}: {predicate.describe()}\n{plan}"


class FullScanEngine(Engine):
    """Ranks all versions of all rows and filters last; prunes nothing."""

    prunes = False

    def _state(self, as_of, predicate) -> DataFrame:
        return self.store.state_by_window(as_of, predicate)
