"""Predicates as a small tree with lowerings onto rows, onto zone maps and onto bounds of files.

The row lowering gives an ordinary Column, so Catalyst pushes it into scans. The
zone lowering gives a Column over the zone map that is false only where no row
of the chunk can match; the same over arrays of bounds picks files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.schema import TYPES, ZONES, align

OPERATORS = ("=", "<", ">", "<=", ">=")


def literal(value: object, column_type: T.DataType | None) -> Column:
    """A typed literal; times become what the data hold (zoned or not)."""
    if isinstance(value, datetime):
        fitted = align(value, column_type or T.TimestampType())
        if fitted.tzinfo is None:
            return F.lit(fitted.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.timestamp_micros(F.lit(_micros(fitted)))
    return F.lit(value)


def _micros(t: datetime) -> int:
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _apply(op: str, left: Column, right: Column) -> Column:
    return {"=": left == right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]


def _may(op: str, low, high, value):
    """Whether something between the bounds can stand in the relation; for Columns and for arrays."""
    return {"=": (low <= value) & (high >= value), ">=": high >= value, ">": high > value, "<=": low <= value, "<": low < value}[op]


def instant_us(value: datetime, column_type: T.DataType | None) -> int:
    """A time literal, fitted to the data's kind of time, in microseconds."""
    fitted = align(value, column_type or T.TimestampType())
    return _micros(fitted if fitted.tzinfo else fitted.replace(tzinfo=timezone.utc))


def _bound(column: str) -> None:
    if column not in TYPES:
        raise ValueError(f"unknown column: {column!r}")


@dataclass(frozen=True)
class Comparison:
    column: str
    operator: str
    value: object

    def __post_init__(self) -> None:
        _bound(self.column)
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator: {self.operator!r}")

    def on_rows(self, types: dict[str, T.DataType]) -> Column:
        """NaN, in the data or as the literal, matches nothing."""
        if TYPES[self.column] != "float":
            return _apply(self.operator, F.col(self.column), literal(self.value, types.get(self.column)))
        if math.isnan(self.value):
            return F.lit(False)
        plain = _apply(self.operator, F.col(self.column), F.lit(self.value))
        # Only these can be true of NaN, which sorts above every number here.
        return plain & ~F.isnan(self.column) if self.operator in (">", ">=") else plain

    def on_zones(self, types: dict[str, T.DataType]) -> Column:
        zone = ZONES.get(self.column)
        if zone is None or (zone == "symbol" and self.operator != "="):
            return F.lit(True)
        if zone == "symbol":
            return F.col("symbol") == F.lit(self.value)
        if zone == "price" and math.isnan(self.value):
            return F.lit(False)
        low, high = (F.col("time_start"), F.col("time_end")) if zone == "time" else (F.col("min_price"), F.col("max_price"))
        return _may(self.operator, low, high, literal(self.value, types.get(self.column)))

    def on_bounds(self, low: dict, high: dict, types: dict[str, T.DataType]):
        """Over arrays of bounds per zone (symbols have bounds as well there)."""
        zone = ZONES.get(self.column)
        if zone is None:
            return True
        if zone == "price" and math.isnan(self.value):
            return False
        return _may(self.operator, low[zone], high[zone], instant_us(self.value, types.get(self.column)) if zone == "time" else self.value)

    def describe(self) -> str:
        return f"{self.column} {self.operator} {self.value!r}"


@dataclass(frozen=True)
class In:
    column: str
    values: tuple

    def __post_init__(self) -> None:
        _bound(self.column)

    def _usable(self) -> list:
        return [v for v in self.values if not (isinstance(v, float) and math.isnan(v))]

    def on_rows(self, types: dict[str, T.DataType]) -> Column:
        got = [literal(v, types.get(self.column)) for v in self._usable()]
        return F.col(self.column).isin(*got) if got else F.lit(False)

    def on_zones(self, types: dict[str, T.DataType]) -> Column:
        return reduce(or_, [Comparison(self.column, "=", v).on_zones(types) for v in self._usable()], F.lit(False))

    def on_bounds(self, low: dict, high: dict, types: dict[str, T.DataType]):
        return reduce(or_, [Comparison(self.column, "=", v).on_bounds(low, high, types) for v in self._usable()], False)

    def describe(self) -> str:
        return f"{self.column} IN ({', '.join(map(repr, self.values))})"


@dataclass(frozen=True)
class And:
    children: tuple

    def on_rows(self, types: dict[str, T.DataType]) -> Column:
        return reduce(and_, [c.on_rows(types) for c in self.children])

    def on_zones(self, types: dict[str, T.DataType]) -> Column:
        return reduce(and_, [c.on_zones(types) for c in self.children])

    def on_bounds(self, low: dict, high: dict, types: dict[str, T.DataType]):
        return reduce(and_, [c.on_bounds(low, high, types) for c in self.children])

    def describe(self) -> str:
        return " AND ".join(c.describe() for c in self.children)


@dataclass(frozen=True)
class AlwaysTrue:
    def on_rows(self, types: dict[str, T.DataType]) -> Column:
        return F.lit(True)

    def on_zones(self, types: dict[str, T.DataType]) -> Column:
        return F.lit(True)

    def on_bounds(self, low: dict, high: dict, types: dict[str, T.DataType]):
        return True

    def describe(self) -> str:
        return "TRUE"


Predicate = Comparison | In | And | AlwaysTrue


def conjunction(parts: Sequence[Predicate]) -> Predicate:
    """One flat tree for any nesting of ANDs."""
    flat = [c for p in parts for c in (p.children if isinstance(p, And) else (p,)) if not isinstance(c, AlwaysTrue)]
    return AlwaysTrue() if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def whole_day(column: str, day: date) -> Predicate:
    """A date alone, compared by =, means the whole day."""
    start = datetime.combine(day, time())
    return And((Comparison(column, ">=", start), Comparison(column, "<", start + timedelta(days=1))))


def conjuncts(p: Predicate) -> list[Predicate]:
    return list(p.children) if isinstance(p, And) else [] if isinstance(p, AlwaysTrue) else [p]


def on_key(p: Predicate) -> bool:
    """Whether a conjunct looks at the key (symbol, timestamp) only, so that it holds for all versions of a row or none."""
    return isinstance(p, (Comparison, In)) and p.column in ("symbol", "timestamp")
