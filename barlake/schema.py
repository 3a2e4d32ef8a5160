"""The bar schema, its aliases, and typed parsing of literals."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import types as T

VALUES = ("open", "high", "low", "close", "volume")
TYPES = {"timestamp": "datetime", "symbol": "string"} | dict.fromkeys(VALUES, "float")
ALIASES = {"date": "timestamp", "price": "close"}
#: Which zone-map entry a column's predicates can be tested on.
ZONES = {"symbol": "symbol", "timestamp": "time", "close": "price"}

BAR = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("symbol", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in VALUES])


def canonical(name: str) -> str:
    """The column a name stands for, whatever its case; ValueError if there is none."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in TYPES:
        raise ValueError(f"unknown column: {name!r}")
    return key


def moment(text: str) -> datetime:
    """An ISO 8601 date and time, or date alone, of a literal."""
    iso = text.strip()
    try:
        return datetime.fromisoformat(iso[:-1] + "+00:00" if iso[-1:] in ("z", "Z") else iso)
    except ValueError:
        raise ValueError(f"invalid datetime literal: {text!r}") from None


def number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"invalid floating-point literal: {text!r}") from None


#: How the text of a literal becomes a value, by the type of the column it stands beside.
READERS = {"datetime": moment, "float": number, "string": str}


def value_for(column: str, text: str) -> datetime | float | str:
    return READERS[TYPES[column]](text)


def whole_date(text: str) -> date | None:
    """The day, if the text is that day's date and no time."""
    try:
        day = moment(text).date()
    except ValueError:
        return None
    return day if day.isoformat() == text.strip() else None


def align(value: datetime, column_type: T.DataType) -> datetime:
    """Fit a literal to the data's kind of time.

    Against zoned data a literal without zone is UTC; against data without zone
    an offset is dropped, not converted.
    """
    if isinstance(column_type, T.TimestampNTZType):
        return value.replace(tzinfo=None)
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
