"""Rows that fail to parse, set apart with the reason while the valid ones load.

A strict load keeps exactly the lines that conform; an anti-join on the record
offset (and the line, should offsets repeat) subtracts them from the raw lines; only that remainder is diagnosed. No
line is lost or counted twice: loaded and remainder partition the input.

Quotes are checked without a regular expression over the whole line, which could
overflow the stack on long lines: the line is split at its quotes, and the parts
outside quotes must join at commas.

Defined cases: a null line is one empty line and fails on its column count; lines
with a null or repeated id are judged each by itself; header lines are rows; an
empty symbols table makes every otherwise sound line fail on its symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("timestamp", "symbol", "open", "high", "low", "close", "volume")
#: Stands for a comma inside quotes while a line is split; not a character of any text, and lines that hold it are handled by HELD.
COMMA, HELD = "￿", "￾"
STAMP = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])([T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?$"
VOLUME = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: A symbols table of at most so many rows is shipped to every task; beyond, it is joined by key.
SHIP_ROWS = 200_000


def _parts(line: Column) -> Column:
    """The line cut at its quotes: even places lie outside quotes, odd ones inside."""
    return F.split(F.translate(line, COMMA, HELD), '"', -1)


def _quoting_holds(parts: Column) -> Column:
    n = F.size(parts)
    outside = F.filter(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), lambda _, i: i % 2 == 1)
    joins = lambda p: (p == "") | (p.startswith(",") & p.endswith(","))
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    return (n % 2 == 1) & ((n == 1) | (((first == "") | first.endswith(",")) & ((last == "") | last.startswith(",")) & F.forall(outside, joins)))


def _fields(parts: Column) -> Column:
    """Field values without white space around them; doubled quotes become one."""
    n = F.size(parts)
    between = F.transform(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", COMMA)).when(p == "", F.lit('"')).otherwise(p))
    shown = F.when(n > 1, F.concat(F.slice(parts, 1, 1), between, F.slice(parts, -1, 1))).otherwise(parts)
    cut = F.split(F.array_join(shown, ""), ",", -1)
    return F.transform(cut, lambda v: F.regexp_replace(F.translate(v, COMMA, ","), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def _is_stamp(v: Column) -> Column:
    """An existing ISO 8601 date from year 1 on, alone or with a time of day."""
    days = F.when(F.substring(v, 6, 2).isin("04", "06", "09", "11"), 30).when(F.substring(v, 6, 2) == "02", F.when(_leap(v), 29).otherwise(28)).otherwise(31)
    return v.rlike(STAMP) & (F.substring(v, 1, 4) != "0000") & (F.substring(v, 9, 2) <= days.cast("string"))


def _leap(v: Column) -> Column:
    y = F.substring(v, 1, 4).try_cast("int")
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _is_volume(v: Column) -> Column:
    """Empty, NaN, or a plain ASCII decimal number of at least 0 (a negative zero is 0)."""
    digits = F.regexp_replace(F.regexp_replace(v, "[eE].*$", ""), "[^1-9]", "")
    return (v == "") | (v == "NaN") | (v.rlike(VOLUME) & (~v.startswith("-") | (digits == "")))


def _read(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    parts = _parts(F.coalesce("line", F.lit("")))
    read = lines.select("line_id", "line").withColumn("_p", parts).withColumns({"_q": _quoting_holds(F.col("_p")), "_f": _fields(F.col("_p"))})
    known = symbols.where(F.col("symbol").isNotNull()).select(F.col("symbol").alias("_known")).distinct()
    if known.limit(SHIP_ROWS + 1).count() <= SHIP_ROWS:
        known = F.broadcast(known)
    return read.withColumn("_s", F.get("_f", F.lit(1))).join(known, F.col("_s") == F.col("_known"), "left")


def _rules() -> list[tuple[str, Column]]:
    f = lambda i: F.coalesce(F.get("_f", F.lit(i)), F.lit(""))
    return [
        ("quoting", F.col("_q")),
        ("column_count", F.size("_f") == len(FIELDS)),
        ("timestamp", _is_stamp(f(0))),
        ("symbol", F.col("_known").isNotNull()),
        ("volume", _is_volume(f(6))),
    ]


def strict_load(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The conforming lines as bars with their record offset ``line_id``; other columns of ``lines`` are left out.

    Times without offset are UTC. Prices that are no number load as null.
    """
    return _as_bars(_sound(lines, symbols))


def _sound(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    sound = _read(lines, symbols)
    for _, holds in _rules():
        sound = sound.where(holds)
    return sound


def _as_bars(sound: DataFrame) -> DataFrame:
    number = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    return sound.select(
        "line_id", F.expr("try_to_timestamp(replace(_f[0], ' ', 'T'))").cast("timestamp_ntz").alias("timestamp"), F.col("_s").alias("symbol"),
        *[number(i).alias(FIELDS[i]) for i in range(2, 7)],
    )


def bad_lines(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(line_id, reason): what the strict load left over, each with the first reason that applies."""
    loaded = _sound(lines, symbols).select(F.col("line_id").alias("_id"), F.col("line").alias("_line"))
    same = F.col("line_id").eqNullSafe(F.col("_id")) & F.col("line").eqNullSafe(F.col("_line"))
    rest = _read(lines.select("line_id", "line").join(loaded, same, "left_anti"), symbols)
    reason = F.when(F.lit(False), "")
    for name, holds in _rules():
        reason = reason.when(~holds, name)
    return rest.select("line_id", reason.alias("reason"))
