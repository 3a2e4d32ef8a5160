"""Timestamps of mixed form, precision and zone as one UTC instant.

Every stamp is read under every form it fits; each reading is an instant with
the label of the form (order of day and month, unit of a bare number, side of a
repeated hour). Forms are mixed in a source in proportions that are not known:
expectation-maximisation learns them per source, and with them the scale of the
delay before the reliable ``received_at``. A reading's likelihood is the source's
share of its form times the exponential density of its delay, which is never
negative; posteriors choose.

The scale never exceeds ``DELAY_S`` and shares are kept above ``LEAST``, so of
readings that lie further apart than DELAY_S * -ln(LEAST) (under 14 minutes) the
latest one not after receipt wins, as the statement of the problem asks; closer
readings differ by their form's share. Where the receipt is not known nothing but
the shares is left: the reading they favour is taken if its posterior reaches
``SURE``, else the stamp is left without instant. ``ambiguous`` marks every stamp
whose best posterior is below ``SURE``.

The rounds run on counts: stamps of one source with the same forms at the same
distances are one pattern, of which a source has a bounded number.

Defined cases: null, empty and unusable stamps, dates without time, times
without date and wall times that their zone skips have no reading and come back
with a null instant; white space around a stamp is ignored; repeated rows are
judged alike, ids must be unique; an empty table gives an empty result.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cache
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.session import cut_lineage

DELAY_S, LEAST, SURE, ROUNDS = 60.0, 1e-6, 0.9, 12
#: Distances between readings are counted in steps of so many seconds, up to so many steps; beyond, no share could make up for them.
STEP_S, STEPS = 10.0, 240
#: Mean logarithm of an exponential delay of scale 1, with the sign turned.
EULER = 0.5772156649015329
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
ZONE = r"(?:\s*(Z|z|[+-]\d{2}:?\d{2}|[A-Z][A-Za-z]{1,5})|\[([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\])?"
HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
#: (pattern, groups of year, month, day); hour, minute, second, fraction, half of the day and zone follow in each.
SHAPES = {
    "ymd": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T ]\s*{TIME}{HALF}{ZONE}$", (1, 2, 3)),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}}):?(\d{{2}}):?(?:(\d{{2}})(?:[.,](\d+))?)?{HALF}{ZONE}$", (1, 2, 3)),
    "dmy": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})[T ]\s*{TIME}{HALF}{ZONE}$", (3, 2, 1)),
    "mdy": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})[T ]\s*{TIME}{HALF}{ZONE}$", (3, 1, 2)),
    "day_name": (rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?,?[ -](\d{{4}})[T ,]\s*{TIME}{HALF}{ZONE}$", (3, 2, 1)),
    "name_day": (rf"^([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}),?[T ]\s*{TIME}{HALF}{ZONE}$", (3, 1, 2)),
}
UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": -1_000}
READING = "array<struct<form:string,us:bigint>>"


_java_zones: set[str] = set()


def _zones(spark: SparkSession) -> list[str]:
    """Zone names both sides know; Spark fails on any other."""
    if not _java_zones:
        _java_zones.update(str(spark._jvm.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds())).split(","))
    return sorted(set(available_timezones()) & _java_zones)


@cache
def _offsets(zone: str) -> dict[str, list[int]]:
    """Abbreviation -> offsets in seconds, read off the zone database at each quarter of 2000-2037."""
    tz, found = ZoneInfo(zone), {}
    for y in range(2000, 2038):
        for m in (1, 4, 7, 10):
            local = datetime(y, m, 1, tzinfo=timezone.utc).astimezone(tz)
            if local.tzname().isalpha():
                found.setdefault(local.tzname().upper(), set()).add(int(local.utcoffset().total_seconds()))
    return {k: sorted(v) for k, v in found.items()}


def abbreviations(spark: SparkSession) -> DataFrame:
    """(zone, abbreviation -> offsets in seconds); bounded by the zones."""
    return spark.createDataFrame([(zone, _offsets(zone)) for zone in _zones(spark)], "_zone string, _abbr map<string,array<int>>")


def _shift(us: Column, zone: Column) -> Column:
    """Wall clock in ``zone`` at an instant, both in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _in_zone(wall: Column, zone: Column) -> Column:
    """The instants at which ``zone`` shows ``wall``: none if it is skipped, two if it is repeated; the earlier first."""
    day = F.lit(86_400_000_000)
    guess = [wall - (_shift(wall + d, zone) - (wall + d)) for d in (-day, day)]
    valid = F.array(*[F.when(_shift(g, zone) == wall, g) for g in guess])
    return F.array_sort(F.array_distinct(F.array_compact(valid)))


def _labelled(form: Column, instants: Column) -> Column:
    """One instant keeps the form's label; the two of a repeated hour get a side."""
    one = F.size(instants) == 1
    return F.transform(instants, lambda us, i: F.struct(F.when(one, form).when(i == 0, F.concat(form, F.lit(":first"))).otherwise(F.concat(form, F.lit(":second"))).alias("form"), us.alias("us")))


def _offset_us(text: Column) -> Column:
    """Microseconds of a numeric offset such as +05:30 or -0400."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    size = (F.substring(digits, 1, 2).try_cast("long") * 3600 + F.substring(digits, 3, 2).try_cast("long") * 60) * 1_000_000
    return F.when(text.startswith("-"), -size).otherwise(size)


def _fitting(stamp: Column) -> Column:
    """The shapes a stamp fits: array of (form, g), g its year, month, day, hour, minute, second, fraction, half, zone and region as text."""
    fits = []
    for form, (pattern, ymd) in SHAPES.items():
        order = "|".join(f"${i}" for i in (*ymd, *range(4, 11)))
        fits.append(F.when(stamp.rlike(pattern), F.struct(F.lit(form).alias("form"), F.split(F.regexp_replace(stamp, pattern, order), r"\|", -1).alias("g"))))
    return F.array_compact(F.array(*fits))


def _numbers(x: Column) -> Column:
    g = lambda i: F.element_at(x.g, i + 1)
    num = lambda i: g(i).try_cast("int")
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(g(1), 1, 3))).cast("int")
    return F.struct(
        x.form.alias("form"), num(0).alias("y"), F.coalesce(num(1), named).alias("m"), num(2).alias("d"), num(3).alias("h"), num(4).alias("mi"),
        F.when(g(5) == "", 0).otherwise(num(5)).alias("s"), F.coalesce(F.rpad(F.substring(g(6), 1, 6), 6, "0").try_cast("long"), F.lit(0)).alias("us"),
        F.upper(g(7)).alias("half"), g(8).alias("zone"), g(9).alias("region"),
    )


def _walled(x: Column) -> Column:
    """Wall time in microseconds, null if there is no such date or time of day."""
    leap = ((x.y % 4 == 0) & (x.y % 100 != 0)) | (x.y % 400 == 0)
    longest = F.when(x.m.isin(4, 6, 9, 11), 30).when(x.m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    hour = F.when(x.half == "", F.when(x.h <= 23, x.h)).when(x.h.between(1, 12), F.pmod(x.h, F.lit(12)) + F.when(x.half == "P", 12).otherwise(0))
    fits = (x.y >= 1) & x.m.between(1, 12) & x.d.between(1, longest) & x.mi.between(0, 59) & x.s.between(0, 59)
    date = F.unix_date(F.make_date(F.when(fits, x.y), F.when(fits, x.m), F.when(fits, x.d))).cast("long")
    wall = (((date * 24 + hour) * 60 + x.mi) * 60 + x.s) * 1_000_000 + x.us
    return F.struct(x.form.alias("form"), wall.alias("wall"), x.zone.alias("zone"), x.region.alias("region"))


def _bare(stamp: Column) -> Column:
    """A bare number as time since 1970 in s, ms, us or ns; finer digits than microseconds are cut off."""
    whole, part = F.regexp_extract(stamp, r"^(\d{9,19})(?:\.(\d+))?$", 1), F.regexp_extract(stamp, r"^(\d{9,19})(?:\.(\d+))?$", 2)
    n = whole.try_cast("decimal(38,0)")
    out = []
    for unit, scale in UNITS.items():
        if scale > 0:
            digits = len(str(scale)) - 1
            fine = F.coalesce(F.rpad(F.substring(part, 1, digits), digits, "0").try_cast("long"), F.lit(0)) if digits else F.lit(0)
            us = n * scale + fine
        else:
            us = (n - n % -scale) / -scale
        out.append(F.struct(F.lit(f"epoch_{unit}").alias("form"), F.when(us < 253_402_300_800_000_000, us).try_cast("long").alias("us")))
    return F.when(whole != "", F.array(*out)).otherwise(F.array().cast(READING))


def readings(stamps: DataFrame) -> DataFrame:
    """``stamps`` with ``_c``, the list of (form, us) of every valid reading."""
    spark = stamps.sparkSession
    zones = _zones(spark)
    abbr = F.broadcast(abbreviations(spark))
    listed = ", ".join(f"'{z}'" for z in zones)
    venue = F.when(F.expr(f"venue_zone IN ({listed})"), F.col("venue_zone")).when(F.col("venue_zone").isNull(), "UTC")
    every_zone = F.expr(f"array({listed})")
    df = stamps.withColumns({"_t": F.regexp_replace("raw_timestamp", r"^\s+|\s+$", ""), "_zone": venue}).join(abbr, "_zone", "left")
    none = F.array().cast("array<bigint>")
    home = F.coalesce("_zone", F.lit("UTC"))

    def instants(x: Column) -> Column:
        named = F.coalesce(F.element_at("_abbr", F.upper(x.zone)), F.when(F.upper(x.zone).isin("UTC", "GMT"), F.array(F.lit(0))), F.array().cast("array<int>"))
        at = (
            F.when(x.region != "", F.when(F.array_contains(every_zone, x.region), _in_zone(x.wall, F.when(F.array_contains(every_zone, x.region), x.region).otherwise("UTC"))).otherwise(none))
            .when(F.upper(x.zone) == "Z", F.array(x.wall))
            .when(x.zone.rlike("^[+-]"), F.array(x.wall - _offset_us(x.zone)))
            .when(x.zone != "", F.array_sort(F.array_distinct(F.transform(named, lambda o: x.wall - o.cast("long") * 1_000_000))))
            .when(F.col("_zone").isNull(), none)
            .otherwise(_in_zone(x.wall, home))
        )
        return F.struct(x.form.alias("form"), at.alias("at"))

    walls = F.filter(F.transform(F.transform(_fitting(F.col("_t")), _numbers), _walled), lambda x: x.wall.isNotNull())
    dated = F.flatten(F.transform(F.transform(walls, instants), lambda x: _labelled(x.form, x.at)))
    every = F.concat(dated.cast(READING), F.filter(_bare(F.col("_t")), lambda c: c.us.isNotNull()).cast(READING))
    return df.withColumn("_c", F.coalesce(every, F.array().cast(READING))).drop("_t", "_zone", "_abbr")


def mixture(forms: list[list[str]], steps: list[list[int]], n: np.ndarray, log_delay: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Posteriors of the readings of each of one source's patterns.

    ``forms`` and ``steps`` give a pattern's readings, ``n`` how many stamps show
    it, ``log_delay`` their summed logarithm of the delay of the latest reading
    (NaN where the receipt is unknown).
    """
    labels = {f: i for i, f in enumerate(sorted({f for p in forms for f in p}))}
    size = np.array([len(p) for p in forms])
    of = np.repeat(np.arange(len(forms)), size)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    form = np.array([labels[f] for p in forms for f in p])
    away = np.array([d for p in steps for d in p], dtype=float) * STEP_S
    known = ~np.isnan(log_delay)
    weight = 1.0 / size[of]
    for _ in range(rounds + 1):
        share = np.bincount(form, weights=weight * n[of], minlength=len(labels))
        share = np.maximum(share / share.sum(), LEAST)
        scale = DELAY_S
        if known.any():
            # Mean logarithms, as a few deliveries that come days late would carry a plain mean away.
            delay = np.exp(log_delay[known] / n[known])
            logs = np.log(delay[np.cumsum(known)[of[known[of]]] - 1] + away[known[of]])
            w = (weight * n[of])[known[of]]
            scale = float(np.clip(np.exp((w * logs).sum() / w.sum() + EULER), 1.0, DELAY_S))
        ll = np.log(share[form]) - away / scale
        p = np.exp(ll - np.maximum.reduceat(ll, at)[of])
        weight = p / np.add.reduceat(p, at)[of]
    return np.split(weight, at[1:])


def _judge_rounds(rounds: int):
    def run(table: pa.Table) -> pa.Table:
        logs = np.array([np.nan if x is None else x for x in table["log_delay"].to_pylist()], dtype=float)
        found = mixture(table["forms"].to_pylist(), table["steps"].to_pylist(), table["n"].to_numpy().astype(float), logs, rounds)
        best = [int(np.argmax(p)) for p in found]
        out = table.select(["source", "forms", "steps", "known"]).append_column("best", pa.array(best, pa.int32()))
        return out.append_column("posterior", pa.array([float(p[i]) for p, i in zip(found, best)], pa.float64()))

    return run


def normalise(stamps: DataFrame, source: str = "symbol", rounds: int = ROUNDS) -> DataFrame:
    """(stamp_id, utc_us, form, posterior, ambiguous, n_readings); utc_us is null where no reading is valid or none is sure.

    One pass reads the stamps; patterns are counted before their shuffle by
    source, all rounds run on a source's patterns at once, and stamps with several
    readings take their pattern's posterior by an equi-join.
    """
    got = F.unix_micros(F.col("received_at").cast("timestamp"))
    df = readings(stamps.select("stamp_id", F.col(source).alias("source"), "venue_zone", "raw_timestamp", "received_at"))
    in_time = F.when(got.isNull(), F.col("_c")).otherwise(F.filter("_c", lambda c: c.us <= got))
    # Forms that agree on the instant are one reading, under the first form's label; the latest comes first.
    once = F.filter(in_time, lambda c, i: F.array_position(F.transform(in_time, lambda x: x.us), c.us) == i + 1)
    late_first = F.reverse(F.array_sort(F.transform(once, lambda c: F.struct(c.us.alias("us"), c.form.alias("form")))))
    df = df.select("stamp_id", "source", F.size("_c").alias("n_readings"), got.alias("_got"), late_first.alias("c"))
    latest = F.get("c", F.lit(0)).us
    away = F.transform("c", lambda c: F.when(F.col("_got").isNull(), 0).otherwise(F.least(F.round((latest - c.us) / (1e6 * STEP_S)), F.lit(STEPS))).cast("int"))
    df = df.select(
        "stamp_id", "source", "n_readings", F.transform("c", lambda c: c.us).alias("us"), F.transform("c", lambda c: c.form).alias("forms"), away.alias("steps"),
        F.when(F.col("_got").isNotNull(), F.log(F.greatest((F.col("_got") - latest) / 1e6, F.lit(0.5)))).alias("log_delay"),
    )
    df = cut_lineage(df)
    # Stamps without receipt are patterns of their own: nothing but shares can part their readings.
    df = df.withColumn("known", F.col("log_delay").isNotNull())
    counted = df.where(F.size("forms") > 0).groupBy("source", "forms", "steps", "known").agg(F.count(F.lit(1)).alias("n"), F.sum("log_delay").alias("log_delay"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"source {kinds['source']}, forms array<string>, steps array<int>, known boolean, best int, posterior double"
    judged = counted.groupBy("source").applyInArrow(_judge_rounds(rounds), schema).select(*[F.col(c).alias(f"_{c}") for c in ("source", "forms", "steps", "known", "best", "posterior")])
    several = df.where(F.size("us") > 1)
    same = several["source"].eqNullSafe(F.col("_source")) & (several["forms"] == F.col("_forms")) & (several["steps"] == F.col("_steps")) & (several["known"] == F.col("_known"))
    settled = several.join(judged, same).withColumn("_taken", F.col("known") | (F.col("_posterior") >= SURE))
    settled = settled.select(
        "stamp_id", F.when(F.col("_taken"), F.get("us", F.col("_best"))).alias("utc_us"), F.when(F.col("_taken"), F.get("forms", F.col("_best"))).alias("form"), F.col("_posterior").alias("posterior"), "n_readings"
    )
    first = F.lit(0)
    rest = df.where(F.size("us") <= 1).select("stamp_id", F.get("us", first).alias("utc_us"), F.get("forms", first).alias("form"), F.when(F.size("us") == 1, 1.0).alias("posterior"), "n_readings")
    return settled.unionByName(rest).withColumn("ambiguous", F.coalesce(F.col("posterior") < SURE, F.lit(False)))


def instants(stamps: DataFrame) -> DataFrame:
    return normalise(stamps).where(F.col("utc_us").isNotNull()).select("stamp_id", "utc_us")
