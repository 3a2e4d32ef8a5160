import re
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barlake.operators.bad_rows import bad_lines, strict_load

LINES = "line_id long, file_name string, line_no int, line string, _p string, reason string"
SYMBOLS = ["AB1", "C,D", "E.F-G", 'Q"T']
GOOD = "2024-01-05T10:00:00Z,AB1,1,2,0.5,1.5,100"


def split(line):
    """A strict reader, one character at a time; None if quoting is broken."""
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            out, i = "", i + 1
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if i + 1 < len(line) and line[i + 1] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = i
            while j < len(line) and line[j] != ",":
                if line[j] == '"':
                    return None
                j += 1
            out, i = line[i:j], j
        fields.append(out.strip(" \t\r\n"))
        if i >= len(line):
            return fields
        i += 1


def brute(line):
    f = split(line or "")
    if f is None:
        return "quoting"
    if len(f) != 7:
        return "column_count"
    m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?(?:Z|[+-]([0-9]{2}):([0-9]{2}))?)?", f[0])
    try:
        date(*map(int, m.groups()[:3]))
        ok = all(int(x or 0) <= top for x, top in zip(m.groups()[3:], (23, 59, 59, 23, 59)))
    except (AttributeError, ValueError):
        ok = False
    if not ok:
        return "timestamp"
    if f[1] not in SYMBOLS:
        return "symbol"
    if f[6] in ("", "NaN"):
        return None
    return None if re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", f[6], re.ASCII) and float(f[6]) >= 0 else "volume"


def check(spark, texts):
    df = spark.createDataFrame([(i, "f", i, t, "x", "y") for i, t in enumerate(texts)], LINES)
    symbols = spark.createDataFrame([(s, 1) for s in [*SYMBOLS, None]], "symbol string, line_id int")
    got = {r.line_id: r.reason for r in bad_lines(df, symbols).collect()}
    loaded = {r.line_id for r in strict_load(df, symbols).collect()}
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w}
    assert loaded == {i for i, w in want.items() if not w}


STAMPS = ["2024-02-29", "2023-02-29", "2024-13-01", "2024-04-31 10:00:00", "2024-01-05 24:00:00", "2024-01-05T10:00", "2024-01-05T10:00:00.123456789+14:00", "2024-01-05T10:00:00+24:00", "2024-01-05t10:00:00", "2024-01-05  10:00:00", "0000-01-01", "0001-01-01", "２024-01-05", "2024-1-5", "20240105", "", "1900-02-29", "2000-02-29", "2024-01-05Z"]
VOLUMES = ["", "NaN", "nan", "0", "-0", "-0.0e5", "+5", "5.", ".5", ".", "1e5", "1e", "1E-3", "-1", "inf", "1_000", "１２", "0x1F", "5d", "5f", "1.2.3", " 7 ", "1 2", "--", "1e400"]
QUOTES = ['"2024-01-05","AB1","1","2","0.5","1.5","100"', '2024-01-05,"C,D",1,2,0.5,1.5,100', '2024-01-05,"Q""T",1,2,0.5,1.5,100', '2024-01-05,Q"T,1,2,0.5,1.5,100', '2024-01-05,"AB1"x,1,2,0.5,1.5,100', '2024-01-05, "AB1",1,2,0.5,1.5,100', '2024-01-05,"AB1" ,1,2,0.5,1.5,100', '2024-01-05,"AB1,1,2,0.5,1.5,100', '2024-01-05,"AB1\\",1,2,0.5,1.5,100', '2024-01-05,"AB1\n",1,2,0.5,1.5,100\r', '2024-01-05,"",1,2,0.5,1.5,""', '"', '""', '"""', '""""', ",,,,,,", '"",' * 6 + '""', '2024-01-05," \tAB1 ",,,,,""']


def test_cases(spark):
    texts = [f"{s},AB1,1,2,0.5,1.5,100" for s in STAMPS] + [f"2024-01-05,AB1,1,2,0.5,1.5,{v}" for v in VOLUMES] + QUOTES
    texts += [GOOD, "timestamp,symbol,open,high,low,close,volume", "", None, "# end", GOOD + ",1", GOOD.rsplit(",", 1)[0], GOOD.replace("AB1", "ab1"), GOOD.replace("AB1", "​AB1"), GOOD.replace("AB1", " AB1"), GOOD.replace(",1,2", ",,x"), "￿,￾"]
    check(spark, texts)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='",a \\\r1', max_size=14), min_size=20, max_size=60))
def test_any_quoting(spark, texts):
    check(spark, texts + [f'2024-01-05,"{t}",1,1,1,1,1' for t in texts])


@pytest.mark.parametrize("line", ['"' * 300_000, ",".join(['"a""b"'] * 60_000), '"' + "x" * 500_000 + '",' + GOOD, "," * 200_000])
def test_very_long_lines(spark, line):
    check(spark, [line, GOOD])


def test_loaded_values(spark):
    df = spark.createDataFrame([(1, "f", 1, '2024-01-05 10:00:00.25+05:30,"C,D",1,,x,1e2, 7 ', None, None), (2, "f", 2, "2024-01-05,AB1,1,2,3,4,NaN", None, None)], LINES)
    a, b = strict_load(df, spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")).orderBy("line_id").collect()
    assert tuple(a) == (1, datetime(2024, 1, 5, 4, 30, 0, 250000), "C,D", 1.0, None, None, 100.0, 7.0)
    assert b.timestamp == datetime(2024, 1, 5) and b.volume != b.volume


def test_null_and_repeated_ids_and_empty_tables(spark):
    symbols = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    df = spark.createDataFrame([(None, "f", 1, GOOD, None, None), (None, "f", 1, "x", None, None), (7, "f", 1, GOOD, None, None), (7, "f", 1, "y", None, None)], LINES)
    assert sorted((r.line_id or 0, r.reason) for r in bad_lines(df, symbols).collect()) == [(0, "column_count"), (7, "column_count")]
    assert strict_load(df, symbols).count() == 2
    assert bad_lines(df.limit(0), symbols).count() == 0
    assert {r.reason for r in bad_lines(df, symbols.limit(0)).collect()} == {"symbol", "column_count"}
