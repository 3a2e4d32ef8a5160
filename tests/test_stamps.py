import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from barlake.operators.stamps import instants, normalise

SCHEMA = "stamp_id long, symbol string, venue_zone string, raw_timestamp string, received_at timestamp_ntz, close double, form string, source int"
UTC = timezone.utc


def us(*t, zone=UTC, fold=0, micro=0):
    d = datetime(*t, micro, tzinfo=zone, fold=fold) - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


NY, BERLIN, LONDON = (ZoneInfo(z) for z in ("America/New_York", "Europe/Berlin", "Europe/London"))
LATER = datetime(2024, 12, 31)
CASES = [
    ("2024-01-05 10:20:30", None, LATER, us(2024, 1, 5, 10, 20, 30)),
    ("  2024-01-05T10:20:30.123456789\t", "Europe/Berlin", LATER, us(2024, 1, 5, 9, 20, 30, micro=123456)),
    ("2024-01-05T10:20:30Z", "Asia/Tokyo", LATER, us(2024, 1, 5, 10, 20, 30)),
    ("2024-01-05T10:20:30.5+05:30", "Asia/Tokyo", LATER, us(2024, 1, 5, 4, 50, 30, micro=500000)),
    ("2024-01-05 10:20:30 -0400", None, LATER, us(2024, 1, 5, 14, 20, 30)),
    ("05 Jan 2024 10:20:30 +01:00", None, LATER, us(2024, 1, 5, 9, 20, 30)),
    ("Jan 5, 2024 1:29pm", "America/New_York", LATER, us(2024, 1, 5, 18, 29)),
    ("Jan 5, 2024 12:05am", None, LATER, us(2024, 1, 5, 0, 5)),
    ("20240105T102030", None, LATER, us(2024, 1, 5, 10, 20, 30)),
    ("20240105 10:20:30", None, LATER, us(2024, 1, 5, 10, 20, 30)),
    ("2024-07-05T10:20:30[Europe/London]", "Asia/Tokyo", LATER, us(2024, 7, 5, 9, 20, 30)),
    ("2024-07-05 10:20:30 BST", "Europe/London", LATER, us(2024, 7, 5, 9, 20, 30)),
    ("2024-07-05 10:20:30 IST", "Asia/Kolkata", LATER, us(2024, 7, 5, 4, 50, 30)),
    ("2024-07-05 10:20:30 GMT", None, LATER, us(2024, 7, 5, 10, 20, 30)),
    # Order of day and month: the latest reading not after it was received.
    ("03/04/2024 10:00:00", None, datetime(2024, 4, 3, 10, 1), us(2024, 4, 3, 10)),
    ("03/04/2024 10:00:00", None, datetime(2024, 4, 3, 9, 59), us(2024, 3, 4, 10)),
    ("25.12.2023 10:00:00", None, LATER, us(2023, 12, 25, 10)),
    ("12/25/2023 10:00:00 PM", None, LATER, us(2023, 12, 25, 22)),
    # A repeated hour.
    ("2024-11-03 01:30:00", "America/New_York", datetime(2024, 11, 3, 5, 31), us(2024, 11, 3, 1, 30, zone=NY, fold=0)),
    ("2024-11-03 01:30:00", "America/New_York", datetime(2024, 11, 3, 6, 30), us(2024, 11, 3, 1, 30, zone=NY, fold=1)),
    ("2024-11-03 01:30:00 EDT", "America/New_York", LATER, us(2024, 11, 3, 5, 30)),
    ("2024-10-27T02:30:00[Europe/Berlin]", None, LATER, us(2024, 10, 27, 2, 30, zone=BERLIN, fold=1)),
    # A skipped hour, and stamps that are no date and time.
    ("2024-03-31 02:30:00", "Europe/Berlin", LATER, None),
    ("2024-03-31 02:30:00", "Asia/Tokyo", LATER, us(2024, 3, 30, 17, 30)),
    ("2024-02-30 10:00:00", None, LATER, None),
    ("2023-02-29 10:00:00", None, LATER, None),
    ("2024-02-29 24:00:00", None, LATER, None),
    ("2024-11-03 00:61:00", None, LATER, None),
    ("2024-01-05", None, LATER, None),
    ("10:20:30", None, LATER, None),
    ("2024-01-05Tnoon", None, LATER, None),
    ("9999-99-99T99:99:99", None, LATER, None),
    ("2024-01-05T10:00:00[No/Where]", None, LATER, None),
    ("n/a", None, LATER, None),
    ("", None, LATER, None),
    (None, None, LATER, None),
    # Bare numbers.
    ("1685997288", "Europe/Berlin", LATER, 1685997288_000000),
    ("1688894915.644", None, LATER, 1688894915_644000),
    ("1673061098603", None, LATER, 1673061098603_000),
    ("1713267421000001", None, LATER, 1713267421000001),
    ("1686307951588000848", None, LATER, 1686307951588000),
]


def test_cases(spark):
    rows = [(i, "A", z, t, got, 1.0, "x", 1) for i, (t, z, got, _) in enumerate(CASES)]
    out = {r.stamp_id: r.utc_us for r in normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(CASES)
    for i, case in enumerate(CASES):
        assert out[i] == case[3], case


def test_latest_reading_wins_whatever_the_source_prefers(spark):
    """A source that writes one order nearly always does not outvote the rule; ambiguity is counted."""
    r = random.Random(1)
    rows, want = [], {}
    for i in range(400):
        t = datetime(2024, r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.randint(0, 59))
        form = "%m/%d/%Y %H:%M:%S" if i % 50 == 0 else "%d/%m/%Y %H:%M:%S"
        got = t + timedelta(seconds=r.randint(0, 100_000))
        text = t.strftime(form)
        both = []
        for f in ("%m/%d/%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S"):
            try:
                both.append(datetime.strptime(text, f))
            except ValueError:
                pass
        want[i] = us(*max(b for b in both if b <= got).timetuple()[:6])
        rows.append((i, None if i % 7 == 0 else "A", None, text, got, 1.0, "x", 1))
    out = normalise(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.stamp_id: x.utc_us for x in out} == want
    assert all(0.9 < x.posterior <= 1.0 and not x.ambiguous for x in out) and {x.n_readings for x in out} == {1, 2}


def test_missing_receipt_zone_and_tables(spark):
    rows = [(1, "A", None, "03/04/2024 10:00:00", None, 1.0, "x", 1), (2, "A", None, "2024-03-04 10:00:00", None, 1.0, "x", 1), (3, "A", "No/Where", "2024-03-04 10:00:00", LATER, 1.0, "x", 1), (None, None, None, "2024-03-04 10:00:00Z", LATER, None, None, None)]
    got = {r.stamp_id: r.utc_us for r in normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: None, 2: us(2024, 3, 4, 10), 3: None, None: us(2024, 3, 4, 10)}
    assert instants(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["2" * 50_000, "1 " * 20_000, "Jan " * 5000])
def test_long_texts(spark, text):
    assert instants(spark.createDataFrame([(1, "A", None, text, LATER, 1.0, "x", 1)], SCHEMA)).count() == 0


def test_shares_decide_where_the_receipt_is_unknown(spark):
    """Without receipt the source's learnt order decides; without rounds, or in a source of both orders, the stamp stays open."""
    rows, r = [], random.Random(3)
    for i in range(300):
        t = datetime(2024, r.randint(1, 12), r.randint(13, 28), 9, r.randint(0, 59))
        rows.append((i, "D", None, t.strftime("%d/%m/%Y %H:%M:%S"), t + timedelta(seconds=r.randint(1, 90)), 1.0, "x", 1))
        rows.append((1000 + i, "B", None, t.strftime("%d/%m/%Y %H:%M:%S" if i % 2 else "%m/%d/%Y %H:%M:%S"), t + timedelta(seconds=5), 1.0, "x", 1))
    asked = [(5000, "D", None, "03/04/2024 10:00:00", None, 1.0, "x", 1), (5001, "B", None, "03/04/2024 10:00:00", None, 1.0, "x", 1), (5002, None, None, "03/04/2024 10:00:00", None, 1.0, "x", 1)]
    df = spark.createDataFrame(rows + asked, SCHEMA)
    got = {x.stamp_id: x for x in normalise(df).where("stamp_id >= 5000").collect()}
    assert got[5000].utc_us == us(2024, 4, 3, 10) and not got[5000].ambiguous and got[5000].form == "dmy"
    for k in (5001, 5002):
        assert got[k].utc_us is None and got[k].ambiguous and 0.4 < got[k].posterior < 0.6
    even = {x.stamp_id: x for x in normalise(df.where("stamp_id >= 5000")).collect()}
    assert all(x.utc_us is None and x.ambiguous for x in even.values())


def test_mixture_learns_shares_and_delay():
    import numpy as np

    from barlake.operators.stamps import mixture

    # 90 certain "a", 10 certain "b", delays of 2 s; readings 10 s apart are decided by the scale, at no distance by the shares.
    forms, steps = [["a"], ["b"], ["b", "a"], ["b", "a"]], [[0], [0], [0, 1], [0, 0]]
    n = np.array([90.0, 10.0, 1.0, 1.0])
    quick = mixture(forms, steps, n, np.array([90 * np.log(2), 10 * np.log(2), np.log(2), np.nan]))
    assert quick[2][0] > 0.6 and quick[3][1] > 0.85
    slow = mixture(forms, steps, n, np.array([90 * np.log(60), 10 * np.log(60), np.log(60), np.nan]))
    assert slow[2][0] < 0.2
