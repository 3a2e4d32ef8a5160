import random
from datetime import timedelta

import numpy as np

from barlake.streaming import periods
from barlake.streaming.periods import period_stream
from tests.test_late_events import DAY, NAN, SCHEMA, brute, chunk


class Kept:
    """A map state that counts its calls."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.data.get(key)

    def exists(self):
        self.calls += 1
        return bool(self.data)

    def updateValue(self, key, value):
        self.calls += 1
        self.data[key] = value

    def removeKey(self, key):
        del self.data[key]


def test_a_quarter_of_small_periods_takes_few_calls_and_a_large_one_is_kept_by_day():
    record = lambda day, k, txn, v: (day * periods._DAY_US + k, txn, False, 1, k, v)
    rows = lambda *r: np.array(list(r), periods._RECORD)
    p = periods.PeriodProcessor(None, small=60)
    p.periods = Kept()
    assert len(p._update(list(range(28)), rows(*[record(d, 1, 1, 5.0) for d in range(28)]))) == 28
    assert p.periods.calls <= 3 and list(p.periods.data) == [periods.WHOLE]
    got = p._update([3], rows(*[record(3, k, 2, float(k)) for k in range(50)]))
    assert sorted(k[0] for k in p.periods.data) == list(range(28)) and len(got) == 50
    assert periods._aggregates(got) == [(3, 50, 50, 1225.0, 24.5, 50, 0.0, 49.0)]
    again = p._update([3, 4], rows(record(3, 0, 1, 99.0), record(4, 1, 3, NAN)))
    assert periods._aggregates(again) == [(3, 50, 50, 1225.0, 24.5, 50, 0.0, 49.0), (4, 1, 0, 0.0, None, 0, None, None)]


def test_stream_equals_brute_force_over_batches(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(60):
        corr = i > 20
        ts = [r.choice([None] * (r.random() < 0.05) + [DAY + timedelta(days=r.randint(0, 30), hours=r.randint(0, 2))]) for _ in range(r.randint(0, 9))]
        txn = [None if r.random() < 0.05 else (t or DAY) + timedelta(days=r.choice([0, 1, 2, 6, 7, 9]), hours=r.randint(0, 3)) for t in ts]
        rows.append(chunk(i, r.choice(["A", "B", None]), ts, txn, [r.choice([None, NAN, 0.0, 5.0, 7.0, 8.5]) for _ in ts], corr))
    for part in (rows[:30], rows[30:45], rows[45:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = period_stream(spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, k: out.extend(b.where("status = 'period'").collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {(x.symbol, x.day): tuple(x)[3:] for x in out}
    assert last == brute(rows)
