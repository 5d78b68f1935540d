"""First passage by block extremes beside a walk over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import passage
from barloom.operators import labels as L
from barloom.operators import signals as G

SCHEMA = "series_id string, contract_id string, n long, high double, low double, close double, session int, bid double"


@pytest.fixture(scope="module")
def path(spark):
    rng = random.Random(11)
    rows = []
    for key, number in (("a", 700), ("b", 65), ("c", 1), (None, 130)):
        price = 100.0
        for n in range(number):
            price += rng.choice([-1.0, 0.0, 1.0])
            none = rng.random() < 0.02
            rows.append((key, "x", n, None if none else price + rng.randrange(2), None if none else price - rng.randrange(2), price, n // 37, price - 0.25 if n % 3 else None))
    d = spark.createDataFrame(rows, SCHEMA).withColumn("event_ts", F.timestamp_seconds(F.col("n") * 60)).withColumn("available_ts", F.timestamp_seconds(F.col("n") * 60 + 1))
    return d.repartition(5).cache()


def by_series(path):
    found = {}
    for r in path.orderBy("n").collect():
        found.setdefault(r.series_id, []).append(r)
    return found


@pytest.mark.parametrize(("bits", "reach", "segment"), [(6, 5, None), (6, 64, None), (6, 300, None), (6, 5000, None), (2, 3, None), (2, 17, "session"), (2, 100, None), (2, 300, "session"), (1, 40, None), (6, 10_000, "session")])
def test_first_passage_equals_a_walk(path, monkeypatch, bits, reach, segment):
    monkeypatch.setattr(passage, "BITS", bits)
    monkeypatch.setattr(passage, "FAN", 1 << bits)
    d = path.withColumn("up", F.when(F.col("n") % 5 != 0, F.col("close") + 1 + F.col("n") % 9)).withColumn("down", F.when(F.col("n") % 7 != 0, F.col("close") - 1 - F.col("n") % 11))
    got = passage.first_passage(d, ["series_id"], ["event_ts"], reach, F.col("up"), F.col("down"), ["event_ts"], segment)
    found = {(r.series_id, r.n): r for r in got.collect()}
    assert len(found) == path.count()
    for key, rows in by_series(d).items():
        for at, r in enumerate(rows):
            end = min(at + reach, len(rows) - 1)
            if segment:
                end = min(end, max(k for k, x in enumerate(rows) if x[segment] == r[segment]))
            hit = next((k for k in range(at + 1, end + 1) if rows[k].high is not None and (r.up is not None and rows[k].high >= r.up or r.down is not None and rows[k].low <= r.down)), None)
            x = found[key, r.n]
            assert (x.place, x.last_place, x.end_place) == (at, len(rows) - 1, end)
            assert (x.hit and (x.hit.steps, x.hit.event_ts, x.hit.high)) == (None if hit is None else (hit - at, rows[hit].event_ts, rows[hit].high)), (key, at)


def test_touches_held_in_the_row_and_found_by_descent_are_the_same(path):
    whole = path.filter("series_id is not null")
    up, down = L.level(high_at=F.col("close") + 2), L.level(low_at=F.col("close") - 3)
    cols = ["series_id", "n", "outcome", "steps", "resolution_ts", "label_available_ts", "resolution_close"]
    for policy in ("ambiguous", "first", "second"):
        a, b = (sorted(L.first_touch(whole, 20, up, down, policy, held=held).select(cols).collect(), key=str) for held in (64, 0))
        assert a == b


def test_exits_in_order_of_the_rules(path):
    rows = by_series(path.filter("series_id is not null"))
    for long in (True, False):
        sign = 1 if long else -1
        got = G.first_touch_exits(path.filter("series_id is not null"), 6, [F.col("close") - sign * 2.0, F.col("close") - sign * 5.0], 2.0, long, "session")
        found = {(r.series_id, r.n): r for r in got.collect()}
        for key, bars in rows.items():
            for at, r in enumerate(bars):
                stop, target, want = r.close - sign * 2.0, r.close + sign * 4.0, (None, None)
                last = max(k for k, x in enumerate(bars) if x.session == r.session)
                end = min(at + 6, last)
                for k in range(at + 1, end + 1):
                    x = bars[k]
                    if x.high is None:
                        continue
                    if x.low <= stop if long else x.high >= stop:
                        want = ("stop", stop)
                        break
                    if x.high >= target if long else x.low <= target:
                        want = ("target", target)
                        break
                else:
                    price = bars[end].bid if long and bars[end].bid is not None else bars[end].close
                    want = ("time", price) if at + 6 <= end else ("session_end", price) if end > at or end < len(bars) - 1 else (None, None)
                assert (found[key, r.n].exit, found[key, r.n].exit_price) == want, (key, at)
