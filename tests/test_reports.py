"""Quote placement, coverage, horizons, period states and value packs beside plain walks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import diagnostics as D
from barloom.operators import quality as Y
from barloom.operators import signals as G
from barloom.sources import tables as T

# --- quotes


def clock(text):
    return dt.datetime.fromisoformat(f"2024-03-01T10:{text}")


def test_quotes_are_placed_by_start_then_minute_then_the_minute_before(spark):
    bars = spark.createDataFrame([("a", clock("00:00")), ("a", clock("01:00")), ("a", clock("03:00")), ("a", clock("06:00")), ("a", clock("08:00")), ("b", clock("00:00"))], "series_id string, bar_start_ts timestamp")
    quotes = spark.createDataFrame(
        [
            ("a", clock("00:30"), None, 1.0, 2.0, 1.0, 1.0, 1),  # its own minute
            ("a", clock("00:20"), None, 5.0, 6.0, 1.0, 1.0, 2),  # later to arrive, though earlier in time
            ("a", clock("02:00"), None, 3.0, 4.0, 2.0, 2.0, 3),  # no bar at 02, so 01, whose end it is
            ("a", clock("04:10"), None, 3.0, 4.0, 2.0, 2.0, 4),  # falls back to 03, but lies after its end
            ("a", clock("06:59"), clock("06:00"), 7.0, 6.0, 1.0, 1.0, 5),  # crossed
            ("a", clock("08:05"), clock("07:00"), 7.0, 8.0, 1.0, 1.0, 6),  # names a minute without a bar, so 08 gets none
            ("b", clock("09:00"), clock("00:00"), 1.0, 2.0, 1.0, 1.0, 7),  # names a bar it is not in
            ("c", clock("00:01"), None, 1.0, 2.0, 1.0, 1.0, 8),
        ],
        "series_id string, event_ts timestamp, bar_start_ts timestamp, bid double, ask double, bid_size double, ask_size double, n int",
    )
    got = {(r.series_id, r.bar_start_ts): r for r in Y.canonical_quotes(quotes, bars, arrival=["n"]).collect()}
    assert len(got) == 6
    shown = {(k[0], k[1].minute): (r.bid, r.ask, r.mid, r.spread, r.event_ts, r.quality_flags) for k, r in got.items()}
    bad, none = ["missing_bbo", "bbo_quarantined"], ["missing_bbo"]
    assert shown == {
        ("a", 0): (1.0, 2.0, 1.5, 1.0, clock("00:30"), []), ("a", 1): (3.0, 4.0, 3.5, 1.0, clock("02:00"), []), ("a", 3): (0, 0, 0, 0, clock("04:00"), bad),
        ("a", 6): (0, 0, 0, 0, clock("07:00"), bad), ("a", 8): (0, 0, 0, 0, clock("09:00"), none), ("b", 0): (0, 0, 0, 0, clock("01:00"), bad),
    }
    assert all(r.available_ts == k[1] + dt.timedelta(seconds=61) for k, r in got.items())
    counts = {r.series_id: (r.duplicates, r.no_bar, r.missing_value, r.crossed, r.outside_bar, r.missing) for r in Y.quote_counts(quotes, bars, arrival=["n"]).collect()}
    assert counts == {"a": (1, 1, 0, 1, 1, 3), "b": (0, 0, 0, 0, 1, 1), "c": (0, 1, 0, 0, 0, 0)}
    less = quotes.drop("bar_start_ts").withColumn("ask_size", F.lit(None).cast("double"))
    assert all(r.quality_flags[0] == "missing_bbo" for r in Y.canonical_quotes(less, bars, arrival=["n"]).collect())


# --- coverage


def walked(intervals, rows, long_run, dense):
    """Slot by slot: sums for each key."""
    sessions = {}
    for key, session, start, end in intervals:
        own = rows.get((key, session), {})
        sessions.setdefault((key, session), set()).update(t for t in range(start, end) if t in own and own[t][0])
    out = {}
    for key, session, start, end in intervals:
        m = out.setdefault(key, dict.fromkeys(("expected", "observed", "traded", "synthetic", "unfilled", "no_trade", "long_runs", "long_run_bars", "gap", "non_trading_bars", "non_trading_intervals"), 0))
        own, of_session = rows.get((key, session), {}), sessions[key, session]
        if not of_session:
            m["non_trading_bars"] += end - start
            m["non_trading_intervals"] += 1
            continue
        seen = [t for t in range(start, end) if t in own]
        trades = [t for t in seen if own[t][0]]
        filled = [t for t in seen if own[t][1]]
        m["expected"] += end - start
        m["observed"] += len(seen)
        m["traded"] += len(trades)
        m["synthetic"] += len(filled)
        m["no_trade"] += len(filled)
        if not seen:
            m["unfilled"] += end - start
            continue
        first = min(trades or of_session)
        m["unfilled"] += max(first - start, 0)
        t = start
        while t < end:
            if t in seen:
                t += 1
                continue
            a = t
            while t < end and t not in seen:
                t += 1
            if t <= first:
                continue
            if trades and trades[0] < a and trades[-1] >= t and t - a > long_run:
                m["no_trade"] += t - a
                m["long_runs"] += 1
                m["long_run_bars"] += t - a
            elif dense:
                m["gap"] += t - a
            else:
                m["no_trade"] += t - a
    return out


@pytest.mark.parametrize("dense", [False, True])
def test_coverage_equals_a_walk_over_the_minutes(spark, dense):
    rng = random.Random(7)
    intervals, rows = [], {}
    for key in ("a", "b"):
        for session in range(40):
            start = session * 100
            intervals += [(key, str(session), start, start + rng.choice([1, 7, 30])), (key, str(session), start + 40, start + 40 + rng.choice([5, 50]))]
            share = rng.choice([0, 0.02, 0.2, 0.6])
            for t in range(start, start + 95):
                trade, fill = rng.random() < share, dense and rng.random() < 0.3
                if trade or fill:
                    rows.setdefault((key, str(session)), {})[t] = (trade, fill and not trade)
    for scale in (1, 60):
        iv = spark.createDataFrame([(k, s, a * scale, b * scale) for k, s, a, b in intervals], "k string, s string, start_t long, end_t long")
        listed = [(k, s, t * scale, *v) for (k, s), own in rows.items() for t, v in own.items()]
        got = Y.coverage(iv, spark.createDataFrame(listed + listed[:50], "k string, s string, t long, has_trade boolean, synthetic boolean").repartition(4), ["k"], ["s"], 3, scale, dense)
        want = walked(intervals, rows, 3, dense)
        for r in got.collect():
            assert {c: r[c] for c in want[r.k]} == want[r.k]
            assert abs(r.no_trade_ratio - want[r.k]["no_trade"] / want[r.k]["expected"]) < 1e-12


def test_coverage_without_rows_or_trades(spark):
    iv = spark.createDataFrame([("a", "1", 0, 600), ("a", "1", 900, 1000)], "k string, s string, start_t long, end_t long")
    none = spark.createDataFrame([], "k string, s string, t long")
    r = Y.coverage(iv, none, ["k"], ["s"], 1, 60).first()
    assert (r.expected, r.non_trading_bars, r.non_trading_intervals, r.no_trade_ratio) == (0, 12, 2, 0.0)


# --- horizons


@pytest.mark.parametrize("one_task", [True, False])
def test_horizons_are_counted_and_their_overlap_stabbed(spark, one_task):
    rng = random.Random(2)
    rows = []
    for g in ("a", "b", None):
        for _ in range(80):
            start = rng.randrange(0, 500_000, 600)
            rows.append((g, start, start + rng.choice([600, 1200, 86400]), rng.choice([1, 2, 2, None])))
    rows.append(("a", 50, 50, 1))
    d = spark.createDataFrame(rows, "g string, s long, e long, horizon_seconds int").withColumn("start", F.timestamp_seconds("s")).withColumn("end", F.timestamp_seconds("e"))
    got = {r.g: r for r in D.horizon_overlap(d, ["g"], "start", "end", one_task).collect()}
    counts = {r.g: r for r in D.horizon_coverage(d, ["g"]).collect()}
    for g in ("a", "b", None):
        own = [(s, e) for k, s, e, _ in rows if k == g and s < e]
        times = sorted({x for span in own for x in span})[:-1]
        open_ = [sum(s <= t < e for s, e in own) for t in times]
        assert (got[g].min_overlap, got[g].max_overlap) == (min(open_), max(open_))
        h = [x for k, _, _, x in rows if k == g]
        n = [h.count(1), h.count(2)]
        c = counts[g]
        assert (c.horizons, c.horizon_samples, c.missing_horizon, c.min_horizon, c.max_horizon, c.min_samples, c.max_samples) == (2, sum(n), h.count(None), 1, 2, min(n), max(n))
        assert c.coverage_ratio == min(n) / max(n)
    assert D.horizon_overlap(d.limit(0), ["g"], "start", "end", one_task).collect() == []


# --- periods


def deepest(values):
    run = peak = fall = 0.0
    for v in values:
        run += v
        peak = max(peak, run)
        fall = max(fall, peak - run)
    return fall


def test_period_results_equal_a_walk_over_each_period(spark):
    rng = random.Random(4)
    rows, start = [], dt.datetime(2023, 12, 20)
    for c in ("x", "y"):
        for n in range(500):
            rows.append((c, n, start + dt.timedelta(hours=5 * n), rng.gauss(0, 1), rng.choice([-2, 0, 0, 1])))
    d = spark.createDataFrame(rows, "c string, t long, ts timestamp, gross double, delta int").repartition(3)
    got = {(r.c, r.grain, r.period): r for r in G.period_results(d, ["c"], "ts", "t", ("month", "week", "day"), 10.0, 0.25).collect()}
    keys = {"month": lambda x: x.strftime("%Y-%m"), "week": lambda x: "{}-W{:02}".format(*x.isocalendar()[:2]), "day": lambda x: x.strftime("%Y-%m-%d"), "total": lambda x: ""}
    seen = 0
    for c in ("x", "y"):
        for grain, key in keys.items():
            parts = {}
            for r in rows:
                if r[0] == c:
                    parts.setdefault(key(r[2]), []).append(r)
            equity = 10.0
            for period, own in sorted(parts.items()):
                r = got[c, grain, period]
                seen += 1
                turnover, gross = sum(abs(x[4]) for x in own), sum(x[3] for x in own)
                equity += gross - 0.25 * turnover
                assert (r.bars, r.trades, r.turnover) == (len(own), sum(x[4] != 0 for x in own), turnover)
                assert max(abs(r.gross - gross), abs(r.net - gross + 0.25 * turnover), abs(r.final_equity - equity), abs(r.drawdown - deepest([x[3] for x in own]))) < 1e-9
    assert seen == len(got)


# --- value packs

VALUES = "series_id string, t long, event_ts timestamp, value double"


def values(spark, *numbers, day=1):
    return spark.createDataFrame([("a", k, dt.datetime(2024, 1, day, k), float(v)) for k, v in enumerate(numbers)], VALUES)


def test_a_failed_writer_leaves_the_old_pack_current(spark, tmp_path, monkeypatch):
    root, cols = f"file://{tmp_path}", ["series_id", "t", "value"]
    assert T.write_value_pack(values(spark, 1, 2), root, "v", cols) is True
    assert T.write_value_pack(values(spark, 2, 1).withColumn("t", 1 - F.col("t")).repartition(3), root, "v", cols) is False
    old = T.manifest(spark, root, "v")
    assert (old["n"], old["values"], old["least"], old["most"], old["first_ts"]) == (2, 2, 1.0, 2.0, dt.datetime(2024, 1, 1))

    def fail(*_):
        raise RuntimeError("lost between data and manifest")

    with monkeypatch.context() as m:
        m.setattr(T, "_publish", fail)
        with pytest.raises(RuntimeError):
            T.write_value_pack(values(spark, 7, 8, 9), root, "v", cols)
    assert T.manifest(spark, root, "v") == old
    assert sorted(r.value for r in T.read_value_packs(spark, root, ["v"]).collect()) == [1.0, 2.0]
    reading = T.read_value_packs(spark, root, ["v"])
    assert T.write_value_pack(values(spark, 7, 8, 9), root, "v", cols) is True
    # a reader that had resolved the old pack still reads all of it
    assert sorted(r.value for r in reading.collect()) == [1.0, 2.0]
    assert sorted(r.value for r in T.read_value_packs(spark, root, ["v"]).collect()) == [7.0, 8.0, 9.0]
    assert len(T.drop_old_packs(spark, root, "v")) == 2
    assert T.read_value_packs(spark, root, ["v"]).count() == 3


def test_statistics_leave_packs_out(spark, tmp_path):
    root, cols = f"file://{tmp_path}", ["series_id", "t", "value"]
    for day in (1, 5, 9):
        T.write_value_pack(values(spark, 1, 2, day=day), root, f"d{day}", cols)
    read = T.read_value_packs(spark, root, ["d1", "d5", "d9"], since=dt.datetime(2024, 1, 3), until=dt.datetime(2024, 1, 6))
    assert {r.version_id for r in read.collect()} == {"d5"} and len(read.inputFiles()) == len(T.read_value_packs(spark, root, ["d5"]).inputFiles())
    assert T.read_value_packs(spark, root, ["d1"], since=dt.datetime(2025, 1, 1)).count() == 0
    with pytest.raises(FileNotFoundError):
        T.read_value_packs(spark, root, ["d2"])
    empty = values(spark, 1).limit(0)
    assert T.write_value_pack(empty, root, "none", cols) and T.read_value_packs(spark, root, ["none"]).count() == 0
