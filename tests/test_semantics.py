"""Rules that no SQL on the given tables shows: causality, ties, daylight saving, gaps and faults."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions import sessions as S
from barloom.functions import windows as W
from barloom.operators import diagnostics as D
from barloom.operators import labels as L
from barloom.operators import quotes as Q
from barloom.operators import signals as G
from barloom.operators import statistics as X
from barloom.plans import adapters as A

SF = "/root/testdata/sf0.001"
BAR = "series_id string, contract_id string, t long, event_ts timestamp, available_ts timestamp, open double, high double, low double, close double, volume double"


def bars(spark, rows):
    t0 = dt.datetime(2024, 1, 2, 15)
    out = [("a", "aH", i, t0 + dt.timedelta(minutes=i), t0 + dt.timedelta(minutes=i, seconds=1), *[None if x is None else float(x) for x in (c, h, l, c, v)]) for i, (h, l, c, v) in enumerate(rows)]
    return spark.createDataFrame(out, BAR)


def test_later_rows_change_no_feature_before_them(spark):
    from barloom.operators import features as E

    g = W.session_reset_groups(A.grid(spark, SF), W.Series())
    cut = g.filter("t < 1704844800")
    for make in (lambda x: E.returns(x), lambda x: E.atr(x, 5), lambda x: E.volume_zscore(x, 5), E.vwap, E.overnight_range, lambda x: E.prior_distance(x, True, 4), lambda x: E.trendiness(x, 5), E.anchored_vwap):
        whole = {(r.series_id, r.t): r.value for r in make(g).filter("t < 1704844800").collect()}
        part = {(r.series_id, r.t): r.value for r in make(cut).collect()}
        assert whole == part


@pytest.mark.parametrize("n,ddof", [(1, 0), (3, 1), (4, 0)])
def test_rolling_flags_row_by_row(spark, n, ddof):
    rng = random.Random(n)
    values = [None if rng.random() < 0.15 else rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(60)]
    b = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series_id string, available_ts long, x double")
    got = b.select("available_ts", *W.rolling_std(W.Series(), "x", n, ddof).named(), W.causal_zscore(W.Series(), "x", n, 0).flags.alias("z")).orderBy("available_ts").collect()
    for i, r in enumerate(got):
        w = values[max(0, i - n + 1) : i + 1]
        flag = "insufficient_window" if len(w) < n else "input_gap" if None in w else None
        assert list(r.value_flags) == ([flag] if flag else [])
        if flag is None:
            m = sum(w) / n
            ss = sum((x - m) ** 2 for x in w)
            want = 0.0 if len(set(w)) == 1 else (ss / (n - ddof)) ** 0.5
            assert abs(r.value - want) < 1e-9
            assert list(r.z) == (["zero_variance"] if len(set(w)) == 1 else [])


def test_daylight_saving_and_trade_dates(spark):
    rows = [("2024-03-08 14:30:00", "RTH"), ("2024-03-11 13:30:00", "RTH"), ("2024-03-08 13:30:00", "ETH"), ("2024-11-04 14:30:00", "RTH"), ("2024-11-01 13:30:00", "RTH"), ("2024-03-11 20:00:00", "ETH")]
    d = spark.createDataFrame(rows, "ts string, want string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert all(r.got == r.want for r in d.select("want", S.session_label("ts").alias("got")).collect())
    e = spark.createDataFrame([("2024-03-10 21:59:00", "2024-03-10"), ("2024-03-10 22:00:00", "2024-03-11"), ("2024-01-05 23:00:00", "2024-01-06"), ("2024-01-05 22:59:00", "2024-01-05")], "ts string, want string")
    assert all(r.got == r.want for r in e.select("want", S.trade_date(F.col("ts").cast("timestamp")).cast("string").alias("got")).collect())


def test_third_friday_and_rolls(spark):
    d = spark.createDataFrame([("2024-03-01", "2024-03-15"), ("2024-06-30", "2024-06-21"), ("2023-12-05", "2023-12-15"), ("2024-11-11", "2024-11-15")], "d string, want string")
    assert all(r.got == r.want for r in d.select("want", S.third_friday(F.col("d").cast("date")).cast("string").alias("got")).collect())
    near = spark.createDataFrame([("2024-03-05", True), ("2024-03-08", True), ("2024-03-04", False), ("2024-03-09", False)], "d string, want boolean")
    assert all(r.got == r.want for r in near.select("want", S.in_roll_window(F.col("d").cast("date")).alias("got")).collect())


def test_first_touch_policies_and_short_futures(spark):
    b = bars(spark, [(10, 10, 10, 1), (11, 9, 10, 1), (10.2, 9.9, 10, 1), (10.6, 10, 10, 1)])
    for policy, want in (("ambiguous", None), ("target_first", 1), ("stop_first", -1)):
        got = L.barrier(b, 2, 0.05, 0.05, policy=policy).orderBy("t").collect()
        assert got[0].triple_barrier == want and got[0].steps == 1
        assert (got[1].triple_barrier, got[1].steps) == (1, 2) and got[2].triple_barrier == 1
        assert got[3].outcome is None and got[3].label_available_ts is None
    got = L.barrier(b, 2, 0.5, 0.5).orderBy("t").collect()
    assert [r.triple_barrier for r in got] == [0, 0, None, None]
    assert [r.exit for r in G.first_touch_exits(b, 2, [F.col("close") * 0.95], 1.0).orderBy("t").collect()] == ["stop", "target", "target", None]


def test_no_trade_bars_are_gaps_for_labels(spark):
    b = bars(spark, [(10, 10, 10, 1), (None, None, None, 0), (12, 11, 12, 1)])
    r = {(x.t, x.horizon): (x.value, list(x.value_flags)) for x in L.forward_returns(b, [1, 2], guard=False).collect()}
    assert r[(0, 1)] == (None, ["no_trade"]) and abs(r[(0, 2)][0] - 0.2) < 1e-12 and (2, 1) not in r


def test_maintenance_crossing(spark):
    rows = [("2024-01-03 20:00:00", "2024-01-03 22:00:00", False), ("2024-01-03 21:59:00", "2024-01-03 22:01:00", True), ("2024-01-03 23:00:00", "2024-01-04 05:00:00", False), ("2024-01-03 20:00:00", "2024-01-05 20:00:00", True)]
    d = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in d.select("want", S.crosses_maintenance(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("got")).collect())


def test_ranks_and_buckets_with_ties(spark):
    f = [1.0, 1.0, 2.0, 2.0, 2.0, 9.0]
    d = spark.createDataFrame([("g", i, v, float(i)) for i, v in enumerate(f)], "g string, t int, f double, y double")
    assert [r.rank_x for r in D.ranked(d, ["g"]).orderBy("t").collect()] == [1.5, 1.5, 4.0, 4.0, 4.0, 6.0]
    assert [r.bucket for r in D.with_bucket(d, ["g"], "f", 4, ["t"]).orderBy("t").collect()] == [1, 1, 2, 3, 3, 4]
    flat = d.withColumn("f", F.lit(1.0))
    assert D.information_coefficients(flat, ["g"]).first().pearson_ic is None


@settings(max_examples=8, deadline=None)
@given(n=st.integers(1, 60), train=st.integers(1, 12), val=st.integers(1, 8), step=st.integers(1, 9), purge=st.integers(0, 3))
def test_walk_forward_equals_listing(spark, n, train, val, step, purge):
    d = spark.createDataFrame([("a", i) for i in range(n)], "g string, t int")
    got = {(r.fold, r.t, r.role) for r in X.walk_forward(d, ["g"], ["t"], train, val, step, purge).collect()}
    want, k = set(), 0
    while k * step + train + purge + val <= n:
        want |= {(k, k * step + i, "train") for i in range(train)} | {(k, k * step + train + purge + i, "validation") for i in range(val)}
        k += 1
    assert got == want


def test_shuffles_move_everything_and_lose_nothing(spark):
    d = spark.createDataFrame([("g", i, i // 5, float(i)) for i in range(40)], "g string, t int, day int, y double")
    s = X.label_shuffle(d, ["g"], ["t"], 1, 3).collect()
    for seed in (1, 2, 3):
        own = [(r.y, r.y_shuffled) for r in s if r.seed == seed]
        assert sorted(a for a, _ in own) == sorted(b for _, b in own) and all(a != b for a, b in own)
    b = X.block_shuffle(d, ["g"], "day", "t", 1, 1).collect()
    assert all(r.moved and r.y_shuffled % 5 == r.y % 5 for r in b) and sorted(r.y_shuffled for r in b) == sorted(r.y for r in b)


def test_benjamini_hochberg_by_hand(spark):
    p = [0.001, 0.02, 0.039, 0.2, 0.05]
    d = spark.createDataFrame([("f", float(x)) for x in p], "family string, p double")
    got = {r.p: (r.bh_pass, r.bonferroni_pass) for r in X.family_correction(d, "family", "p").collect()}
    assert got == {0.001: (True, True), 0.02: (True, True), 0.039: (True, False), 0.05: (True, False), 0.2: (False, False)}


def test_capital_is_spent_in_order(spark):
    d = spark.createDataFrame([(1, "a", 60.0), (2, "a", 60.0), (3, "b", 60.0), (4, "c", 60.0), (5, "d", 60.0)], "k int, instrument_id string, notional double").withColumn("day", F.lit(1))
    got = G.portfolio_limits(d, ["day"], "k", 1000.0, 3, 0.05, 1.0, 120.0).orderBy("k").collect()
    assert [(r.allocated, r.reason) for r in got] == [(50.0, None), (0.0, "repeated_instrument"), (50.0, None), (20.0, "insufficient_capital"), (0.0, "max_active_instruments")]


def test_as_of_join_takes_the_latest_known(spark):
    a = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9)], "k string, at int")
    b = spark.createDataFrame([("x", 2, "p"), ("x", 5, "q"), ("x", 6, "r")], "k string, ts int, v string")
    assert {(r.k, r["at"], r.v_as_of) for r in Q.as_of_join(a, b, "k", "at", "ts", ["v"]).collect()} == {("x", 5, "q"), ("x", 1, None), ("y", 9, None)}


def test_update_intensity_counts_arrivals(spark):
    d = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, s, us), i) for i, (s, us) in enumerate([(0, 0), (0, 0), (0, 500000), (1, 0), (3, 0)])], "series_id string, event_ts timestamp, event_id int")
    assert [r.updates for r in Q.update_intensity(d).orderBy("event_id").collect()] == [1, 2, 3, 2, 1]


def test_stream_of_trades_to_bars(spark, tmp_path):
    from barloom.streaming import ingest

    src = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", F.col("event_type").alias("series_id"), (100 + F.col("value") / 10).alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("size"))
    src.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    src.filter("event_id % 3 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    t = ingest.read_trades(spark, f"{tmp_path}/in/*", "event_id long, ts timestamp, series_id string, price double, size double")
    c = ingest.canonical_stream(t, ["event_id"], "ts", "60 days")
    ingest.append(c, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == src.count() and got.select("event_id").distinct().count() == src.count()
    b = ingest.bar_stream(ingest.read_trades(spark, f"{tmp_path}/in/a", "event_id long, ts timestamp, series_id string, price double, size double").withWatermark("ts", "1 hour"), "series_id", "ts", "price", "size", "1 hour")
    ingest.append(b, f"{tmp_path}/bars", f"{tmp_path}/ck2").awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/bars")
    whole = A.bars(spark, SF)
    assert done.count() > 0 and done.join(whole, ["series_id", "bar_start_ts", "open", "high", "low", "close", "volume"]).count() == done.count()


def test_halo_chunks_equal_whole_series(spark):
    g = A.grid(spark, SF)
    whole = g.select("series_id", "t", W.rolling_mean(W.Series(), "volume", 6).value.alias("v"))
    cut = W.with_halo(g, "bar_start_ts", "chunk", 6 * 3600, 2 * 86400).select("series_id", "t", "in_halo", W.rolling_mean(W.Series(("series_id", "chunk")), "volume", 6).value.alias("v")).filter("not in_halo").drop("in_halo")
    assert whole.exceptAll(cut).count() == 0 and cut.count() == whole.count()


def test_range_lookups_keep_equal_rows(spark):
    from barloom.functions import sessions as S

    rows = spark.sql("select explode(array(1, 1, 2)) k, 'ES' root, timestamp'2024-03-01 12:00:00' a, timestamp'2024-03-20 12:00:00' b")
    cal = spark.sql("select 'ES' root, date'2024-03-14' roll_date union all select 'NQ', date'2024-03-14'")
    got = S.roll_guard(rows, cal, "root", "a", "b").select("k", "rolls_crossed", "guard_action").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "drop"), (1, 1, "drop"), (2, 1, "drop")]
    facts = spark.sql("select explode(array('X', 'X', 'Y', cast(null as string))) s, date'2024-01-05' d")
    master = spark.sql("select 'X' symbol, 7 instrument_id, date'2024-01-01' active_from, cast(null as date) active_to")
    got = S.resolve_symbols(facts, master, "s", "d").select("s", "instrument_id").collect()
    assert sorted(map(tuple, got), key=str) == [("X", 7), ("X", 7), ("Y", None), (None, None)] or len(got) == 4 and sum(r.instrument_id == 7 for r in got) == 2


def test_portfolio_net_limit_and_reject_policy(spark):
    import random

    from barloom.operators import signals as G

    rng = random.Random(3)
    data = [(f"d{k % 5}", k, k, float(rng.randint(1, 90)), rng.choice([1, -1])) for k in range(60)]
    d = spark.createDataFrame(data, "day string, k int, instrument_id int, notional double, side int")
    for policy in ("cap", "reject"):
        got = {r.k: (round(r.allocated, 6), r.reason) for r in G.portfolio_limits(d, ["day"], "k", 1000.0, 8, 0.06, 0.3, 150.0, 0.1, "side", policy).collect()}
        for day in sorted({x[0] for x in data}):
            own = [[k, min(n, 60.0), s] for dd, k, _, n, s in data if dd == day]
            live = own[:8]
            gross = sum(x[1] for x in live)
            for x in live:
                x[1] *= min(1.0, 300.0 / gross)
            net = abs(sum(x[1] * x[2] for x in live))
            for x in live:
                x[1] *= min(1.0, 100.0 / net) if net else 1.0
            left = 150.0
            for k, n, _ in live:
                take = n if n <= left + 1e-9 else (left if policy == "cap" else 0.0)
                left -= take
                assert abs(got[k][0] - take) < 1e-4 and got[k][1] == ("insufficient_capital" if take < n - 1e-9 else None)
            assert all(got[x[0]] == (0.0, "max_active_instruments") for x in own[8:])


def test_coverage_of_minute_bars(spark):
    from barloom.operators.quality import coverage

    traded = {0, 1, 4, 5, 9}
    intervals = spark.createDataFrame([("s", "day", 0, 600)], "series_id string, session string, start_t long, end_t long")
    rows = spark.createDataFrame([("s", "day", 60 * m) for m in traded], "series_id string, session string, t long")
    r = coverage(intervals, rows, ["series_id"], ["session"], 2, 60).first()
    assert (r.expected, r.traded, r.no_trade, r.long_runs, r.long_run_bars) == (10, 5, 5, 1, 3)


def test_surrogates_equal_to_the_effect_do_not_count(spark):
    from barloom.operators.statistics import surrogate_gate

    d = spark.createDataFrame([("a", 0.5, 0.5), ("a", -0.6, 0.5), ("a", 0.1, 0.5)], "g string, effect double, observed double")
    assert surrogate_gate(d, ["g"]).first().passes == 1
