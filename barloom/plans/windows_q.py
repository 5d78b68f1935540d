"""Registered queries of the window primitives, sessions, calendars and rolls."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import sessions as S
from barloom.functions import windows as W
from barloom.plans import adapters as A
from barloom.plans.registry import query

SERIES = W.Series()
N = 12


def out(df, *cols):
    """Key columns and the given ones, doubles rounded to six places, flags joined."""
    kinds = dict(df.dtypes)
    named = [c for c in ("series_id", "t", *cols)]
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.array_join(c, ",").alias(c) if kinds[c].startswith("array<string") else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in named])


def _over(df, make, before, after=0):
    return W.over(df, SERIES, lambda g, s: g.select("*", *make(s).named()), before, after)


def _point(name, make, value_sql, reason="''", n=N):
    flag = f"CASE WHEN count(*) OVER w < {n} THEN 'insufficient_window' WHEN count(x) OVER w < count(*) OVER w THEN 'input_gap' ELSE {reason} END"
    sql = f"""WITH {A.GRID}, v AS (SELECT *, close AS x FROM grid)
SELECT series_id, t, CASE WHEN count(*) OVER w < {n} OR count(x) OVER w < count(*) OVER w THEN NULL ELSE round({value_sql}, 6) END AS value, {flag} AS value_flags
FROM v WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"""

    @query(name, sql)
    def run(spark, d):
        return out(_over(A.grid(spark, d), make, n), "value", "value_flags")


_point("win1_rolling_mean", lambda s: W.rolling_mean(s, "close", N), "avg(x) OVER w")
_point("win2_rolling_std", lambda s: W.rolling_std(s, "close", N, 1), "stddev_samp(x) OVER w")
_point("win4_rolling_min", lambda s: W.rolling_min(s, "close", N), "min(x) OVER w")
_point("win5_rolling_max", lambda s: W.rolling_max(s, "close", N), "max(x) OVER w")
_point("win6_rolling_range", lambda s: W.rolling_range(s, "close", N), "max(x) OVER w - min(x) OVER w")
_point("win11_causal_zscore", lambda s: W.causal_zscore(s, "close", N), "(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)", "CASE WHEN max(x) OVER w = min(x) OVER w THEN 'zero_variance' ELSE '' END")
_point("win12_causal_demean", lambda s: W.causal_demean(s, "close", N), "x - avg(x) OVER w")
_point("win13_causal_minmax", lambda s: W.causal_minmax(s, "close", N), "(x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0)", "CASE WHEN max(x) OVER w = min(x) OVER w THEN 'zero_range' ELSE '' END")


def _returns(name, make, expr, label):
    reset = "max(CAST(ch AS INT)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 1" if label else "false"
    sql = f"""WITH {A.GRID}, v AS (SELECT *, lag(close, 2) OVER (PARTITION BY series_id ORDER BY t) AS p, row_number() OVER (PARTITION BY series_id ORDER BY t) AS rn,
  session_label <> lag(session_label) OVER (PARTITION BY series_id ORDER BY t) AS ch FROM grid), f AS (SELECT *, CASE WHEN rn <= 2 THEN 'insufficient_window' WHEN {reset} THEN 'session_reset'
  WHEN close IS NULL OR p IS NULL THEN 'input_gap' ELSE '' END AS value_flags FROM v)
SELECT series_id, t, CASE WHEN value_flags = '' THEN round({expr}, 6) END AS value, value_flags FROM f"""

    @query(name, sql)
    def run(spark, d):
        return out(_over(A.grid(spark, d), make, 2), "value", "value_flags")


_returns("win7_simple_returns", lambda s: W.simple_returns(s, "close", 2, "session_label"), "close / p - 1", True)
_returns("win8_log_returns", lambda s: W.log_returns(s, "close", 2), "ln(close / p)", False)

_TR = """tr0 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM grid),
trg AS (SELECT *, CASE WHEN close IS NOT NULL THEN CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END END AS x FROM tr0)"""


@query("win9_true_range", f"WITH {A.GRID}, {_TR} SELECT series_id, t, round(x, 6) AS value, CASE WHEN x IS NULL THEN 'input_gap' ELSE '' END AS value_flags FROM trg")
def win9(spark, d):
    return out(W.true_range(A.grid(spark, d), SERIES), "value", "value_flags")


def _rolled(x, n, value, source, extra=""):
    return f"""WITH {A.GRID}, {source}
SELECT series_id, t, CASE WHEN count(*) OVER w < {n} OR count({x}) OVER w < count(*) OVER w THEN NULL ELSE round({value}, 6) END AS value FROM {extra}
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"""


@query("win10_average_true_range", _rolled("x", N, "avg(x) OVER w", _TR, "trg"))
def win10(spark, d):
    return out(W.average_true_range(A.grid(spark, d), SERIES, N), "value")


_R1 = "r1 AS (SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY t) - 1 AS r FROM grid)"


@query("win3_rolling_volatility", _rolled("r", N, "stddev_samp(r) OVER w", _R1, "r1"))
def win3(spark, d):
    def build(g, s):
        return g.withColumn("r", W.simple_returns(s, "close").value).select("*", *W.rolling_volatility(s, "r", N, 1).named())

    return out(W.over(A.grid(spark, d), SERIES, build, N + 1), "value")


_SEG = """seg0 AS (SELECT *, CASE WHEN session_label IS DISTINCT FROM lag(session_label) OVER (PARTITION BY series_id ORDER BY t) THEN 1 ELSE 0 END AS ch FROM grid),
seg AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM seg0)"""


@query("win14_session_reset_groups", f"WITH {A.GRID}, {_SEG} SELECT series_id, t, segment FROM seg")
def win14(spark, d):
    return out(W.session_reset_groups(A.grid(spark, d), SERIES), "segment")


@query("win15_centered_mean", f"""WITH {A.GRID} SELECT series_id, t, CASE WHEN count(close) OVER w = 5 THEN round(avg(close) OVER w, 6) END AS value FROM grid
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def win15(spark, d):
    return out(_over(A.grid(spark, d), lambda s: W.centered_mean(s, "close", 5), 2, 2), "value")


@query("win16_future_mean", f"""WITH {A.GRID} SELECT series_id, t, CASE WHEN count(close) OVER w = 5 THEN round(avg(close) OVER w, 6) END AS value FROM grid
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def win16(spark, d):
    return out(_over(A.grid(spark, d), lambda s: W.future_mean(s, "close", 5), 0, 5), "value")


@query("win17_prior_window", f"""WITH {A.GRID} SELECT series_id, t, CASE WHEN count(high) OVER w = 6 THEN round(max(high) OVER w, 6) END AS value FROM grid
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def win17(spark, d):
    return out(W.over(A.grid(spark, d), SERIES, lambda g, s: g.withColumn("value", W.prior_window(s, "high", 6, F.max)), 6), "value")


@query("win18_expanding_session_state", f"""WITH {A.GRID}, {_SEG} SELECT series_id, t, round(sum(volume) OVER w, 6) AS volume_so_far, round(max(high) OVER w, 6) AS high_so_far, round(min(low) OVER w, 6) AS low_so_far FROM seg
WINDOW w AS (PARTITION BY series_id, segment ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def win18(spark, d):
    s = W.Series(segment="segment")
    g = W.session_reset_groups(A.grid(spark, d), SERIES)
    return out(g.withColumns({"volume_so_far": W.expanding(s, "volume", F.sum), "high_so_far": W.expanding(s, "high", F.max), "low_so_far": W.expanding(s, "low", F.min)}), "volume_so_far", "high_so_far", "low_so_far")


@query("win19_pit_normalize", f"""WITH {A.GRID} SELECT series_id, t, CASE WHEN close IS NOT NULL AND count(close) OVER w >= 6 THEN CASE WHEN max(close) OVER w = min(close) OVER w THEN 0 ELSE round((close - avg(close) OVER w) / stddev_pop(close) OVER w, 6) END END AS value FROM grid
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def win19(spark, d):
    return out(W.over(A.grid(spark, d), SERIES, lambda g, s: g.withColumn("value", W.pit_normalize(s, "close", N, 6)), N), "value")


# --- sessions, calendars, rolls


@query("ses2_session_label", f"WITH {A.GRID} SELECT series_id, t, session_label FROM grid")
def ses2(spark, d):
    return out(A.grid(spark, d), "session_label")


@query("ses3_trade_date_segment", f"WITH {A.GRID} SELECT series_id, t, trade_date, series_id || ':' || trade_date || ':' || session_label AS segment_id FROM grid")
def ses3(spark, d):
    g = A.grid(spark, d)
    return out(g.withColumns({"trade_date": S.trade_date(F.col("bar_start_ts")).cast("string"), "segment_id": S.segment_key(F.col("series_id"), F.col("bar_start_ts"))}), "trade_date", "segment_id")


@query("ses4_contiguous_segments", f"WITH {A.GRID}, {_SEG} SELECT series_id, segment, count(*) AS bars, min(t) AS first_t, max(t) AS last_t FROM seg GROUP BY 1, 2")
def ses4(spark, d):
    return W.session_reset_groups(A.grid(spark, d), SERIES).groupBy("series_id", "segment").agg(F.count("*").alias("bars"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


_CAL = """cal AS (SELECT day, day::TIMESTAMP + INTERVAL 870 MINUTE AS open_ts, day::TIMESTAMP + CASE WHEN half THEN INTERVAL 1080 MINUTE ELSE INTERVAL 1260 MINUTE END AS close_ts, half, CASE WHEN half THEN 210 ELSE 390 END AS minutes FROM (
  SELECT DISTINCT CAST(event_ts - INTERVAL 6 HOUR AS DATE) AS day, day(CAST(event_ts - INTERVAL 6 HOUR AS DATE)) % 10 = 2 AS half FROM tr) WHERE isodow(day) < 6 AND day(day) <> 15 AND day >= DATE '2024-01-01')"""


def _calendar(spark, d):
    days = A.trades(spark, d).select(F.to_date(S.local("event_ts")).alias("date")).distinct()
    holidays, halves = days.filter("day(date) = 15"), days.filter("day(date) % 10 = 2")
    return S.expand_calendar(spark, "2024-01-01", "2024-01-30", holidays, halves)


@query("ses5_calendar_expansion", f"WITH {A.TRADES}, {_CAL} SELECT CAST(day AS VARCHAR) AS date, CAST(epoch(open_ts) AS BIGINT) AS open_t, CAST(epoch(close_ts) AS BIGINT) AS close_t, half AS half_day, CAST(minutes AS BIGINT) AS minutes FROM cal")
def ses5(spark, d):
    return _calendar(spark, d).select(F.col("date").cast("string").alias("date"), F.unix_timestamp("open_ts").alias("open_t"), F.unix_timestamp("close_ts").alias("close_t"), "half_day", "minutes")


@query("ses1_sessionize", f"""WITH {A.GRID}, {_CAL} SELECT g.series_id, g.t, CASE WHEN c.day IS NULL THEN '' ELSE g.series_id || ':' || CAST(c.day AS VARCHAR) END AS session_id,
  CASE WHEN c.day IS NULL THEN -1 ELSE CAST(floor((g.t - epoch(c.open_ts)) / 3600) AS BIGINT) END AS bar_index, CAST(c.minutes // 60 AS BIGINT) AS expected_bars, c.half AS half_day
FROM grid g LEFT JOIN cal c ON CAST(g.bar_start_ts - INTERVAL 6 HOUR AS DATE) = c.day AND g.bar_start_ts >= c.open_ts AND g.bar_start_ts + INTERVAL 1 HOUR <= c.close_ts""")
def ses1(spark, d):
    return out(S.sessionize(A.grid(spark, d), _calendar(spark, d), 60), "session_id", "bar_index", "expected_bars", "half_day")


_UCAL = "ucal AS (SELECT DISTINCT 'C' || (c_nationkey % 5) AS calendar_id, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey)"


def _ucal(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    # an own calendar for each class: the order dates of its customers
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("C"), (F.col("c_nationkey") % 5).cast("string")).alias("calendar_id"), F.to_date("o_orderdate").alias("date")).distinct()


@query("ses6_universe_alignment", f"WITH {A.UNIVERSE}, {_UCAL} SELECT instrument_id, count(*) AS sessions, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM universe JOIN ucal USING (calendar_id) WHERE date >= active_from AND date <= coalesce(active_to, DATE '9999-12-31') GROUP BY 1")
def ses6(spark, d):
    return S.align_universe(A.universe(spark, d), _ucal(spark, d)).groupBy("instrument_id").agg(F.count("*").alias("sessions"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"))


@query("ses7_missing_flags", f"""WITH {A.UNIVERSE}, {_UCAL}, {A.DAILY}, a AS (SELECT instrument_id, date FROM universe JOIN ucal USING (calendar_id) WHERE date >= active_from AND date <= coalesce(active_to, DATE '9999-12-31'))
SELECT instrument_id, count(*) AS missing_sessions FROM a WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.series_id = instrument_id AND d.day = date) GROUP BY 1""")
def ses7(spark, d):
    aligned = S.align_universe(A.universe(spark, d), _ucal(spark, d))
    seen = A.daily(spark, d).select(F.col("series_id").alias("instrument_id"), F.col("day").alias("date"))
    return aligned.join(seen, ["instrument_id", "date"], "left_anti").groupBy("instrument_id").agg(F.count("*").alias("missing_sessions"))


_ROLLS = """rolls AS (SELECT root, root || substr('HMUZ', CAST(quarter(m) AS INT), 1) || strftime(m, '%y') AS from_contract, root || substr('HMUZ', CAST(quarter(m + INTERVAL 3 MONTH) AS INT), 1) || strftime(m + INTERVAL 3 MONTH, '%y') AS to_contract,
  CAST(m + to_days(CAST((12 - isodow(m)) % 7 + 14 AS INT)) AS DATE) - 8 AS roll_date
  FROM (SELECT DISTINCT n_name AS root FROM nation), (SELECT unnest(generate_series(DATE '1992-03-01', DATE '2002-12-01', INTERVAL 3 MONTH)) AS m))"""


def _rolls(spark, d):
    return S.roll_calendar(spark, A.table(spark, d, "nation").select(F.col("n_name").alias("root")), 1992, 2002)


@query("rol1_roll_calendar", f"WITH {_ROLLS} SELECT root, from_contract, to_contract, CAST(roll_date AS VARCHAR) AS roll_date FROM rolls")
def rol1(spark, d):
    return _rolls(spark, d).select("root", "from_contract", "to_contract", F.col("roll_date").cast("string").alias("roll_date"))


@query("rol2_roll_window", f"WITH {_ROLLS}, days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS orders FROM orders GROUP BY 1) SELECT CAST(d AS VARCHAR) AS day, orders, EXISTS (SELECT 1 FROM rolls WHERE d BETWEEN roll_date - 2 AND roll_date + 1) AS in_roll_window FROM days")
def rol2(spark, d):
    days = A.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return days.select(F.col("day").cast("string").alias("day"), "orders", S.in_roll_window(F.col("day")).alias("in_roll_window"))


_SPANS = "spans AS (SELECT o_orderkey, n_name AS root, o_orderdate + INTERVAL 12 HOUR AS entry, o_orderdate + INTERVAL 12 HOUR + to_days(CAST(o_orderkey % 120 AS INT)) AS terminal FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _spans(spark, d):
    o, c, n = (A.table(spark, d, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    entry = F.col("o_orderdate").cast("timestamp") + F.expr("interval 12 hour")
    return j.select("o_orderkey", F.col("n_name").alias("root"), entry.alias("entry"), (entry + F.make_dt_interval(days=(F.col("o_orderkey") % 120).cast("int"))).alias("terminal"))


@query("rol3_roll_guard", f"""WITH {_ROLLS}, {_SPANS} SELECT o_orderkey, count(roll_date) AS rolls_crossed, CASE count(roll_date) WHEN 0 THEN 'keep' WHEN 1 THEN 'truncate' ELSE 'drop' END AS guard_action, CAST(min(roll_date) AS VARCHAR) AS first_roll
FROM spans s LEFT JOIN rolls r ON s.root = r.root AND CAST(entry - INTERVAL 6 HOUR AS DATE) < roll_date AND roll_date <= CAST(terminal - INTERVAL 6 HOUR AS DATE) GROUP BY o_orderkey""")
def rol3(spark, d):
    return S.roll_guard(_spans(spark, d), _rolls(spark, d), "root", "entry", "terminal", "truncate").select("o_orderkey", "rolls_crossed", "guard_action", F.col("first_roll").cast("string").alias("first_roll"))


@query("rol4_maintenance_break", f"""WITH {A.BARS} SELECT series_id, t, EXISTS (SELECT 1 FROM generate_series(0, 2) g(k) WHERE CAST(bar_end_ts - INTERVAL 6 HOUR AS DATE) + CAST(k AS INT) <= CAST(bar_end_ts - INTERVAL 6 HOUR + INTERVAL 10 HOUR AS DATE)
  AND bar_end_ts - INTERVAL 6 HOUR < CAST(bar_end_ts - INTERVAL 6 HOUR AS DATE)::TIMESTAMP + to_days(CAST(k AS INT)) + INTERVAL 17 HOUR AND bar_end_ts + INTERVAL 4 HOUR > CAST(bar_end_ts - INTERVAL 6 HOUR AS DATE)::TIMESTAMP + to_days(CAST(k AS INT)) + INTERVAL 16 HOUR) AS crosses FROM bars""")
def rol4(spark, d):
    return out(A.bars(spark, d).withColumn("crosses", S.crosses_maintenance(F.col("event_ts"), F.col("event_ts") + F.expr("interval 10 hour"))), "crosses")


@query("uni1_active_members", f"WITH {A.UNIVERSE}, q AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders) SELECT CAST(m AS VARCHAR) AS month, count(*) AS members, round(sum(balance), 2) AS balance FROM q JOIN universe ON active_from <= m AND coalesce(active_to, DATE '9999-12-31') >= m GROUP BY 1")
def uni1(spark, d):
    months = A.table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    return S.active_members(A.universe(spark, d).crossJoin(F.broadcast(months)), F.col("m")).groupBy(F.col("m").cast("string").alias("month")).agg(F.count("*").alias("members"), F.round(F.sum("balance"), 2).alias("balance"))


@query("uni2_resolve_symbols", f"""WITH {A.UNIVERSE}, q AS (SELECT DISTINCT 'S' || (l_suppkey % 50) AS symbol, CAST(date_trunc('year', l_shipdate) AS DATE) AS day FROM lineitem)
SELECT symbol, CAST(day AS VARCHAR) AS day, CASE WHEN n = 1 THEN i END AS instrument_id FROM (SELECT q.symbol, q.day, (SELECT count(*) FROM universe u WHERE u.symbol = q.symbol AND active_from <= q.day AND coalesce(active_to, DATE '9999-12-31') >= q.day) AS n,
(SELECT min(instrument_id) FROM universe u WHERE u.symbol = q.symbol AND active_from <= q.day AND coalesce(active_to, DATE '9999-12-31') >= q.day) AS i FROM q)""")
def uni2(spark, d):
    q = A.table(spark, d, "lineitem").select(F.concat(F.lit("S"), (F.col("l_suppkey") % 50).cast("string")).alias("symbol"), F.trunc("l_shipdate", "year").alias("day")).distinct()
    return S.resolve_symbols(q, A.universe(spark, d), "symbol", "day").select("symbol", F.col("day").cast("string").alias("day"), "instrument_id")
