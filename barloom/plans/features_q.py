"""Registered queries of the feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import sessions as S
from barloom.functions import windows as W
from barloom.operators import features as X
from barloom.operators import quotes as Q
from barloom.plans import adapters as A
from barloom.plans.registry import query
from barloom.plans.windows_q import _CAL, _SEG, _calendar, out

N = 8
G = f"WITH {A.GRID}, {_SEG}, g AS (SELECT *, CAST(trade_date AS DATE) AS td, hour(bar_start_ts - INTERVAL 6 HOUR) * 60 AS lm, lag(close) OVER s AS c1, close / lag(close) OVER s - 1 AS r, (high + low + close) / 3 * volume AS pv FROM seg WINDOW s AS (PARTITION BY series_id ORDER BY t))"
W_N = f"WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"
W_P = f"WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING)"
W_S = "WINDOW w AS (PARTITION BY series_id, segment ORDER BY t ROWS UNBOUNDED PRECEDING)"


def _grid(spark, d):
    return W.session_reset_groups(A.grid(spark, d), W.Series())


def _bars(name, make, expr, window="", integer=False, source="g", ctes=""):
    value = f"CAST({expr} AS BIGINT)" if integer else expr if integer is None else f"round({expr}, 6)"

    @query(name, f"{G}{ctes} SELECT series_id, t, {value} AS value FROM {source} {window}")
    def run(spark, d):
        return out(make(_grid(spark, d)), "value")


def full(x, then, n=N):
    return f"CASE WHEN count({x}) OVER w = {n} THEN {then} END"


_bars("f1_returns", lambda g: X.returns(g), "r")
_bars("f2_log_returns", lambda g: X.log_returns(g), "ln(close / c1)")
_bars("f3_rolling_volatility", lambda g: X.rolling_volatility(g, N), full("r", "stddev_pop(r) OVER w"), W_N)
_bars("f4_rolling_range", lambda g: X.rolling_range(g, N), full("close", "max(high) OVER w - min(low) OVER w"), W_N)
_bars("f5_atr", lambda g: X.atr(g, N), full("x", "avg(x) OVER w"), W_N, source="tr2", ctes=""", tr1 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM g),
tr2 AS (SELECT *, CASE WHEN close IS NOT NULL THEN greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) END AS x FROM tr1)""")
_bars("f6_volume_zscore", lambda g: X.volume_zscore(g, N), full("volume", "CASE WHEN max(volume) OVER w > min(volume) OVER w THEN (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w END"), W_N)
_bars("f7_rolling_volume", lambda g: X.rolling_volume(g, N), full("volume", "sum(volume) OVER w"), W_N)
_bars("f8_session_minute", X.session_minute, "(t - min(t) OVER w) / 60", W_S, True)
_bars("f9_rth_flag", lambda g: X.session_flag(g, "RTH"), "CASE WHEN session_label = 'RTH' THEN 1 ELSE 0 END", integer=True)
_bars("f10_eth_flag", lambda g: X.session_flag(g, "ETH"), "CASE WHEN session_label = 'ETH' THEN 1 ELSE 0 END", integer=True)
_OPEN = ", o AS (SELECT *, max(CASE WHEN t < s0 + 7200 THEN high END) OVER w AS oh, min(CASE WHEN t < s0 + 7200 THEN low END) OVER w AS ol FROM (SELECT *, min(t) OVER (PARTITION BY series_id, segment) AS s0 FROM g) " + W_S + ")"
_bars("f11_opening_range", lambda g: X.opening_range(g, 120), "CASE WHEN session_label = 'RTH' THEN oh - ol END", source="o", ctes=_OPEN)
_bars("f12_overnight_range", X.overnight_range, "CASE WHEN session_label = 'ETH' THEN rr ELSE held END", source="ov2", ctes=f""", ov AS (SELECT *, max(high) OVER w - min(low) OVER w AS rr FROM g {W_S}),
ov1 AS (SELECT series_id, segment + 1 AS segment, arg_max(rr, t) AS held FROM ov WHERE session_label = 'ETH' GROUP BY 1, 2), ov2 AS (SELECT ov.*, ov1.held FROM ov LEFT JOIN ov1 USING (series_id, segment))""")
_bars("f13_vwap", X.vwap, "CASE WHEN close IS NOT NULL THEN sum(pv) OVER w / sum(volume) OVER w END", W_S)
_bars("f14_anchored_vwap", X.anchored_vwap, "CASE WHEN close IS NOT NULL AND block > 0 THEN sum(pv) OVER w / sum(volume) OVER w END", "WINDOW w AS (PARTITION BY series_id, block ORDER BY t ROWS UNBOUNDED PRECEDING)", source="an",
      ctes=", an AS (SELECT *, sum(CASE WHEN ch = 1 AND session_label = 'RTH' THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS block FROM g)")
_bars("f15_distance_to_vwap", X.distance_to_vwap, "CASE WHEN close IS NOT NULL THEN (close - sum(pv) OVER w / sum(volume) OVER w) / (sum(pv) OVER w / sum(volume) OVER w) END", W_S)
_bars("f16_range_position", lambda g: X.range_position(g, N), full("close", "(close - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0)"), W_N)
_bars("f17_trendiness", lambda g: X.trendiness(g, N), full("close", f"abs(close - first(close) OVER w) / nullif(sum(abs(close - c1)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {N - 2} PRECEDING AND CURRENT ROW), 0)"), W_N)

_bars("c1_session_id", X.session_id, "series_id || ':' || trade_date || ':' || session_label", integer=None)
_bars("c2_minutes_from_rth_open", lambda g: X.rth_minutes(g, True), "CASE WHEN lm >= 510 AND lm < 900 THEN lm - 510 END", integer=True)
_bars("c3_minutes_to_rth_close", lambda g: X.rth_minutes(g, False), "CASE WHEN lm >= 510 AND lm < 900 THEN 900 - lm END", integer=True)
_bars("c4_rth_segment_flag", lambda g: X.session_flag(g, "RTH"), "CASE WHEN lm >= 510 AND lm < 900 THEN 1 ELSE 0 END", integer=True)
_bars("c5_eth_segment_flag", lambda g: X.session_flag(g, "ETH"), "CASE WHEN lm >= 510 AND lm < 900 THEN 0 ELSE 1 END", integer=True)
_bars("c6_day_of_week", X.day_of_week, "isodow(bar_start_ts) - 1", integer=True)


def _runs(g):
    """Contract runs that change on the days 11 and 21 of a month."""
    return g.withColumn("contract_id", F.concat("series_id", F.floor((F.dayofmonth("bar_start_ts") - 1) / 10).cast("string")))


_RUN = ", rn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k, (day(bar_start_ts) - 1) // 10 AS c FROM g), ru AS (SELECT *, CASE WHEN c <> lag(c) OVER (PARTITION BY series_id ORDER BY t) THEN k END AS ck, CASE WHEN c <> lag(c) OVER (PARTITION BY series_id ORDER BY t) THEN t END AS ct FROM rn), rv AS (SELECT *, min(ck) OVER w AS nk, min(ct) OVER w AS nt FROM ru WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"
_bars("c7_bars_to_roll", lambda g: X.to_roll(_runs(g)), "nk - k", source="rv", integer=True, ctes=_RUN)
_bars("c8_minutes_to_roll", lambda g: X.to_roll(_runs(g), True), "(nt - t) / 60", source="rv", integer=True, ctes=_RUN)
_bars("c11_is_opex_day", X.is_opex_day, "CASE WHEN isodow(td) = 5 AND day(td) BETWEEN 15 AND 21 THEN 1 ELSE 0 END", integer=True)
_bars("c12_is_quad_witch_day", X.is_quad_witch_day, "CASE WHEN isodow(td) = 5 AND day(td) BETWEEN 15 AND 21 AND month(td) % 3 = 0 THEN 1 ELSE 0 END", integer=True)
_bars("c15_in_roll_window", X.in_roll_window, "CASE WHEN month(td) % 3 = 0 AND day(bar_start_ts) BETWEEN 4 AND 14 THEN 1 ELSE 0 END", integer=True)


@query("c9_minutes_to_expiration", f"{G}, ex AS (SELECT series_id, event_ts AS k, max(date_trunc('day', event_ts) + to_days(CAST(user_id % 4 AS INT))) AS e FROM tr GROUP BY 1, 2), m AS (SELECT g.series_id, g.t, arg_max(e, k) AS e FROM g LEFT JOIN ex ON ex.series_id = g.series_id AND k <= g.bar_start_ts + INTERVAL 3601 SECOND GROUP BY 1, 2) SELECT series_id, t, CASE WHEN epoch(e) >= t THEN CAST((epoch(e) - t) // 60 AS BIGINT) END AS value FROM m")
def c9(spark, d):
    expiry = F.date_trunc("day", "event_ts") + F.make_dt_interval(days=(F.col("user_id") % 4).cast("int"))
    facts = A.trades(spark, d).groupBy("series_id", F.col("event_ts").alias("known_ts")).agg(F.max(expiry).alias("expiry_ts"))
    return out(X.minutes_to_expiration(_grid(spark, d), facts), "value")


@query("c10_halt_status", f"{G}, st AS (SELECT series_id, event_ts AS k, min(CASE user_id % 3 WHEN 0 THEN 'HALT' ELSE 'open' END) AS s FROM tr GROUP BY 1, 2), m AS (SELECT g.series_id, g.t, arg_max(s, k) AS s FROM g LEFT JOIN st ON st.series_id = g.series_id AND k <= g.bar_start_ts + INTERVAL 3601 SECOND GROUP BY 1, 2) SELECT series_id, t, CASE WHEN s IS NULL THEN NULL WHEN s = 'HALT' THEN 1 ELSE 0 END::BIGINT AS value FROM m")
def c10(spark, d):
    status = F.when(F.col("user_id") % 3 == 0, "HALT").otherwise("open")
    facts = A.trades(spark, d).groupBy("series_id", F.col("event_ts").alias("known_ts")).agg(F.min(status).alias("status"))
    return out(X.halt_status(_grid(spark, d), facts), "value")


for _name, _quarter in (("c13_is_month_end_session", False), ("c14_is_quarter_end_session", True)):

    def _end(name=_name, quarter=_quarter):
        test = "AND month(td) % 3 = 0" if quarter else ""

        @query(name, f"{G}, {_CAL}, last AS (SELECT max(day) AS d FROM cal GROUP BY date_trunc('month', day)), y AS (SELECT min(year(day)) AS a, max(year(day)) AS b FROM cal) SELECT series_id, t, CASE WHEN year(td) BETWEEN a AND b THEN CAST(CASE WHEN td IN (SELECT d FROM last) {test} THEN 1 ELSE 0 END AS BIGINT) END AS value FROM g, y")
        def run(spark, d):
            return out(X.is_period_end_session(_grid(spark, d), _calendar(spark, d), quarter), "value")

    _end()

_bars("p1_prior_high_distance", lambda g: X.prior_distance(g, True, N), full("high", "close - max(high) OVER w"), W_P)
_bars("p2_prior_low_distance", lambda g: X.prior_distance(g, False, N), full("low", "close - min(low) OVER w"), W_P)
_bars("p3_opening_range_high_distance", lambda g: X.opening_range_distance(g, True, 120), "CASE WHEN session_label = 'RTH' THEN close - oh END", source="o", ctes=_OPEN)
_bars("p4_opening_range_low_distance", lambda g: X.opening_range_distance(g, False, 120), "CASE WHEN session_label = 'RTH' THEN close - ol END", source="o", ctes=_OPEN)
for _n, _high, _failed, _e in (
    ("p5_sweep_high", True, False, "high > max(high) OVER w"), ("p6_sweep_low", False, False, "low < min(low) OVER w"),
    ("p7_failed_high_breakout", True, True, "high > max(high) OVER w AND close <= max(high) OVER w"), ("p8_failed_low_breakout", False, True, "low < min(low) OVER w AND close >= min(low) OVER w"),
):
    _bars(_n, lambda g, h=_high, f=_failed: X.sweep(g, h, 3, failed=f), f"CASE WHEN close IS NOT NULL AND count(close) OVER w = 3 THEN CASE WHEN {_e} THEN 1 ELSE 0 END END", W_P.replace(f"{N} PRECEDING", "3 PRECEDING"), True)
_bars("p9_close_location_value", X.close_location, "(close - low) / nullif(high - low, 0)")
_bars("p10_wick_rejection_score", X.wick_rejection, "((least(open, close) - low) - (high - greatest(open, close))) / nullif(high - low, 0)")
_bars("p11_range_contraction", lambda g: X.range_contraction(g, 4), "CASE WHEN high > low AND count(close) OVER w = 4 AND avg(high - low) OVER w > 0 THEN 1 - (high - low) / avg(high - low) OVER w END", W_P.replace(f"{N} PRECEDING", "4 PRECEDING"))


@query("p12_quote_flag_merge", f"WITH {A.QUOTES} SELECT series_id, t, concat_ws(',', CASE WHEN h % 13 = 0 AND NOT missing THEN 'bbo_quarantined' END, CASE WHEN missing THEN 'missing_bbo' END, CASE WHEN high = low THEN 'zero_range' END) AS value_flags FROM quotes")
def p12(spark, d):
    return out(X.merge_quote_flags(X.close_location(A.bars(spark, d)), A.quotes(spark, d)), "value_flags")


# --- quotes


def _quotes(name, make, expr, integer=False, window="", ctes="", source="quotes"):
    value = f"CAST({expr} AS BIGINT)" if integer else f"round({expr}, 6)"

    @query(name, f"WITH {A.QUOTES}{ctes} SELECT series_id, t, {value} AS value FROM {source} {window}")
    def run(spark, d):
        return out(make(A.quotes(spark, d)), "value")


def v(e):
    return f"CASE WHEN valid THEN {e} END"


_quotes("q1_mid", lambda q: Q.quote_feature(q, Q.mid()), v("mid"))
_quotes("q2_spread", lambda q: Q.quote_feature(q, Q.spread()), v("spread"))
_quotes("q3_spread_ticks", Q.spread_ticks, v("spread / 0.01"))
_quotes("q4_spread_bps", lambda q: Q.quote_feature(q, Q.bps()), v("spread / mid * 10000"))
_quotes("q5_spread_zscore", lambda q: Q.spread_zscore(q, 5), "CASE WHEN count(x) OVER w = 5 AND max(x) OVER w > min(x) OVER w THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w END", window="WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", ctes=", q5 AS (SELECT *, CASE WHEN valid THEN spread END AS x FROM quotes)", source="q5")
_quotes("q6_bid_size", lambda q: Q.quote_feature(q, F.col("bid_size")), v("bid_size"))
_quotes("q7_ask_size", lambda q: Q.quote_feature(q, F.col("ask_size")), v("ask_size"))
_quotes("q8_top_book_depth", lambda q: Q.quote_feature(q, Q.depth()), v("bid_size + ask_size"))
_quotes("q9_top_book_imbalance", Q.imbalance, "CASE WHEN valid AND bid_size > 0 AND ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) END")
_quotes("q10_microprice", Q.microprice_feature, "CASE WHEN valid AND bid_size > 0 AND ask_size > 0 THEN (ask * bid_size + bid * ask_size) / (bid_size + ask_size) END")
_quotes("q11_microprice_minus_mid", lambda q: Q.microprice_feature(q, True), "CASE WHEN valid AND bid_size > 0 AND ask_size > 0 THEN (ask * bid_size + bid * ask_size) / (bid_size + ask_size) - mid END")
_quotes("q12_missing_bbo_flag", lambda q: Q.flag(q, Q.is_missing()), "CASE WHEN missing THEN 1 ELSE 0 END", True)
_quotes("q13_bad_quote_flag", lambda q: Q.flag(q, F.arrays_overlap("quality_flags", F.array(*[F.lit(x) for x in Q.BAD_FLAGS]))), "CASE WHEN missing OR h % 13 = 0 THEN 1 ELSE 0 END", True)
_quotes("q14_wide_spread_flag", lambda q: Q.threshold_flag(q, Q.bps() > 2.5), v("CASE WHEN spread / mid * 10000 > 2.5 THEN 1 ELSE 0 END"), True)
_quotes("q15_low_depth_flag", lambda q: Q.threshold_flag(q, Q.depth() < 5), v("CASE WHEN bid_size + ask_size < 5 THEN 1 ELSE 0 END"), True)
_quotes("b11_research_order", lambda q: Q.research_order(q, "event_ts").withColumn("value", F.col("position")), "row_number() OVER (PARTITION BY series_id ORDER BY available_ts, bar_end_ts)", True)

# --- book

_BK = f"""WITH {A.BOOK}, s AS (SELECT series_id, t, max(price) FILTER (side = 'bid' AND book_level = 1) AS b1, max(price) FILTER (side = 'ask' AND book_level = 1) AS a1, max(size) FILTER (side = 'bid' AND book_level = 1) AS bs, max(size) FILTER (side = 'ask' AND book_level = 1) AS az,
  sum(size) FILTER (side = 'bid') AS bd, sum(size) FILTER (side = 'ask') AS ad, max(order_count) FILTER (side = 'bid' AND book_level = 1) AS bo, max(order_count) FILTER (side = 'ask' AND book_level = 1) AS ao FROM book GROUP BY 1, 2)"""


def _book(name, columns):
    @query(name, f"{_BK} SELECT series_id, t, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM s")
    def run(spark, d):
        return out(Q.book_features(A.book(spark, d)), *columns)


_book("b1_top_of_book_spread", {"spread": "round(a1 - b1, 6)", "book_flags": "CASE WHEN a1 IS NULL THEN 'missing_ask' ELSE '' END"})
_book("b2_b4_depth_imbalance", {"depth_imbalance": "round((bd - ad) / (bd + ad), 6)"})
_book("b3_top1_imbalance", {"top1_imbalance": "round((bs - az) / (bs + az), 6)"})
_book("b5_depth_by_side", {"bid_depth": "bd", "ask_depth": "ad"})
_book("b6_order_count_by_level", {"bid_orders": "bo", "ask_orders": "ao"})
_book("b7_microprice", {"microprice": "round((a1 * bs + b1 * az) / (bs + az), 6)"})
_book("b9_liquidity_tag", {"liquidity_tag": "CASE WHEN a1 IS NULL THEN 'incomplete' WHEN a1 - b1 <= 0.02 AND bd + ad >= 100 THEN 'tight_deep' ELSE 'wide_or_shallow' END"})


@query("b8_quote_update_intensity", f"WITH {A.TRADES} SELECT a.event_id, (SELECT count(*) FROM tr b WHERE b.series_id = a.series_id AND b.event_ts > a.event_ts - INTERVAL 1800 SECOND AND (b.event_ts, b.event_id) <= (a.event_ts, a.event_id)) AS updates FROM tr a")
def b8(spark, d):
    return Q.update_intensity(A.trades(spark, d), seconds=1800).select("event_id", "updates")


@query("b10_book_validation", f"WITH {A.BOOK} SELECT issue, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN book_level > 4 THEN ['bad_level'] ELSE [] END, CASE WHEN price <= 0 THEN ['bad_price'] ELSE [] END, CASE WHEN size <= 0 THEN ['bad_size'] ELSE [] END)) AS issue FROM book) GROUP BY 1")
def b10(spark, d):
    return Q.book_issues(A.book(spark, d), 4).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


# --- cross-market: ES is click, NQ view, RTY purchase

MARKETS = {"ES": "click", "NQ": "view", "RTY": "purchase"}
_XM = f"WITH {A.GRID}, rr AS (SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY t) - 1 AS r FROM grid), es AS (SELECT * FROM rr WHERE series_id = 'click' AND has_trade), nq AS (SELECT * FROM rr WHERE series_id = 'view' AND has_trade), ry AS (SELECT * FROM rr WHERE series_id = 'purchase' AND has_trade), al AS (SELECT es.t, es.r AS e, nq.r AS n, ry.r AS y FROM es JOIN nq USING (t) JOIN ry USING (t))"


def _aligned(spark, d):
    g = A.grid(spark, d).withColumn("r", W.simple_returns(W.Series(), "close").value).filter("has_trade")
    return Q.strict_alignment(g, MARKETS)


def _t(df, *cols):
    kinds = dict(df.dtypes)
    return df.select((F.unix_timestamp("event_ts") - 3600).alias("t"), *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in cols])


def _cross(name, columns):
    @query(name, f"{_XM} SELECT t, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM al")
    def run(spark, d):
        return _t(Q.cross_features(_aligned(spark, d)), *columns)


_ALL = "e IS NOT NULL AND n IS NOT NULL AND y IS NOT NULL"
_cross("x1_strict_alignment", {"ES": "round(e, 6)", "NQ": "round(n, 6)", "RTY": "round(y, 6)"})
_cross("x4_nq_minus_es", {"nq_minus_es": "round(n - e, 6)"})
_cross("x5_rty_minus_es", {"rty_minus_es": "round(y - e, 6)"})
_cross("x10_confirmation", {"confirmation": f"CASE WHEN {_ALL} THEN CAST((e > 0 AND n > 0 AND y > 0) OR (e < 0 AND n < 0 AND y < 0) AS BIGINT) END"})
_cross("x11_divergence", {"divergence": f"CASE WHEN {_ALL} THEN CAST((e > 0 OR n > 0 OR y > 0) AND (e < 0 OR n < 0 OR y < 0) AS BIGINT) END"})
_cross("x12_risk_on", {"risk_on": f"CASE WHEN {_ALL} THEN round((n - e + y - e) / 2, 6) END"})
_cross("x13_risk_off", {"risk_off": f"CASE WHEN {_ALL} THEN round(-(n - e + y - e) / 2, 6) END"})


@query("x2_as_of_alignment", f"""WITH {A.GRID}, rr AS (SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY t) - 1 AS r FROM grid) WHERE has_trade AND series_id IN ('click', 'view', 'purchase')), ts AS (SELECT DISTINCT t FROM rr)
SELECT ts.t, {', '.join(f"round((SELECT arg_max(r, rr.t) FROM rr WHERE series_id = '{n}' AND rr.t = (SELECT max(t) FROM rr z WHERE z.series_id = '{n}' AND z.t <= ts.t)), 6) AS {m}" for m, n in MARKETS.items())} FROM ts""")
def x2(spark, d):
    g = A.grid(spark, d).withColumn("r", W.simple_returns(W.Series(), "close").value).filter("has_trade")
    return Q.as_of_alignment(g, MARKETS).select((F.unix_timestamp("available_ts") - 3601).alias("t"), *[F.round(m, 6).alias(m) for m in MARKETS])


@query("x3_synchronized_returns", f"{_XM} SELECT t, market, round(r, 6) AS r FROM (SELECT t, unnest(['ES', 'NQ', 'RTY']) AS market, unnest([e, n, y]) AS r FROM al WHERE {_ALL})")
def x3(spark, d):
    return Q.cross_features(_aligned(spark, d)).select((F.unix_timestamp("event_ts") - 3600).alias("t"), F.explode("returns").alias("market", "r")).select("t", "market", F.round("r", 6).alias("r"))


for _i, _m, _c in ((6, "NQ", "n"), (7, "RTY", "y")):

    def _pair(i=_i, m=_m, c=_c):
        win = "WINDOW w AS (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
        fine = f"count(*) OVER w = 10 AND count(e) OVER w = 10 AND count({c}) OVER w = 10"

        @query(f"x{i}_{m.lower()}_beta_residual", f"{_XM} SELECT t, CASE WHEN {fine} THEN round({c} - covar_samp({c}, e) OVER w / nullif(var_samp(e) OVER w, 0) * e, 6) END AS beta_residual FROM al {win}")
        def residual(spark, d):
            return _t(Q.rolling_pair(_aligned(spark, d), m, "ES", 10), "beta_residual")

        @query(f"x{i + 2}_{m.lower()}_correlation", f"{_XM} SELECT t, CASE WHEN {fine} THEN round(covar_samp({c}, e) OVER w / nullif(sqrt(var_samp({c}) OVER w * var_samp(e) OVER w), 0), 6) END AS correlation FROM al {win}")
        def correlation(spark, d):
            return _t(Q.rolling_pair(_aligned(spark, d), m, "ES", 10), "correlation")

    _pair()


@query("j5_as_of_join", f"WITH {A.QUOTES} SELECT x.event_id, (SELECT round(arg_max(q.bid, q.t), 6) FROM quotes q WHERE q.series_id = x.series_id AND q.available_ts <= x.event_ts AND q.t = (SELECT max(z.t) FROM quotes z WHERE z.series_id = x.series_id AND z.available_ts <= x.event_ts)) AS bid_as_of FROM tr x")
def j5(spark, d):
    return Q.as_of_join(A.trades(spark, d), A.quotes(spark, d), "series_id", "event_ts", "available_ts", ["bid", "ask"]).select("event_id", F.round("bid_as_of", 6).alias("bid_as_of"))


@query("ses2_dst_classification", "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) SELECT CAST(day AS VARCHAR) AS day, hour(((day::TIMESTAMP + INTERVAL 13 HOUR + INTERVAL 45 MINUTE) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago') = 8 AS rth FROM d")
def ses2_dst(spark, d):
    """13:45 UTC is 08:45 in summer, in RTH, and 07:45 in winter, outside."""
    days = A.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    at = F.col("day").cast("timestamp") + F.expr("interval 825 minutes")
    return days.select(F.col("day").cast("string").alias("day"), (S.session_label(at) == "RTH").alias("rth"))
