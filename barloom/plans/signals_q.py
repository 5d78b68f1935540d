"""Registered queries of signals, costs, sizing, probes, grids and user code."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import signals as G
from barloom.operators import statistics as S
from barloom.plans import adapters as A
from barloom.plans.diagnostics_q import fixed
from barloom.plans.observations import OBS, factors, observations
from barloom.plans.registry import query
from barloom.plans.windows_q import out

_ONE = f"{OBS}, o1 AS (SELECT * FROM obs WHERE horizon_seconds = 3600)"


def _one(spark, d):
    return observations(spark, d).filter("horizon_seconds = 3600")


@query("g1_threshold_signal", f"WITH {_ONE} SELECT series_id, CASE WHEN f >= 0.02 THEN 'ENTRY' WHEN f <= -0.02 THEN 'EXIT' ELSE 'HOLD' END AS signal, count(*) AS n FROM o1 GROUP BY 1, 2")
def g1(spark, d):
    return _one(spark, d).groupBy("series_id", G.threshold_signal("f", 0.02, -0.02).alias("signal")).agg(F.count("*").alias("n"))


@query("g2_context_trigger_signal", f"WITH {_ONE} SELECT series_id, CASE WHEN coalesce(liquidity >= 10 AND f > 0.01, false) THEN 'ENTRY' ELSE 'HOLD' END AS signal, count(*) AS n, sum(CASE WHEN coalesce(liquidity >= 10 AND f > 0.01, false) THEN 0.5 ELSE 0 END)::DOUBLE AS exposure FROM o1 GROUP BY 1, 2")
def g2(spark, d):
    r = G.context_trigger_signal(_one(spark, d), S.predicate("liquidity", ">=", 10.0), S.predicate("f", ">", 0.01), 0.5)
    return r.groupBy("series_id", "signal").agg(F.count("*").alias("n"), F.sum("desired_exposure").alias("exposure"))


@query("g3_late_signals", f"WITH {A.BARS} SELECT series_id, t FROM bars WHERE (t // 3600) % 8 = 0")
def g3(spark, d):
    f = factors(spark, d)
    sig = f.select("series_id", "t", F.when(F.col("t") / 3600 % 8 == 0, F.col("event_ts")).otherwise(F.col("available_ts")).alias("signal_ts"))
    return G.late_signals(sig, f, ["series_id", "t"]).select("series_id", "t")


_POS = """{one}, ds AS (SELECT *, CASE WHEN coalesce(f, 0) >= th THEN 1 WHEN coalesce(f, 0) <= -th THEN -1 ELSE 0 END AS des FROM o1, (SELECT unnest([0.01, 0.02, 0.03]::DOUBLE[]) AS th)),
ps AS (SELECT *, coalesce(lag(des) OVER w, 0) AS pos FROM ds WINDOW w AS (PARTITION BY series_id, th ORDER BY t)), dl AS (SELECT *, pos - coalesce(lag(pos) OVER w, 0) AS dp, sum(pos * y) OVER w AS run FROM ps WINDOW w AS (PARTITION BY series_id, th ORDER BY t)),
pk AS (SELECT *, greatest(max(run) OVER (PARTITION BY series_id, th ORDER BY t), 0) AS pk FROM dl), su AS (SELECT series_id, th AS threshold, count(*) AS bars, sum(abs(dp))::BIGINT AS turnover, count(*) FILTER (dp <> 0) AS trades, sum(pos * y) AS gross, max(pk - run) AS drawdown FROM pk GROUP BY 1, 2)""".replace("{one}", _ONE)


def _positions(spark, d):
    o = G.with_grid(_one(spark, d), threshold=[0.01, 0.02, 0.03])
    return G.next_bar_positions(o, ["series_id", "threshold"], "t", 1)


def _summary(spark, d):
    return G.position_summary(_positions(spark, d), ["series_id", "threshold"], "t")


@query("g4_next_bar_positions", f"WITH {_POS} SELECT series_id, threshold, bars, turnover, trades, round(gross, 6) AS gross, round(CASE WHEN trades > 0 THEN gross / trades END, 6) AS expectancy, round(drawdown, 6) AS drawdown FROM su")
def g4(spark, d):
    return fixed(_summary(spark, d).drop("late_signals"))


@query("g5_threshold_sweep", f"WITH {_POS} SELECT series_id, count(*) AS thresholds, round(min(gross), 6) AS worst, round(max(gross), 6) AS best, round(avg(CAST(gross > 0 AS INT)), 6) AS positive_share FROM su GROUP BY 1")
def g5(spark, d):
    return fixed(G.sweep_stability(_summary(spark, d), ["series_id"]))


# fills are order lines: price, quantity, spread a share of the price, side by the return flag, session by the line's ship mode

_FILLS = "fills AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice / l_quantity AS price, l_quantity AS quantity, 1.0::DOUBLE AS multiplier, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / l_quantity * l_tax / 100 END AS spread, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, CASE l_returnflag WHEN 'A' THEN 'RTH' WHEN 'N' THEN 'ETH' ELSE 'ILLIQUID' END AS session, 'S' || (l_suppkey % 5) AS symbol, l_shipdate FROM lineitem)"


def _fills(spark, d):
    x = A.table(spark, d, "lineitem")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return x.select(
        "l_orderkey", "l_linenumber", "l_suppkey", p.alias("price"), F.col("l_quantity").alias("quantity"), F.lit(1.0).alias("multiplier"), F.when(F.col("l_linenumber") != 3, p * F.col("l_tax") / 100).alias("spread"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.when(F.col("l_returnflag") == "A", "RTH").when(F.col("l_returnflag") == "N", "ETH").otherwise("ILLIQUID").alias("session"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("symbol"), "l_shipdate",
    )


def _cost(name, make, expr, frame=None):
    @query(name, f"WITH {_FILLS} SELECT l_suppkey, count(*) AS fills, round(sum({expr}), 4) AS total FROM fills GROUP BY 1")
    def run(spark, d):
        f = _fills(spark, d)
        f = frame(spark, f) if frame else f
        return f.withColumn("c", make()).groupBy("l_suppkey").agg(F.count("*").alias("fills"), F.round(F.sum("c"), 4).alias("total"))


_cost("g6a_fixed_commission", lambda: G.fixed_commission(1.5), "1.5::DOUBLE")
_cost("g6b_per_unit_commission", lambda: G.per_unit_commission(0.25), "0.25::DOUBLE * quantity")
_cost("g6c_bps_cost", lambda: G.bps_cost(2.0, 5.0), "greatest(price * quantity * 2.0::DOUBLE / 1e4, 5.0::DOUBLE)")
_cost("g6d_spread_cost", lambda: G.spread_cost(True), "coalesce(spread, 0) * 0.5::DOUBLE * quantity")


def _schedule(spark, f):
    # fees follow the symbol's number, so they are derived from the fills' own symbols
    s = f.select("symbol").distinct().withColumn("n", F.substring("symbol", 2, 1).cast("int"))
    rows = s.select("symbol", F.explode(F.array(F.struct(F.lit("v2").alias("version"), F.lit("exchange").alias("component"), (0.5 + F.col("n") * 0.1).alias("fee")), F.struct(F.lit("v2").alias("version"), F.lit("clearing").alias("component"), F.lit(0.25).alias("fee")), F.struct(F.lit("v1").alias("version"), F.lit("exchange").alias("component"), F.lit(9.0).alias("fee")))).alias("x")).select("symbol", "x.*")
    return G.futures_fees(f, rows, "v2")


_cost("g6e_futures_fees", lambda: F.col("fee"), "(0.75 + 0.1 * (l_suppkey % 5)) * quantity", _schedule)
_cost("g6f_composite_cost", lambda: G.composite_cost(commission=G.per_unit_commission(0.25), bps=G.bps_cost(2.0, 5.0), spread=G.spread_cost())[0], "0.25::DOUBLE * quantity + greatest(price * quantity * 2.0::DOUBLE / 1e4, 5.0::DOUBLE) + coalesce(spread, 0) * 0.5::DOUBLE * quantity")
_SIDE = "CASE WHEN side = 'buy' THEN 1 ELSE -1 END"
_cost("g7a_bps_slippage", lambda: G.bps_slippage(3.0), f"price * (1 + {_SIDE} * 3.0::DOUBLE / 1e4)")
_cost("g7b_spread_slippage", lambda: G.spread_slippage(0.25, 2.0), f"price + {_SIDE} * coalesce(spread * 0.25::DOUBLE, price * 2.0::DOUBLE / 1e4)")
_cost("g7d_composite_slippage", lambda: G.composite_slippage(F.lit(1.0), F.coalesce(F.col("spread") / F.col("price") * 1e4, F.lit(0.0))), f"price * (1 + {_SIDE} * (1.0::DOUBLE + coalesce(spread / price * 1e4, 0)) / 1e4)")


def _user_proxy(quantity, price):
    return 0.1 * quantity + price / price.clip(lower=1000.0)


_cost("g7c_user_slippage", lambda: G.proxy_slippage(_user_proxy, "quantity", "price"), f"price * (1 + {_SIDE} * (0.1::DOUBLE * quantity + price / greatest(price, 1000.0::DOUBLE)) / 1e4)")


@query("g8a_participation_cap", f"WITH {A.BARS} SELECT series_id, t, round(least(1.5::DOUBLE, volume * 0.1::DOUBLE), 6) AS filled, round(least(1.5::DOUBLE, volume * 0.1::DOUBLE) / volume, 6) AS participation FROM bars")
def g8a(spark, d):
    filled, rate = G.participation_cap("requested", "volume")
    return out(A.bars(spark, d).withColumn("requested", F.lit(1.5)).withColumn("filled", filled).withColumn("participation", rate), "filled", "participation")


@query("g8b_liquidity_policy", f"WITH {A.GRID} SELECT series_id, t, CASE WHEN coalesce(volume, 0) <= 0 THEN 'no_liquidity' WHEN 1.5 > volume * 0.1::DOUBLE THEN 'capped' ELSE 'ok' END AS flag, round(CASE WHEN coalesce(volume, 0) <= 0 THEN 0 ELSE least(1.5::DOUBLE, volume * 0.1::DOUBLE) END, 6) AS filled, CASE WHEN volume > 0 AND 1.5 > volume * 0.1::DOUBLE THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS penalty_bps FROM grid")
def g8b(spark, d):
    filled, flag, penalty = G.liquidity_policy("requested", "volume", penalty_bps=4.0)
    return out(A.grid(spark, d).withColumn("requested", F.lit(1.5)).withColumn("flag", flag).withColumn("filled", filled).withColumn("penalty_bps", penalty), "flag", "filled", "penalty_bps")


@query("g9_cost_stress", f"WITH {_FILLS}, b AS (SELECT session, count(*) AS fills, sum(0.25::DOUBLE * quantity * CASE session WHEN 'RTH' THEN 1.0 WHEN 'ETH' THEN 1.5 ELSE 2.0 END) AS s FROM fills GROUP BY 1) SELECT session, profile, fills, round(s * profile, 4) AS cost, round(s * (profile - 1), 4) AS gradient FROM b, (SELECT unnest([1.0, 1.25, 1.5, 2.0]::DOUBLE[]) AS profile)")
def g9(spark, d):
    r = G.cost_stress(_fills(spark, d).withColumn("c", G.per_unit_commission(0.25)), "c", [])
    return r.select("session", "profile", "fills", F.round("cost", 4).alias("cost"), F.round("gradient", 4).alias("gradient"))


@query("g10_position_sizing", f"WITH {A.BARS} SELECT series_id, t, floor(20000.0::DOUBLE / close) AS quantity, CASE WHEN high > low AND 1000.0::DOUBLE * close / (high - low) >= 500 THEN floor(1000.0::DOUBLE * close / (high - low) / close) ELSE CASE WHEN high > low THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END END AS risk_quantity FROM bars")
def g10(spark, d):
    b = A.bars(spark, d).withColumns({"price": F.col("close"), "equity": F.lit(100000.0), "desired_exposure": F.lit(1.0), "stop": F.nullif(F.col("high") - F.col("low"), F.lit(0.0))})
    return out(b.withColumn("quantity", G.fixed_notional_size(20000.0)[1]).withColumn("risk_quantity", G.risk_size("equity", 0.01, "stop", 500.0)[1]), "quantity", "risk_quantity")


_TG = f"{A.UNIVERSE}, tg AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END) AS x FROM lineitem GROUP BY 1, 2), g1 AS (SELECT *, x * least(1, 150000.0::DOUBLE / sum(abs(x)) OVER (PARTITION BY day)) AS n FROM tg), g2 AS (SELECT *, n * least(1, coalesce(60000.0::DOUBLE / nullif(abs(sum(n) OVER (PARTITION BY day)), 0), 1)) AS target FROM g1)"


@query("g11_exposure_scaling", f"WITH {_TG}, j AS (SELECT g2.*, sector, asset_class FROM g2 JOIN universe ON instrument_id = l_suppkey) SELECT CAST(day AS VARCHAR) AS day, 'asset_class' AS level, asset_class AS name, round(sum(abs(target)), 4) AS gross, round(sum(target), 4) AS net FROM j GROUP BY 1, 3 UNION ALL SELECT CAST(day AS VARCHAR), 'sector', sector, round(sum(abs(target)), 4), round(sum(target), 4) FROM j GROUP BY 1, 3")
def g11(spark, d):
    x = A.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), "l_suppkey").agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))).alias("notional"))
    t = G.scale_exposure(x.withColumn("equity", F.lit(100000.0)), ["day"], "notional", "equity", 1.5, 0.6)
    u = A.universe(spark, d).select(F.col("instrument_id").alias("l_suppkey"), "sector", "asset_class")
    e = G.exposure_by(t.join(u, "l_suppkey"), ["day"], ["asset_class", "sector"])
    return e.select(F.col("day").cast("string").alias("day"), "level", "name", F.round("gross", 4).alias("gross"), F.round("net", 4).alias("net"))


_PL = "pl0 AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_custkey % 40 AS instrument_id, o_totalprice AS notional, CASE WHEN o_custkey % 4 = 0 THEN -1 ELSE 1 END AS side FROM orders), pl1 AS (SELECT *, row_number() OVER (PARTITION BY day, instrument_id ORDER BY k) > 1 AS rep FROM pl0), pl2 AS (SELECT *, CASE WHEN NOT rep THEN sum(CASE WHEN rep THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY k) END AS a FROM pl1), pl3 AS (SELECT *, CASE WHEN rep THEN 'repeated_instrument' WHEN a > 6 THEN 'max_active_instruments' END AS r0, CASE WHEN rep OR a > 6 THEN 0 ELSE least(notional, 100000.0::DOUBLE) END AS x0 FROM pl2), pl4g AS (SELECT *, x0 * least(1, coalesce(400000.0::DOUBLE / nullif(sum(x0) OVER (PARTITION BY day), 0), 1)) AS xg FROM pl3), pl4 AS (SELECT *, xg * least(1, coalesce(250000.0::DOUBLE / nullif(abs(sum(xg * side) OVER (PARTITION BY day)), 0), 1)) AS x FROM pl4g), pl5 AS (SELECT *, least(x, greatest(350000.0::DOUBLE - coalesce(sum(x) OVER (PARTITION BY day ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS al FROM pl4)"


@query("g12_portfolio_limits", f"WITH {_PL} SELECT k, round(al, 4) AS allocated, CASE WHEN r0 IS NULL AND al < x THEN 'insufficient_capital' ELSE r0 END AS reason FROM pl5")
def g12(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 40).alias("instrument_id"), F.col("o_totalprice").alias("notional"), F.when(F.col("o_custkey") % 4 == 0, -1).otherwise(1).alias("side"))
    r = G.portfolio_limits(o, ["day"], "k", 1_000_000.0, 6, 0.1, 0.4, 350_000.0, 0.25, "side")
    return r.select("k", F.round("allocated", 4).alias("allocated"), "reason")


_EQ = f"{A.BARS}, e AS (SELECT *, close / lag(close) OVER w - 1 AS r, t - lag(t) OVER w AS gap, (max(close) OVER w - close) / max(close) OVER w AS dd FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY t))"


@query("g13_equity_metrics", f"WITH {_EQ} SELECT series_id, count(r) AS n, quantile_cont(gap, 0.5)::DOUBLE AS cadence_seconds, round(max(dd), 6) AS max_drawdown, round(last(close ORDER BY t), 6) AS final_equity, round(avg(r) / stddev_pop(r) * sqrt(31536000 / quantile_cont(gap, 0.5)), 6) AS sharpe FROM e GROUP BY 1")
def g13(spark, d):
    return fixed(G.equity_metrics(A.bars(spark, d), ["series_id"], "t", "close", "t"))


_GR = _POS + ", lb AS (SELECT series_id || ':' || CAST(CAST(threshold * 100 AS INT) AS VARCHAR) AS config_id, gross - turnover * 0.0005::DOUBLE AS net, 1 + gross AS final_equity, turnover * 0.0005::DOUBLE AS costs FROM su)"


@query("g14_grid_leaderboard", f"WITH {_GR} SELECT config_id, round(net, 6) AS net, round(final_equity, 6) AS final_equity, round(costs, 6) AS costs FROM lb ORDER BY net DESC, lb.final_equity DESC, lb.costs, config_id LIMIT 8")
def g14(spark, d):
    costs = F.col("turnover") * 0.0005
    r = _summary(spark, d).select(F.concat_ws(":", "series_id", F.round(F.col("threshold") * 100).cast("int").cast("string")).alias("config_id"), (F.col("gross") - costs).alias("net"), (1 + F.col("gross")).alias("final_equity"), costs.alias("costs"))
    return fixed(G.leaderboard(r, 8))


def _periods_sql(grain, key):
    return f"""SELECT series_id, threshold, '{grain}' AS grain, period, bars, trades, turnover, round(gross, 6) AS gross, round(net, 6) AS net, round(1 + sum(net) OVER (PARTITION BY series_id, threshold ORDER BY period), 6) AS final_equity, round(drawdown, 6) AS drawdown
FROM (SELECT series_id, th AS threshold, period, count(*) AS bars, count(*) FILTER (dp <> 0) AS trades, sum(abs(dp))::BIGINT AS turnover, sum(pos * y) AS gross, sum(pos * y) - sum(abs(dp)) * 0.0005::DOUBLE AS net, max(greatest(peak, 0) - run) AS drawdown
  FROM (SELECT *, max(run) OVER (PARTITION BY series_id, th, period ORDER BY t) AS peak FROM (SELECT * EXCLUDE (run), sum(pos * y) OVER (PARTITION BY series_id, th, period ORDER BY t) AS run FROM (SELECT *, {key} AS period FROM dl))) GROUP BY 1, 2, 3)"""


@query("g14_period_results", f"WITH {_POS} {_periods_sql('month', "strftime(bar_end_ts, '%Y-%m')")} UNION ALL {_periods_sql('week', "strftime(bar_end_ts, '%G-W%V')")} UNION ALL {_periods_sql('total', "''")}")
def g14_periods(spark, d):
    """Every configuration by month, by week and over all, combined from the states of its days."""
    return fixed(G.period_results(_positions(spark, d), ["series_id", "threshold"], "event_ts", "t", ("month", "week"), cost=0.0005))


_EN = f"""{A.BARS}, nb AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k, count(*) OVER (PARTITION BY series_id) AS total, CAST(bar_start_ts AS DATE) AS day,
  greatest(close * 0.95::DOUBLE, close - 1.0::DOUBLE * (high - low + 1)) AS sp FROM bars), en AS (SELECT *, close + (close - sp) * 1.5::DOUBLE AS tp, max(k) OVER (PARTITION BY series_id, day) AS ends FROM nb),
hit AS (SELECT e.series_id, e.t, min(f.k) AS hk FROM en e JOIN nb f ON f.series_id = e.series_id AND f.k > e.k AND f.k <= least(e.k + 5, e.ends) AND (f.low <= e.sp OR f.high >= e.tp) GROUP BY 1, 2),
xt AS (SELECT e.*, f.k AS hk, f.low AS flow, least(e.k + 5, e.ends) AS lk FROM en e LEFT JOIN hit h USING (series_id, t) LEFT JOIN nb f ON f.series_id = e.series_id AND f.k = h.hk)"""


@query("g16_first_touch_exits", f"""WITH {_EN}
SELECT x.series_id, x.t, CASE WHEN x.hk IS NOT NULL THEN CASE WHEN x.flow <= x.sp THEN 'stop' ELSE 'target' END WHEN x.k + 5 <= x.ends THEN 'time' WHEN x.lk > x.k OR x.lk < x.total THEN 'session_end' END AS exit,
  round(CASE WHEN x.hk IS NOT NULL THEN CASE WHEN x.flow <= x.sp THEN x.sp ELSE x.tp END WHEN x.lk > x.k OR x.lk < x.total THEN l.close END, 6) AS exit_price
FROM xt x JOIN nb l ON l.series_id = x.series_id AND l.k = x.lk""")
def g16(spark, d):
    """Long entries of every bar with two stops, a target, five bars to hold and an exit at the end of the UTC day."""
    c = F.col("close")
    b = A.bars(spark, d).withColumn("day", F.to_date("bar_start_ts"))
    r = G.first_touch_exits(b, 5, [c * 0.95, c - 1.0 * (F.col("high") - F.col("low") + 1)], 1.5, session="day")
    return out(r, "exit", "exit_price")


def _momentum(inputs):
    return inputs["close"].rolling(4).mean() - inputs["close"].rolling(9).mean()


_UF = "CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY t) > 10 THEN round(avg(close) OVER a - avg(close) OVER b, 6) END"


@query("udf1_user_factor", f"WITH {A.BARS} SELECT series_id, t, {_UF} AS value, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY t) <= 10 THEN 'warm_up' ELSE '' END AS value_flags FROM bars WINDOW a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)")
def udf1(spark, d):
    return out(G.apply_user_factor(A.bars(spark, d), _momentum, ["close"], ["series_id"], "t", 10), "value", "value_flags")


@query("win20_factor_driver", f"WITH {A.BARS} SELECT series_id, t, {_UF} AS value, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY t) > 10 AND count(*) OVER z = 12 AND max(u) OVER z > min(u) OVER z THEN 1 ELSE 0 END::BIGINT AS has_normalized FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS u FROM bars) WINDOW a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), z AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)".replace("count(*) OVER z = 12", "u >= 16"))
def win20(spark, d):
    """User factor with its point-in-time normalisation over 12 rows, of which 6 must have a value."""
    u = G.apply_user_factor(A.bars(spark, d), _momentum, ["close"], ["series_id"], "t", 10)
    n = u.withColumn("normalized", W.pit_normalize(W.Series(order=("t",)), "value", 12, 6))
    return out(n.withColumn("has_normalized", F.col("normalized").isNotNull().cast("long")), "value", "has_normalized")


@query("udf3_user_predicate", f"WITH {_ONE} SELECT series_id, count(*) FILTER (f > 0.01) AS above, count(*) FILTER (liquidity <= 9) AS thin, count(*) FILTER (regime = 'calm') AS calm FROM o1 GROUP BY 1")
def udf3(spark, d):
    p = S.predicate
    return _one(spark, d).groupBy("series_id").agg(F.count_if(p("f", ">", 0.01)).alias("above"), F.count_if(p("liquidity", "<=", 9.0)).alias("thin"), F.count_if(p("regime", "==", "calm")).alias("calm"))


@query("win_halo_chunks", f"WITH {A.GRID} SELECT series_id, t, CASE WHEN count(close) OVER w = 12 THEN round(avg(close) OVER w, 6) END AS value FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def halo(spark, d):
    """A rolling mean of long series cut into days that carry the twelve hours before them."""
    g = W.with_halo(A.grid(spark, d), "bar_start_ts", "chunk", 12 * 3600, 86400)
    r = g.select("*", *W.rolling_mean(W.Series(("series_id", "chunk")), "close", 12).named()).filter("not in_halo")
    return out(r, "value")
