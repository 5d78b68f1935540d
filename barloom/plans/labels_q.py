"""Registered queries of the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import sessions as S
from barloom.functions import windows as W
from barloom.operators import features as X
from barloom.operators import labels as L
from barloom.operators import quotes as Q
from barloom.plans import adapters as A
from barloom.plans.registry import query
from barloom.plans.windows_q import _CAL, _SEG, _calendar, out

HORIZONS = [60, 180, 600]
_CROSS = "EXISTS (SELECT 1 FROM generate_series(0, 2) g(k) WHERE a0 < CAST(a0 AS DATE)::TIMESTAMP + to_days(CAST(k AS INT)) + INTERVAL 17 HOUR AND b0 > CAST(a0 AS DATE)::TIMESTAMP + to_days(CAST(k AS INT)) + INTERVAL 16 HOUR AND CAST(a0 AS DATE) + CAST(k AS INT) <= CAST(b0 AS DATE))"


def _fwd(table, col):
    return f"""j AS (SELECT a.series_id, a.t, hz AS horizon, a.{col} AS x0, b.{col} AS x1, b.t AS t1, a.bar_end_ts - INTERVAL 6 HOUR AS a0, b.bar_end_ts - INTERVAL 6 HOUR AS b0 FROM {table} a, (SELECT unnest([60, 180, 600]) AS hz) JOIN {table} b ON b.series_id = a.series_id AND b.t = a.t + hz * 60)"""


def _lab(df, *cols):
    return out(df.withColumn("horizon", F.col("horizon").cast("long")), "horizon", *cols)


@query("l1_forward_returns", f"WITH {A.BARS}, {_fwd('bars', 'close')} SELECT series_id, t, CAST(horizon AS BIGINT) AS horizon, round(x1 / x0 - 1, 6) AS value FROM j WHERE NOT {_CROSS}")
def l1(spark, d):
    return _lab(L.forward_returns(A.bars(spark, d), HORIZONS), "value")


@query("l2_mid_forward_returns", f"WITH {A.QUOTES}, qv AS (SELECT *, CASE WHEN valid THEN mid END AS m FROM quotes), {_fwd('qv', 'm')} SELECT series_id, t, CAST(horizon AS BIGINT) AS horizon, round(x1 / x0 - 1, 6) AS value, CASE WHEN x0 IS NULL OR x1 IS NULL THEN 'invalid_quote' ELSE '' END AS value_flags FROM j WHERE NOT {_CROSS}")
def l2(spark, d):
    return _lab(L.mid_forward_returns(A.quotes(spark, d), HORIZONS, Q.valid()), "value", "value_flags")


def _close_out(name, cutoff, first):
    lo = f"AND m > {first}" if first is not None else ""

    @query(name, f"""WITH {A.BARS}, x AS (SELECT *, CAST(bar_start_ts - INTERVAL 6 HOUR AS DATE) + CASE WHEN hour(bar_start_ts - INTERVAL 6 HOUR) >= 17 THEN 1 ELSE 0 END AS td, (hour(bar_start_ts - INTERVAL 6 HOUR) + 1) * 60 AS m FROM bars),
y AS (SELECT series_id, td, max(t) AS t1, arg_max(close, t) AS c1 FROM x WHERE m <= {cutoff} {lo} GROUP BY 1, 2) SELECT series_id, t, round(c1 / close - 1, 6) AS value, t1 FROM x JOIN y USING (series_id, td) WHERE t < t1""")
    def run(spark, d):
        r = L.close_out_returns(A.bars(spark, d), cutoff, first).withColumn("t1", F.unix_timestamp("horizon_end_ts") - 3600)
        return out(r, "value", "t1")


_close_out("l3_session_close", 900, 510)
_close_out("l4_maintenance_flat", 960, None)


@query("l5_guards", f"WITH {A.BARS}, {_fwd('bars', 'close')} SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS kept FROM j WHERE NOT {_CROSS} GROUP BY 1")
def l5(spark, d):
    return L.guarded(L.terminals(A.bars(spark, d), HORIZONS, ["close"])).groupBy(F.col("horizon").cast("long").alias("horizon")).agg(F.count("*").alias("kept"))


def _cost(name, bps):
    @query(name, f"""WITH {A.QUOTES}, qv AS (SELECT *, CASE WHEN valid THEN mid END AS m, CASE WHEN valid THEN spread END AS sp FROM quotes)
SELECT a.series_id, a.t, CAST(hz AS BIGINT) AS horizon, round(b.m / a.m - 1 - ({bps} / 1e4 + 0.5 * a.sp / a.m + 0.5 * b.sp / b.m), 6) AS value, CASE WHEN a.m IS NULL THEN 'invalid_entry_quote' WHEN b.m IS NULL THEN 'invalid_exit_quote' ELSE '' END AS value_flags
FROM qv a, (SELECT unnest([60, 180, 600]) AS hz) JOIN qv b ON b.series_id = a.series_id AND b.t = a.t + hz * 60""")
    def run(spark, d):
        return _lab(L.cost_adjusted_returns(L.collapse_quotes(A.quotes(spark, d)), HORIZONS, Q.valid(), bps), "value", "value_flags")


_cost("l6_cost_adjusted_forward_returns", 1.0)
_cost("l7_spread_adjusted_forward_returns", 0.0)


@query("l6b_quote_key_collapse", f"WITH {A.QUOTES}, tq AS (SELECT series_id, bar_start_ts, event_id, row_number() OVER (PARTITION BY series_id, date_trunc('hour', event_ts) ORDER BY event_ts, event_id) AS k, count(*) OVER (PARTITION BY series_id, date_trunc('hour', event_ts)) AS n FROM (SELECT *, date_trunc('hour', event_ts) AS bar_start_ts FROM tr)) SELECT series_id, CAST(epoch(bar_start_ts) AS BIGINT) AS t, event_id, n > 1 AS duplicate_key FROM tq WHERE k = 1")
def l6b(spark, d):
    """Every trade as a quote of its hour: the first known stays, and a repeated hour is flagged."""
    t = A.trades(spark, d).withColumn("bar_start_ts", F.date_trunc("hour", "event_ts"))
    q = t.select("series_id", F.concat("series_id", F.lit("H24")).alias("contract_id"), "event_id", F.unix_timestamp("bar_start_ts").alias("t"), (F.col("bar_start_ts") + F.expr("interval 1 hour")).alias("bar_end_ts"), F.struct("event_ts", "event_id").alias("available_ts"))
    return L.collapse_quotes(q).select("series_id", "t", "event_id", "duplicate_key")


N = 6
_PATHW = f"WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {N} FOLLOWING)"


@query("l8_mfe", f"WITH {A.BARS} SELECT series_id, t, CASE WHEN count(*) OVER w = {N} THEN round(max(high) OVER w / close - 1, 6) END AS mfe FROM bars {_PATHW}")
def l8(spark, d):
    return out(L.excursions(A.bars(spark, d), N), "mfe")


@query("l9_mae", f"WITH {A.BARS} SELECT series_id, t, CASE WHEN count(*) OVER w = {N} THEN round(min(low) OVER w / close - 1, 6) END AS mae, CASE WHEN count(*) OVER w = {N} THEN round(1 - max(high) OVER w / close, 6) END AS short_mae FROM bars {_PATHW}")
def l9(spark, d):
    b = A.bars(spark, d)
    short = L.excursions(b, N, long=False).select("series_id", "t", F.col("mae").alias("short_mae"))
    return out(L.excursions(b, N).join(short, ["series_id", "t"]), "mae", "short_mae")


_NUM = "nb AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k, count(*) OVER (PARTITION BY series_id) AS total FROM bars)"


def _touch(a, b, both, extra="", where="true", source="nb"):
    """SQL of first touch: a and b test bar f against entry e; both names the outcome of a bar that meets both."""
    return f"""WITH {A.BARS}, {_NUM}{extra}, hit AS (SELECT e.series_id, e.t, min(f.k) AS k FROM {source} e JOIN nb f ON f.series_id = e.series_id AND f.k > e.k AND f.k <= e.k + {N} WHERE ({a}) OR ({b}) GROUP BY 1, 2),
o AS (SELECT e.*, CASE WHEN f.k IS NULL THEN CASE WHEN e.k + {N} <= e.total THEN 'none' END WHEN ({a}) AND ({b}) THEN '{both}' WHEN {a} THEN 'first' ELSE 'second' END AS outcome, coalesce(f.k - e.k, CASE WHEN e.k + {N} <= e.total THEN {N} END) AS steps
FROM {source} e LEFT JOIN hit h USING (series_id, t) LEFT JOIN nb f ON f.series_id = e.series_id AND f.k = h.k WHERE {where})"""


_T, _S = "f.high >= e.close * (1 + 0.05::DOUBLE)", "f.low <= e.close * (1 - 0.04::DOUBLE)"


@query("l10_target_before_stop", _touch(_T, _S, "both") + " SELECT series_id, t, CASE WHEN outcome <> 'both' THEN outcome = 'first' END AS target_before_stop, CAST(steps AS BIGINT) AS steps FROM o")
def l10(spark, d):
    return out(L.barrier(A.bars(spark, d), N, 0.05, 0.04), "target_before_stop", "steps")


@query("l11_triple_barrier", _touch(_T, _S, "second") + " SELECT series_id, t, CAST(CASE outcome WHEN 'first' THEN 1 WHEN 'second' THEN -1 WHEN 'none' THEN 0 END AS BIGINT) AS triple_barrier FROM o")
def l11(spark, d):
    return out(L.barrier(A.bars(spark, d), N, 0.05, 0.04, policy="stop_first"), "triple_barrier")


@query("l12_breakout_success", _touch("f.low <= e.close * (1 - 0.03::DOUBLE)", "f.high >= e.close * (1 + 0.04::DOUBLE)", "first") + " SELECT series_id, t, CASE WHEN outcome IS NOT NULL THEN outcome = 'second' END AS breakout_success FROM o")
def l12(spark, d):
    return out(L.breakout_success(A.bars(spark, d), N, 0.04, 0.03), "breakout_success")


_VW = ", vb AS (SELECT *, sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap FROM nb WINDOW w AS (PARTITION BY series_id, CAST(bar_start_ts AS DATE) ORDER BY t ROWS UNBOUNDED PRECEDING))"


@query("l13_return_to_vwap", _touch("CASE WHEN e.close >= e.vwap THEN f.low <= e.vwap + e.vwap * 5.0::DOUBLE / 1e4 ELSE f.high >= e.vwap - e.vwap * 5.0::DOUBLE / 1e4 END", "false", "both", _VW, source="vb") + " SELECT series_id, t, CASE WHEN outcome IS NOT NULL THEN outcome = 'first' END AS returned FROM o")
def l13(spark, d):
    b = A.bars(spark, d).withColumn("day", F.to_date("bar_start_ts"))
    w = W.Series(("series_id", "day"), ("t",)).expanding()
    b = b.withColumn("vwap", F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")).over(w) / F.sum("volume").over(w))
    return out(L.return_to_vwap(b, N, "vwap", 5.0), "returned")


@query("l14_sweep_outcome", _touch("f.low <= e.close * (1 - 0.03::DOUBLE)", "f.high >= e.close * (1 + 0.03::DOUBLE)", "first") + " SELECT series_id, t, CASE outcome WHEN 'first' THEN 'reversal' WHEN 'second' THEN 'continuation' WHEN 'none' THEN 'unresolved' END AS sweep_outcome FROM o")
def l14(spark, d):
    return out(L.sweep_outcome(A.bars(spark, d), N, 0.03, 0.03), "sweep_outcome")


@query("l15_liquidity_quality", f"WITH {A.QUOTES}, q5 AS (SELECT *, CASE WHEN valid THEN spread / mid * 1e4 END AS x FROM quotes) SELECT series_id, t, CASE WHEN count(x) OVER w = 4 THEN round(avg(x) OVER w, 6) END AS mean_spread_bps, CASE WHEN count(x) OVER w = 4 THEN avg(x) OVER w <= 2.45 END AS liquid FROM q5 WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)")
def l15(spark, d):
    return out(L.future_liquidity(A.quotes(spark, d), 4, Q.valid(), 2.45), "mean_spread_bps", "liquid")


# bars of a session: the real-trade bars of a UTC day, numbered by hour
_SB = f"{A.BARS}, sb AS (SELECT *, series_id || ':' || CAST(CAST(bar_start_ts AS DATE) AS VARCHAR) AS session_id, hour(bar_start_ts) AS bar_index FROM bars), sr AS (SELECT *, close / lag(close) OVER (PARTITION BY session_id ORDER BY bar_index) - 1 AS r FROM sb)"


def _session_bars(spark, d):
    b = A.bars(spark, d)
    return b.withColumn("session_id", F.concat_ws(":", "series_id", F.to_date("bar_start_ts").cast("string"))).withColumn("bar_index", F.hour("bar_start_ts"))


def _generated(name, columns):
    parts = []
    for h in (1, 3, 5):
        full = f"count(*) OVER w = {h} AND max(bar_index) OVER w = bar_index + {h}"
        cols = ", ".join(f"CASE WHEN {full} THEN {e.replace('#h', str(h))} END AS {c}" for c, e in columns.items())
        parts.append(f"SELECT series_id, t, CAST({h} AS BIGINT) AS horizon, {cols} FROM sr WINDOW w AS (PARTITION BY session_id ORDER BY bar_index ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)")

    @query(name, f"WITH {_SB} " + " UNION ALL ".join(parts))
    def run(spark, d):
        return _lab(L.generated(_session_bars(spark, d), [1, 3, 5]), *columns)


_FR = {"forward_return": "round(last(close) OVER w / close - 1, 6)"}
_MM = {"mfe": "round(max(high) OVER w / close - 1, 6)", "mae": "round(min(low) OVER w / close - 1, 6)"}
_RV = {"realized_volatility": "CASE WHEN #h >= 2 THEN round(stddev_pop(r) OVER w, 6) END"}
_LQ = {"future_volume": "round(sum(volume) OVER w, 6)", "future_trades": "round(avg(trade_count) OVER w, 6)"}
_generated("l16_generated_forward_returns", _FR)
_generated("l17_generated_mfe_mae", _MM)
_generated("l19_future_realized_volatility", _RV)
_generated("l20_future_liquidity", _LQ)
_generated("l21_standard_labels", _FR | _MM | _RV | _LQ)


@query("l18_stop_target_order", _touch(_T, _S, "both") + " SELECT CASE outcome WHEN 'both' THEN 'ambiguous_same_bar' WHEN 'first' THEN 'target_first' WHEN 'second' THEN 'stop_first' WHEN 'none' THEN 'neither' ELSE 'insufficient_future' END AS path_order, count(*) AS n, CAST(sum(steps) AS BIGINT) AS steps FROM o GROUP BY 1")
def l18(spark, d):
    o = F.col("outcome")
    named = F.when(o == "both", "ambiguous_same_bar").when(o == "first", "target_first").when(o == "second", "stop_first").when(o == "none", "neither").otherwise("insufficient_future")
    return L.barrier(A.bars(spark, d), N, 0.05, 0.04).groupBy(named.alias("path_order")).agg(F.count("*").alias("n"), F.sum("steps").alias("steps"))


@query("l22_label_availability", f"WITH {A.BARS}, {_fwd('bars', 'close')} SELECT series_id, t, CAST(horizon AS BIGINT) AS horizon, t1 + 3601 AS available_t FROM j")
def l22(spark, d):
    return _lab(L.terminals(A.bars(spark, d), HORIZONS, ["close"]).withColumn("available_t", F.unix_timestamp("label_available_ts")), "available_t")


@query("l23_overlap_metadata", f"WITH {A.BARS}, {_fwd('bars', 'close')} SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS rows, CAST(floor(count(*) / (horizon / 60)) AS BIGINT) AS effective_rows FROM j GROUP BY horizon")
def l23(spark, d):
    return L.overlap_metadata(L.terminals(A.bars(spark, d), HORIZONS, ["close"]), 60).select(F.col("horizon").cast("long").alias("horizon"), "rows", "effective_rows")


@query("l24_label_validation", f"WITH {A.BARS}, {_fwd('bars', 'close')}, u AS (SELECT * FROM j UNION ALL SELECT * FROM j WHERE t % 86400 = 0), i AS (SELECT CASE WHEN t % 36000 = 0 THEN 1 ELSE 0 END AS early, count(*) OVER (PARTITION BY series_id, t, horizon) > 1 AS dup FROM u) SELECT issue, count(*) AS n FROM (SELECT 'available_before_horizon_end' AS issue FROM i WHERE early = 1 UNION ALL SELECT 'duplicate_key' FROM i WHERE dup) GROUP BY 1")
def l24(spark, d):
    """Labels with planted faults: some known ten minutes before their horizon's end, some twice."""
    j = L.forward_returns(A.bars(spark, d), HORIZONS, guard=False)
    u = j.unionByName(j.filter("t % 86400 = 0"))
    early = F.when(F.col("t") % 36000 == 0, F.col("horizon_end_ts") - F.expr("interval 10 minutes")).otherwise(F.col("label_available_ts"))
    issues = L.label_issues(u.withColumn("label_available_ts", early), ["series_id", "t", "horizon"])
    return issues.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("l25_guard_drop_counts", f"WITH {A.BARS}, {_fwd('bars', 'close')} SELECT CAST(horizon AS BIGINT) AS horizon, CASE WHEN {_CROSS} THEN 'maintenance_crossing' ELSE 'keep' END AS reason, count(*) AS windows FROM j GROUP BY 1, 2")
def l25(spark, d):
    return L.guard_drop_counts(L.terminals(A.bars(spark, d), HORIZONS, ["close"])).select(F.col("horizon").cast("long").alias("horizon"), "reason", "windows")


@query("j4_terminal_self_join", f"WITH {A.BARS}, {_fwd('bars', 'close')} SELECT series_id, t, CAST(horizon AS BIGINT) AS horizon, round(x1, 6) AS terminal_close FROM j")
def j4(spark, d):
    return _lab(L.terminals(A.bars(spark, d), HORIZONS, ["close"]), "terminal_close")
