"""Registered queries of the diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import diagnostics as D
from barloom.plans import adapters as A
from barloom.plans.features_q import MARKETS, _XM, _aligned
from barloom.plans.observations import OBS, corr_sql, factors, observations, returns
from barloom.plans.registry import query

BY = ["series_id", "horizon_seconds"]
_B = "series_id, horizon_seconds"
_C = corr_sql("f", "y")
_RK = f"""{OBS}, o2 AS (SELECT * FROM obs WHERE f IS NOT NULL AND y IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY {_B} ORDER BY f) + (count(*) OVER (PARTITION BY {_B}, f) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {_B} ORDER BY y) + (count(*) OVER (PARTITION BY {_B}, y) - 1) / 2.0 AS ry FROM o2)"""


def fixed(df):
    """Doubles to six places, whole numbers as long."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in df.columns])


def _q(name, make, select, source="obs", group=_B, keys=_B, ctes=OBS, tail=""):
    g = f"GROUP BY {group}" if group else ""

    @query(name, f"WITH {ctes} SELECT {keys + ', ' if keys else ''}{select} FROM {source} {g} {tail}")
    def run(spark, d):
        return fixed(make(observations(spark, d)))


_q("d1_pearson_ic", lambda o: o.groupBy(*BY).agg(D.pairs("f", "y").alias("n"), D.pearson("f", "y").alias("pearson_ic")), f"count(*) FILTER (f IS NOT NULL) AS n, {_C} AS pearson_ic")
_q("d2_rank_ic", lambda o: D.information_coefficients(o, BY).drop("pearson_ic"), f"count(*) AS n, {corr_sql('rx', 'ry')} AS rank_ic", "rk", ctes=_RK)
_q("d3_ic_by_horizon", lambda o: D.information_coefficients(o, ["horizon_seconds"]), f"count(*) AS n, {_C} AS pearson_ic, {corr_sql('rx', 'ry')} AS rank_ic", "rk", "horizon_seconds", "horizon_seconds",
   ctes=_RK.replace(f"PARTITION BY {_B}", "PARTITION BY horizon_seconds"))
_IC = f"{OBS}, ic AS (SELECT {_B}, covar_pop(f, y) / (stddev_pop(f) * stddev_pop(y) FILTER (f IS NOT NULL)) AS ic FROM obs GROUP BY {_B})"
_q("d4_ic_decay", lambda o: D.ic_decay(o.groupBy(*BY).agg(D.pearson("f", "y").alias("pearson_ic")), ["series_id"]), "round(arg_min(ic, horizon_seconds), 6) AS first_ic, round(arg_max(ic, horizon_seconds), 6) AS last_ic, round((arg_max(ic, horizon_seconds) - arg_min(ic, horizon_seconds)) / (max(horizon_seconds) - min(horizon_seconds)), 6) AS slope", "ic", "series_id", "series_id", ctes=_IC)
for _p, _e in (("day", "strftime(day, '%Y-%m-%d')"), ("week", "strftime(day, '%G-W%V')"), ("month", "strftime(day, '%Y-%m')")):
    _q(f"d5_ic_by_{_p}", lambda o, p=_p: o.groupBy("horizon_seconds", D.period_key(F.col("event_ts"), p).alias("period")).agg(D.pairs("f", "y").alias("n"), D.pearson("f", "y").alias("ic")), f"{_e} AS period, count(*) FILTER (f IS NOT NULL) AS n, {_C} AS ic", group="horizon_seconds, 2", keys="horizon_seconds")
_DAY = f"{OBS}, dy AS (SELECT series_id, day, CASE WHEN count(*) FILTER (f IS NOT NULL) >= 2 THEN covar_pop(f, y) / nullif(stddev_pop(f) * stddev_pop(y) FILTER (f IS NOT NULL), 0) END AS ic FROM obs WHERE horizon_seconds = 3600 GROUP BY 1, 2)"
_q("d6_icir", lambda o: D.icir(o.filter("horizon_seconds = 3600").groupBy("series_id", "day").agg(D.pearson("f", "y").alias("pearson_ic")), ["series_id"]), "count(ic) AS periods, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir", "dy", "series_id", "series_id", ctes=_DAY)
_BK = f"{OBS}, bk AS (SELECT *, least(5, CAST(floor((row_number() OVER (PARTITION BY {_B} ORDER BY f, t) - 1) * 5 / count(*) OVER (PARTITION BY {_B})) AS BIGINT) + 1) AS bucket FROM obs WHERE f IS NOT NULL AND y IS NOT NULL)"
_q("d7_bucket_returns", lambda o: D.bucket_returns(o, BY, 5, ["t"]), "bucket, count(*) AS n, round(avg(y), 6) AS mean_return, round(avg(CASE WHEN y > 0 THEN 1 ELSE 0 END), 6) AS hit_rate", "bk", f"{_B}, bucket", ctes=_BK)
_BM = f"{_BK}, bm AS (SELECT {_B}, bucket, avg(y) AS m FROM bk GROUP BY {_B}, bucket), bd AS (SELECT *, m - lag(m) OVER (PARTITION BY {_B} ORDER BY bucket) AS d FROM bm), bs AS (SELECT *, lag(sign(d)) OVER (PARTITION BY {_B} ORDER BY bucket) AS ls FROM bd)"
_q("d8_bucket_monotonicity", lambda o: D.bucket_monotonicity(D.bucket_returns(o, BY, 5, ["t"]), BY), f"coalesce(bool_and(d >= 0), true) AS non_decreasing, coalesce(bool_and(d <= 0), true) AS non_increasing, count(*) FILTER (sign(d) <> ls) AS sign_changes, {corr_sql('bucket', 'm')} AS bucket_correlation", "bs", ctes=_BM)
_q("d9_tail_expectancy", lambda o: D.tail_expectancy(D.bucket_returns(o, BY, 5, ["t"]), BY), "round(arg_max(m, bucket) - arg_min(m, bucket), 6) AS tail_expectancy", "bm", ctes=_BM)
_q("d10_u_shape", lambda o: D.u_shape(D.bucket_returns(o, BY, 5, ["t"]), BY), "round(avg(m) FILTER (bucket IN (1, 5)), 6) AS edge_mean, round(avg(m) FILTER (bucket NOT IN (1, 5)), 6) AS center_mean, round(avg(m) FILTER (bucket IN (1, 5)) - avg(m) FILTER (bucket NOT IN (1, 5)), 6) AS u_shape", "bm", ctes=_BM)
_q("d11_extreme_hit_rates", lambda o: D.extreme_hit_rates(o, BY, 5, ["t"]), "round(avg(CAST(y > 0 AS INT)) FILTER (bucket = 1), 6) AS low_hit_rate, round(avg(CAST(y > 0 AS INT)) FILTER (bucket = 5), 6) AS high_hit_rate", "bk", ctes=_BK)
_q("d12_excursions_by_bucket", lambda o: D.excursions_by_bucket(o, BY, 5, ["t"]), "bucket, count(*) AS n, round(avg(mfe), 6) AS mean_mfe, round(avg(mae), 6) AS mean_mae, count(mfe) AS n_mfe", "bk", f"{_B}, bucket", ctes=_BK)

_EV = f"{OBS}, ev AS (SELECT *, coalesce(f > 0.02, false) AS e FROM obs)"
_EVENT = {
    "d13a_event_study": {"n": "count(*)", "events": "count(*) FILTER (e)", "others": "count(*) FILTER (NOT e)", "event_mean": "round(avg(y) FILTER (e), 6)", "other_mean": "round(avg(y) FILTER (NOT e), 6)", "uplift": "round(avg(y) FILTER (e) - avg(y) FILTER (NOT e), 6)"},
    "d13b_conditional_forward_returns": {"event_mean": "round(avg(y) FILTER (e), 6)", "other_mean": "round(avg(y) FILTER (NOT e), 6)"},
    "d14_sample_size": {"n": "count(*)", "events": "count(*) FILTER (e)", "others": "count(*) FILTER (NOT e)"},
    "d15_false_breakout_rate": {"false_breakout_rate": "round(avg(CAST(y <= 0 AS INT)) FILTER (e), 6)"},
    "d16_target_first_probability": {"target_first_rate": "round(avg(CAST(tbs AS INT)) FILTER (e), 6)"},
    "d17_post_event_excursions": {"event_mfe": "round(avg(mfe) FILTER (e), 6)", "event_mae": "round(avg(mae) FILTER (e), 6)"},
}
for _n, _cols in _EVENT.items():
    _q(_n, lambda o, c=_cols: D.event_study(o, BY, F.col("f") > 0.02).select(*BY, *c), ", ".join(f"{e} AS {c}" for c, e in _cols.items()), "ev", ctes=_EV)

_KP = f"{OBS}, kp AS (SELECT *, coalesce(regime = 'calm', false) AS k FROM obs)"
_FILTER = {
    "d18_regime_uplift": {"uplift": "round(avg(y) FILTER (k) - avg(y) FILTER (NOT k), 6)"}, "d19_regime_coverage": {"coverage": "round(avg(CAST(k AS INT)), 6)"},
    "d20_false_rejection_rate": {"false_rejection_rate": "round(avg(CAST(NOT k AS INT)) FILTER (y > 0), 6)"},
    "d21_conditional_improvement": {"mean_improvement": "round(avg(y) FILTER (k) - avg(y), 6)", "hit_rate_improvement": "round(avg(CAST(y > 0 AS INT)) FILTER (k) - avg(CAST(y > 0 AS INT)), 6)"},
}
for _n, _cols in _FILTER.items():
    _q(_n, lambda o, c=_cols: D.filter_effect(o, BY, F.col("regime") == "calm").select(*BY, *c), ", ".join(f"{e} AS {c}" for c, e in _cols.items()), "kp", ctes=_KP)

for _n, _f in (("d22b_spread", "spread"), ("d22c_liquidity", "liquidity"), ("d22d_slippage", "slippage"), ("d22e_participation", "participation")):
    _SB = f"{OBS}, sb AS (SELECT *, least(3, CAST(floor((row_number() OVER (PARTITION BY {_B} ORDER BY {_f}, t) - 1) * 3 / count(*) OVER (PARTITION BY {_B})) AS BIGINT) + 1) AS bucket FROM obs WHERE {_f} IS NOT NULL AND y IS NOT NULL)"
    _q(f"{_n}_sensitivity", lambda o, f=_f: D.sensitivity(o, BY, f, 3, ["t"]), f"count(*) AS n, {corr_sql(_f, 'y')} AS correlation, " + ", ".join(f"round(avg(y) FILTER (bucket = {k}), 6) AS bucket_{k}" for k in (1, 2, 3)), "sb", ctes=_SB)
_q("d23_adverse_selection", lambda o: D.adverse_selection(o, BY), "round(-avg(CASE WHEN f >= 0 THEN 1 ELSE -1 END * y) FILTER (f IS NOT NULL), 6) AS adverse_selection")
_MAN = {
    "target_before_stop": "round(avg(CAST(tbs AS INT)), 6)", "time_to_target": "round(avg(steps) FILTER (tbs), 6)", "time_to_stop": "round(avg(steps) FILTER (stop_first), 6)",
    "breakeven_usefulness": "round(avg(CAST(mfe > 0 AS INT)) FILTER (stop_first), 6)", "trailing_usefulness": "round(avg(CAST(mfe > greatest(y, 0) AS INT)), 6)",
}
for _k, _c in zip("abcde", _MAN, strict=True):
    _q(f"d24{_k}_{_c}", lambda o, c=_c: D.management_summary(o, BY).select(*BY, c), f"{_MAN[_c]} AS {_c}")
_q("d24f_management_summary", lambda o: D.management_summary(o, BY), ", ".join(f"{e} AS {c}" for c, e in _MAN.items()))

_ST = f"count(*) AS n, round(avg(y), 6) AS mean_return, {_C} AS ic"
_OK = f"{OBS}, ok AS (SELECT *, max(bar_index) OVER (PARTITION BY {_B}) AS top FROM obs WHERE f IS NOT NULL AND y IS NOT NULL)"
_q("d25a_time_of_day_stability", lambda o: D.stability(o, BY, F.date_format("event_ts", "HH:mm"), "bucket"), f"strftime(bar_end_ts, '%H:%M') AS bucket, {_ST}", "ok", f"{_B}, 3", ctes=_OK)
_q("d25b_session_segment_stability", lambda o: D.stability(o.filter("f is not null and y is not null").withColumn("s", D.session_segment("bar_index", 3, BY)), BY, F.col("s"), "bucket"), f"CAST(least(3, CAST(floor(bar_index * 3 / (top + 1)) AS BIGINT) + 1) AS VARCHAR) AS bucket, {_ST}", "ok", f"{_B}, 3", ctes=_OK)
_q("d25c_monthly_stability", lambda o: D.stability(o, BY, F.date_format("event_ts", "yyyy-MM"), "bucket"), f"strftime(bar_end_ts, '%Y-%m') AS bucket, {_ST}", "ok", f"{_B}, 3", ctes=_OK)
_q("d25d_regime_stability", lambda o: D.stability(o, BY, F.col("regime"), "bucket"), f"coalesce(regime, 'unknown') AS bucket, {_ST}", "ok", f"{_B}, 3", ctes=_OK)


@query("d23b_execution_filter_summary", f"WITH {OBS} SELECT horizon_seconds, 'adverse_selection' AS measure, round(-avg(CASE WHEN f >= 0 THEN 1 ELSE -1 END * y) FILTER (f IS NOT NULL), 6) AS value FROM obs GROUP BY 1 " + "".join(f" UNION ALL SELECT horizon_seconds, '{f}', {corr_sql(f, 'y')} FROM obs GROUP BY 1" for f in ("spread", "liquidity", "slippage", "participation")))
def d23b(spark, d):
    return fixed(D.execution_summary(observations(spark, d), ["horizon_seconds"], ["spread", "liquidity", "slippage", "participation"]))


_FC = f"{OBS}, fl AS (SELECT t, series_id, fv AS v, 'return' AS factor FROM nb WHERE fv IS NOT NULL UNION ALL SELECT t, series_id, volume, 'volume' FROM nb UNION ALL SELECT t, series_id, high - low, 'range' FROM nb), pr AS (SELECT a.factor AS factor_a, b.factor AS factor_b, a.v AS f, b.v AS y FROM fl a JOIN fl b USING (series_id, t) WHERE a.factor < b.factor), pk AS (SELECT *, rank() OVER (PARTITION BY factor_a, factor_b ORDER BY f) + (count(*) OVER (PARTITION BY factor_a, factor_b, f) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY factor_a, factor_b ORDER BY y) + (count(*) OVER (PARTITION BY factor_a, factor_b, y) - 1) / 2.0 AS ry FROM pr)"


@query("d26_factor_correlations", f"WITH {_FC} SELECT factor_a, factor_b, count(*) AS n, {_C} AS pearson_ic, {corr_sql('rx', 'ry')} AS rank_ic FROM pk GROUP BY 1, 2")
def d26(spark, d):
    b = A.bars(spark, d)
    fr = factors(spark, d).select("series_id", "t", F.lit("return").alias("factor"), F.col("f").alias("value")).filter("value is not null")
    more = b.select("series_id", "t", F.explode(F.array(F.struct(F.lit("volume").alias("factor"), F.col("volume").alias("value")), F.struct(F.lit("range").alias("factor"), (F.col("high") - F.col("low")).alias("value")))).alias("x")).select("series_id", "t", "x.*")
    return fixed(D.factor_correlations(fr.unionByName(more), "factor", ["series_id", "t"]))


@query("d27_cross_sectional_rank", f"""WITH {OBS}, k AS (SELECT *, CASE WHEN fv IS NOT NULL AND (t // 3600 + length(series_id)) % 9 <> 0 THEN true ELSE false END AS known FROM nb)
SELECT series_id, t, known = false AS missing, CASE WHEN known THEN row_number() OVER w END AS rank, CASE WHEN known THEN CASE WHEN count(*) OVER p > 1 THEN round((count(*) OVER p - row_number() OVER w) / (count(*) OVER p - 1), 6) ELSE 1 END END AS percentile
FROM k WINDOW w AS (PARTITION BY t, known ORDER BY fv DESC, series_id), p AS (PARTITION BY t, known)""")
def d27(spark, d):
    """Some series become available after the decision, so they take no part at that time."""
    f = factors(spark, d).withColumn("decision_ts", F.col("available_ts"))
    late = (F.col("t") / 3600 + F.length("series_id")) % 9 == 0
    f = f.withColumn("available_ts", F.when(late, F.col("available_ts") + F.expr("interval 1 minute")).otherwise(F.col("available_ts")))
    return fixed(D.cross_sectional_rank(f, "t", "series_id", "f", "available_ts", "decision_ts").select("series_id", "t", "missing", "rank", "percentile"))


_FR = f"{OBS}, fs AS (SELECT {_B}, avg(f) AS m, stddev_pop(f) AS s FROM obs GROUP BY {_B})"
_q("d28_factor_report", lambda o: D.factor_report(o, BY), f'count(*) AS "rows", count(f) AS "values", round(avg(CAST(f IS NULL AS INT)), 6) AS missing_rate, count(*) FILTER (abs((f - m) / s) > 3) AS outliers, count(DISTINCT f) AS distinct_values, count(DISTINCT f) <= 1 AS constant, {_C} AS pearson_ic', f"obs JOIN fs USING ({_B})", ctes=_FR)
_LR = """count(*) AS "rows", count(*) FILTER (y > 0) AS positive, count(*) FILTER (y < 0) AS negative, count(*) FILTER (y = 0) AS neutral, round(avg(CAST(y IS NULL AS INT)), 6) AS missing_rate, round(greatest(count(*) FILTER (y > 0), count(*) FILTER (y < 0), count(*) FILTER (y = 0)) / count(y), 6) AS majority_share, round(least(count(*) FILTER (y > 0), count(*) FILTER (y < 0)) / count(y), 6) AS minority_share, round(avg(CAST(coalesce(ambiguous, false) AS INT)), 6) AS ambiguous_rate"""
_HO = f"""{OBS}, lr AS (SELECT {_B}, {_LR} FROM obs GROUP BY {_B}),
hc AS (SELECT series_id, count(*) AS horizons, min(n) AS min_samples, max(n) AS max_samples, min(n) / max(n) AS coverage_ratio FROM (SELECT series_id, horizon_seconds, count(*) AS n FROM obs GROUP BY 1, 2) GROUP BY 1),
ends AS (SELECT series_id, t + 3600 AS x, t + 3600 + horizon_seconds AS z FROM obs), tm AS (SELECT DISTINCT series_id, x FROM ends UNION SELECT series_id, z FROM ends),
op AS (SELECT a.series_id, a.x, (SELECT count(*) FROM ends e WHERE e.series_id = a.series_id AND e.x <= a.x AND e.z > a.x) AS n FROM tm a),
ho AS (SELECT series_id, min(n) AS min_overlap, max(n) AS max_overlap FROM op WHERE x < (SELECT max(z) FROM ends e WHERE e.series_id = op.series_id) GROUP BY 1)"""


@query("d29_label_report", f"WITH {_HO} SELECT lr.*, horizons, min_samples, max_samples, round(coverage_ratio, 6) AS coverage_ratio, min_overlap, max_overlap FROM lr JOIN hc USING (series_id) JOIN ho USING (series_id)")
def d29(spark, d):
    """Labels by series and horizon, with their series' horizon coverage and the labels open at a time."""
    o = observations(spark, d)
    spans = o.select("series_id", "event_ts", F.timestamp_seconds(F.unix_timestamp("event_ts") + F.col("horizon_seconds")).alias("ends_ts"))
    whole = D.horizon_coverage(o, ["series_id"]).select("series_id", "horizons", "min_samples", "max_samples", "coverage_ratio")
    return fixed(D.label_report(o, BY).join(whole, "series_id").join(D.horizon_overlap(spans, ["series_id"], "event_ts", "ends_ts"), "series_id"))


def _split(name, column):
    col = f"coalesce({column}, 'unknown')"
    ctes = f"{OBS}, sp AS (SELECT {_B}, {col} AS bucket, count(*) AS r, count(y) AS n, sum(y) AS s, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS h FROM obs GROUP BY {_B}, 3), st AS (SELECT *, sum(n) OVER p AS tn, sum(s) OVER p AS ts, sum(h) OVER p AS th FROM sp WINDOW p AS (PARTITION BY {_B}))"
    _q(name, lambda o: D.split_report(o, BY, F.col(column), 300), 'bucket, r AS "rows", round(n / tn, 6) AS coverage, round(1 - n / r, 6) AS missing_rate, round(s / n - (ts - s) / nullif(tn - n, 0), 6) AS uplift, round(s / n - ts / tn, 6) AS mean_delta, round(h / n - th / tn, 6) AS hit_rate_delta, round((th - h) / th, 6) AS false_rejection_rate, n < 300 AS low_sample', "st", "", ctes=ctes)


_split("d30_session_split_report", "session_label")
_split("d31_regime_split_report", "regime")


@query("d32_alignment_coverage", f"""WITH {A.BARS}, x AS (SELECT *, bar_end_ts + to_seconds(CASE WHEN (t // 3600) % 10 = 0 AND series_id = 'view' THEN 61 ELSE 1 END) AS av, bar_end_ts + INTERVAL 30 SECOND AS de FROM bars WHERE series_id IN ('click', 'view', 'purchase')), g AS (SELECT t, count(*) AS n, count(DISTINCT series_id) AS d, max(av) AS hi, min(av) AS lo, min(de) AS de FROM x GROUP BY 1)
SELECT CASE WHEN d < 3 THEN 'missing_symbol' WHEN hi > de THEN 'late' ELSE 'aligned' END AS status, count(*) AS times, CAST(max(epoch(hi) - epoch(lo)) AS BIGINT) AS max_skew_seconds FROM g GROUP BY 1""")
def d32(spark, d):
    b = A.bars(spark, d)
    late = (F.col("t") / 3600 % 10 == 0) & (F.col("series_id") == "view")
    b = b.withColumn("decision_ts", F.col("bar_end_ts") + F.expr("interval 30 seconds")).withColumn("available_ts", F.when(late, F.col("bar_end_ts") + F.expr("interval 61 seconds")).otherwise(F.col("available_ts")))
    return D.alignment_coverage(b, list(MARKETS.values()))


_AP = f"{_XM}, pr AS (SELECT t, unnest(['ES', 'ES', 'NQ']) AS anchor, unnest(['NQ', 'RTY', 'RTY']) AS peer, unnest([e, e, n]) AS x, unnest([n, y, y]) AS y FROM al), p2 AS (SELECT *, CASE WHEN (t // 3600) % 2 = 0 THEN 'calm' ELSE 'busy' END AS regime FROM pr WHERE x IS NOT NULL AND y IS NOT NULL), p3 AS (SELECT *, rank() OVER (PARTITION BY anchor, peer ORDER BY x) + (count(*) OVER (PARTITION BY anchor, peer, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY anchor, peer ORDER BY y) + (count(*) OVER (PARTITION BY anchor, peer, y) - 1) / 2.0 AS ry FROM p2)"


@query("d33_pair_correlations", f"{_AP} SELECT anchor, peer, count(*) AS n, {corr_sql('x', 'y')} AS pearson, {corr_sql('rx', 'ry')} AS rank, round(avg(y - x), 6) AS mean_gap, round(avg(abs(y - x)), 6) AS mean_abs_gap, round(min(y - x), 6) AS min_gap, round(max(y - x), 6) AS max_gap FROM p3 GROUP BY 1, 2")
def d33(spark, d):
    return fixed(D.pair_correlations(_aligned(spark, d), list(MARKETS)))


_LL = " UNION ALL ".join(f"SELECT '{a}' AS leader, '{b}' AS target, CAST({k} AS BIGINT) AS lag, t - lag(t, {k}) OVER (ORDER BY t) AS since, lag({x}, {k}) OVER (ORDER BY t) AS x, {y} AS y FROM al" for a, x in zip(MARKETS, "eny", strict=True) for b, y in zip(MARKETS, "eny", strict=True) if a != b for k in (1, 2))


@query("d34_lead_lag", f"{_XM}, ll AS ({_LL}) SELECT leader, target, lag, count(*) AS n, round(avg(since), 6) AS mean_lag_seconds, {corr_sql('x', 'y')} AS correlation FROM ll WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3")
def d34(spark, d):
    return fixed(D.lead_lag(_aligned(spark, d), list(MARKETS), [1, 2]))


@query("d35_regime_correlations", f"{_AP} SELECT regime, anchor, peer, count(*) AS n, {corr_sql('x', 'y')} AS pearson FROM p2 GROUP BY 1, 2, 3")
def d35(spark, d):
    a = _aligned(spark, d).withColumn("regime", F.when((F.unix_timestamp("event_ts") / 3600 - 1) % 2 == 0, "calm").otherwise("busy"))
    return fixed(D.pair_correlations(a, list(MARKETS), ["regime"]).select("regime", "anchor", "peer", "n", "pearson"))


_VAL = f"{A.GRID}, va AS (SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY t) - 1 AS value, row_number() OVER (PARTITION BY series_id ORDER BY t) AS rn FROM grid)"


def _values(spark, d):
    from barloom.operators import features as X

    return X.returns(A.grid(spark, d))


@query("d36_feature_quality_report", f'WITH {_VAL} SELECT series_id, count(*) AS "rows", count(*) FILTER (value IS NULL) AS missing, round(avg(CAST(value IS NULL AS INT)), 6) AS missing_rate, count(DISTINCT value) AS distinct_values, count(DISTINCT value) <= 1 AS constant, CAST(0 AS BIGINT) AS availability_violations, count(*) FILTER (value IS NULL) AS flagged FROM va GROUP BY 1')
def d36(spark, d):
    return fixed(D.quality_report(_values(spark, d), ["series_id"]))


@query("d37_feature_coverage_report", f"WITH {_VAL}, e AS (SELECT series_id, trade_date, count(*) AS expected FROM grid GROUP BY 1, 2) SELECT series_id, trade_date, expected, count(value) AS found, round(count(value) / expected, 6) AS coverage FROM e JOIN va USING (series_id, trade_date) GROUP BY 1, 2, 3")
def d37(spark, d):
    from barloom.functions import sessions as S

    v = _values(spark, d).withColumn("trade_date", S.trade_date("bar_start_ts").cast("string"))
    expected = v.groupBy("series_id", "trade_date").agg(F.count("*").alias("expected"))
    return fixed(D.coverage_against(v, expected, ["series_id", "trade_date"]))


@query("o7_coverage_rollup", f'WITH {_VAL} SELECT series_id, session_label, count(*) AS "rows", count(value) AS "values", round(avg(CAST(value IS NOT NULL AS INT)), 6) AS coverage FROM va GROUP BY ROLLUP (series_id, session_label)')
def o7(spark, d):
    return fixed(D.coverage_rollup(_values(spark, d), ["series_id", "session_label"]))


@query("d38_feature_label_joint_report", f"WITH {OBS}, f AS (SELECT series_id, t, fv FROM nb), y AS (SELECT DISTINCT series_id, t FROM obs WHERE horizon_seconds = 10800) SELECT count(*) AS keys, count(*) FILTER (f.t IS NOT NULL AND y.t IS NOT NULL) AS overlap, count(*) FILTER (y.t IS NULL) AS features_only, count(*) FILTER (f.t IS NULL) AS labels_only, count(*) FILTER (f.t IS NOT NULL AND y.t IS NOT NULL AND (f.t // 3600) % 3 = 0) AS late_features, count(*) FILTER (f.t IS NOT NULL AND y.t IS NOT NULL AND fv IS NULL) AS missing_features FROM f FULL JOIN y ON f.series_id = y.series_id AND f.t = y.t")
def d38(spark, d):
    f = factors(spark, d).withColumnRenamed("f", "value")
    late = F.col("t") / 3600 % 3 == 0
    y = returns(spark, d).filter("horizon_seconds = 10800").withColumn("decision_ts", F.timestamp_seconds(F.col("t") + F.when(late, 3600).otherwise(3601)))
    return D.joint_report(f, y, ["series_id", "t"])


@query("d39_class_balance", f"WITH {OBS} SELECT series_id, CASE WHEN y > 0 THEN 'up' WHEN y < 0 THEN 'down' ELSE 'flat' END AS class, count(*) AS n FROM obs WHERE horizon_seconds = 3600 GROUP BY 1, 2")
def d39(spark, d):
    y = F.col("y")
    return observations(spark, d).filter("horizon_seconds = 3600").groupBy("series_id", F.when(y > 0, "up").when(y < 0, "down").otherwise("flat").alias("class")).agg(F.count("*").alias("n"))


@query("d40_no_lookahead_audit", f"WITH {OBS}, u AS (SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE t % 86400 = 0) SELECT 'available_after_decision' AS rule, count(*) FILTER ((t // 3600) % 6 = 0) AS n FROM u UNION ALL SELECT 'duplicate_key', 2 * count(*) FROM obs WHERE t % 86400 = 0 UNION ALL SELECT 'label_not_after_factor', count(*) FILTER ((t // 3600) % 7 = 0) FROM u")
def d40(spark, d):
    o = observations(spark, d)
    u = o.unionByName(o.filter("t % 86400 = 0"))
    h = F.col("t") / 3600
    u = u.withColumn("decision_ts", F.when(h % 6 == 0, F.col("event_ts")).otherwise(F.col("available_ts"))).withColumn("label_available_ts", F.when(h % 7 == 0, F.col("available_ts")).otherwise(F.col("label_available_ts")))
    return D.no_lookahead_audit(u, ["series_id", "t", "horizon_seconds"])


@query("entry_ic_by_series", f"WITH {_RK} SELECT {_B}, count(*) AS n, {_C} AS pearson_ic, {corr_sql('rx', 'ry')} AS rank_ic FROM rk GROUP BY {_B}")
def entry(spark, d):
    """Trades to bars, to the one-bar return and the forward return, to the IC of each series and horizon."""
    return fixed(D.information_coefficients(factors(spark, d).join(returns(spark, d), ["series_id", "t"]), BY))


@query("j1_factor_label_join", f"WITH {OBS} SELECT {_B}, count(*) AS joined, round(sum(y), 6) AS sum_y FROM obs GROUP BY {_B}")
def j1(spark, d):
    return fixed(factors(spark, d).join(returns(spark, d), ["series_id", "t"]).groupBy(*BY).agg(F.count("*").alias("joined"), F.sum("y").alias("sum_y")))


@query("j2_optional_label_join", f"WITH {OBS} SELECT {_B}, count(mfe) AS with_mfe, count(tbs) AS with_order, count(*) - count(spread) AS without_spread FROM obs GROUP BY {_B}")
def j2(spark, d):
    return observations(spark, d).groupBy(*BY).agg(F.count("mfe").alias("with_mfe"), F.count("tbs").alias("with_order"), F.count_if(F.col("spread").isNull()).alias("without_spread"))


@query("j3_semi_anti", f"WITH {OBS} SELECT n.series_id, count(*) FILTER (EXISTS (SELECT 1 FROM obs o WHERE o.series_id = n.series_id AND o.t = n.t)) AS usable, count(*) FILTER (NOT EXISTS (SELECT 1 FROM obs o WHERE o.series_id = n.series_id AND o.t = n.t)) AS missing FROM nb n GROUP BY 1")
def j3(spark, d):
    f, y = factors(spark, d), returns(spark, d)
    one = f.join(y, ["series_id", "t"], "left_semi").groupBy("series_id").agg(F.count("*").alias("usable"))
    two = f.join(y, ["series_id", "t"], "left_anti").groupBy("series_id").agg(F.count("*").alias("missing"))
    return one.join(two, "series_id", "full_outer").select("series_id", F.coalesce("usable", F.lit(0).cast("long")).alias("usable"), F.coalesce("missing", F.lit(0).cast("long")).alias("missing"))


