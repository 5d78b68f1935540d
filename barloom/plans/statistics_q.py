"""Registered queries of the statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import permutation as P
from barloom.operators import diagnostics as D
from barloom.operators import statistics as S
from barloom.plans import adapters as A
from barloom.plans.diagnostics_q import _B, _BK, BY, fixed
from barloom.plans.observations import OBS, corr_sql, observations
from barloom.plans.registry import query

_C = corr_sql("f", "y")
ONE = "horizon_seconds = 3600 AND f IS NOT NULL"
O1 = f"{OBS}, o1 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM obs WHERE {ONE})"


def _one(spark, d):
    return observations(spark, d).filter("horizon_seconds = 3600 and f is not null")


@query("s1_effective_n", f"WITH {OBS} SELECT {_B}, greatest(1, CAST(floor((count(*) - 5 - 3) / (horizon_seconds / 3600)) AS BIGINT)) AS n_eff FROM obs GROUP BY {_B}")
def s1(spark, d):
    g = observations(spark, d).groupBy(*BY).agg(F.count("*").alias("n"))
    return g.select(*BY, S.effective_n(F.col("n"), F.col("horizon_seconds") / 3600, 5, 3).alias("n_eff"))


@query("s2_session_day_units", f"WITH {OBS} SELECT series_id, count(DISTINCT regime) AS sessions, count(DISTINCT day) AS days, count(DISTINCT CASE WHEN regime IS NOT NULL THEN regime || CAST(day AS VARCHAR) END) AS session_days, count(*) FILTER (regime IS NULL) AS missing_session, CAST(0 AS BIGINT) AS missing_day FROM obs GROUP BY 1")
def s2(spark, d):
    return S.session_day_units(observations(spark, d), ["series_id"], "regime", "day")


@query("s3_overlap_block", f"WITH {OBS} SELECT {_B}, max(greatest(coalesce(steps, horizon_seconds // 3600), 1)) AS largest, sum(greatest(coalesce(steps, horizon_seconds // 3600), 1))::BIGINT AS total FROM obs GROUP BY {_B}")
def s3(spark, d):
    b = S.overlap_block(F.col("steps"), F.col("horizon_seconds"), 3600)
    return observations(spark, d).groupBy(*BY).agg(F.max(b).alias("largest"), F.sum(b).alias("total"))


_PW = f"{OBS}, pw AS (SELECT {_B}, count(*) FILTER (f IS NOT NULL) AS n, greatest(1, CAST(floor(count(*) FILTER (f IS NOT NULL) / (horizon_seconds / 3600)) AS BIGINT)) AS n_eff FROM obs GROUP BY {_B})"


def _power(spark, d):
    g = observations(spark, d).groupBy(*BY).agg(D.pairs("f", "y").alias("n"))
    return S.power_report(g.withColumn("n_eff", S.effective_n(F.col("n"), F.col("horizon_seconds") / 3600)))


@query("s4_ic_standard_error", f"WITH {_PW} SELECT {_B}, n_eff, round(1 / sqrt(n_eff - 1), 6) AS ic_se FROM pw")
def s4(spark, d):
    return fixed(_power(spark, d).select(*BY, "n_eff", "ic_se"))


@query("s5_power_report", f"WITH {_PW} SELECT {_B}, n, n_eff, round(1 / sqrt(n_eff - 1), 6) AS ic_se, round(1.96 / sqrt(n_eff - 1), 6) AS min_detectable_ic FROM pw")
def s5(spark, d):
    return fixed(_power(spark, d))


@query("s6_train_validation_split", f"WITH {O1} SELECT series_id, CASE WHEN rn >= n - greatest(round(n * 0.25), 1) THEN 'validation' WHEN rn < n - greatest(round(n * 0.25), 1) - 5 THEN 'train' ELSE 'gap' END AS role, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM o1 GROUP BY 1, 2")
def s6(spark, d):
    r = S.train_validation(_one(spark, d), ["series_id"], ["t"], 0.25, 3, 2)
    return r.groupBy("series_id", "role").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


_WF = f"{O1}, wf AS (SELECT o1.*, k AS fold, CASE WHEN rn - k * 60 < 200 THEN 'train' WHEN rn - k * 60 >= 206 THEN 'validation' END AS role FROM o1, generate_series(0, 1000) g(k) WHERE k * 60 + 266 <= n AND rn >= k * 60 AND rn < k * 60 + 266)"
_WIN = {"train": 200, "validation": 60, "step": 60, "purge": 4, "embargo": 2}


@query("s7_walk_forward_splits", f"WITH {_WF} SELECT series_id, fold, role, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM wf WHERE role IS NOT NULL GROUP BY 1, 2, 3")
def s7(spark, d):
    r = S.walk_forward(_one(spark, d), ["series_id"], ["t"], **_WIN)
    return r.groupBy("series_id", "fold", "role").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("s8_purge_embargo", f"WITH {O1}, r AS (SELECT *, CASE WHEN rn BETWEEN 200 AND 259 THEN 'validation' ELSE 'train' END AS role FROM o1) SELECT series_id, role, count(*) AS n FROM r WHERE NOT (role = 'train' AND rn BETWEEN 190 AND 264) GROUP BY 1, 2")
def s8(spark, d):
    r = S.numbered(_one(spark, d), ["series_id"], ["t"]).withColumn("role", F.when(F.col("rn").between(200, 259), "validation").otherwise("train"))
    return S.purge_embargo(r, 10, 5, ["series_id"]).groupBy("series_id", "role").agg(F.count("*").alias("n"))


@query("s8b_walk_forward_from_half_life", f"WITH {O1}, wf AS (SELECT o1.*, k AS fold, CASE WHEN rn - k * 40 < 160 THEN 'train' WHEN rn - k * 40 >= 170 THEN 'validation' END AS role FROM o1, generate_series(0, 1000) g(k) WHERE k * 40 + 210 <= n AND rn >= k * 40 AND rn < k * 40 + 210) SELECT series_id, role, count(*) AS n, count(DISTINCT fold) AS folds FROM wf WHERE role IS NOT NULL GROUP BY 1, 2")
def s8b(spark, d):
    r = S.walk_forward(_one(spark, d), ["series_id"], ["t"], **S.walk_forward_defaults(40))
    return r.groupBy("series_id", "role").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"))


SEEDS = 5
_P = P.PRIME


def _moved_sql(key, value):
    x = f"(({value} + k{key}) % {_P})"
    return f"(({x} * {x} % {_P} * {x} + k{key}) % {_P})"


def _keys_sql(group):
    """Ten numbers from the md5 of seed and group, as columns k0 to k9."""
    return ", ".join(f"('0x' || substr(md5(concat_ws('|', seed, {group}, '{i // 4}')), {1 + 7 * (i % 4)}, 7))::BIGINT AS k{i}" for i in range(P.KEYS))


def _permuted_sql(source, place, n, name, inverse=False):
    """The CTE ``source`` with the keyed permutation of a place as another column."""
    d = f"SELECT *, CAST({place} AS BIGINT) AS x, CAST(floor(sqrt({n})) AS BIGINT) AS pa, {n} // CAST(floor(sqrt({n})) AS BIGINT) AS pb FROM {source}"
    for i in range(P.PASSES)[:: -1 if inverse else 1]:
        k, l, turn = 3 * i, 3 * i + 1, 3 * i + 2
        if inverse:
            d = f"SELECT * REPLACE (((x - k{turn}) % {n} + {n}) % {n} AS x) FROM ({d})"
            d = f"SELECT *, ((x % pb - {_moved_sql(l, 'x // pb')}) % pb + pb) % pb AS pr FROM ({d})"
            d = f"SELECT * EXCLUDE (pr) REPLACE (CASE WHEN x < pa * pb THEN ((x // pb - {_moved_sql(k, 'pr')}) % pa + pa) % pa * pb + pr ELSE x END AS x) FROM ({d})"
        else:
            d = f"SELECT *, (x // pb + {_moved_sql(k, 'x % pb')}) % pa AS pl FROM ({d})"
            d = f"SELECT * EXCLUDE (pl) REPLACE ((CASE WHEN x < pa * pb THEN pl * pb + (x % pb + {_moved_sql(l, 'pl')}) % pb ELSE x END + k{turn}) % {n} AS x) FROM ({d})"
    return f"SELECT * EXCLUDE (x, pa, pb), x AS {name} FROM ({d})"


def _moved_places_sql(source, n):
    """Where each place rn is sent, without fixed points, as column mv."""
    q = f"(SELECT * REPLACE ((q + 1 + k9 % greatest({n} - 1, 1)) % {n} AS q) FROM ({_permuted_sql(source, 'rn', n, 'q')}))"
    return _permuted_sql(q, "q", n, "mv", True)


_SEEDS = f"(SELECT unnest(generate_series(7, {6 + SEEDS}))::BIGINT AS seed)"
_SH = f"{O1}, sd AS (SELECT *, {_keys_sql('series_id')} FROM o1, {_SEEDS} s), mv AS ({_moved_places_sql('sd', 'n')}), sh AS (SELECT a.*, b.y AS ys FROM mv a JOIN o1 b ON b.series_id = a.series_id AND b.rn = a.mv)"


def _shuffled(spark, d):
    return S.label_shuffle(_one(spark, d), ["series_id"], ["t"], 7, SEEDS)


@query("s9_label_shuffle", f"WITH {_SH} SELECT series_id, seed, t, round(ys, 6) AS y_shuffled FROM sh")
def s9(spark, d):
    return fixed(_shuffled(spark, d).select("series_id", "seed", "t", F.col("y_shuffled")))


_BL = f"{O1}, bl AS (SELECT *, row_number() OVER (PARTITION BY series_id, len ORDER BY day) - 1 AS rn, count(*) OVER (PARTITION BY series_id, len) AS n FROM (SELECT series_id, day, count(*) AS len FROM o1 GROUP BY 1, 2)), bs AS (SELECT *, {_keys_sql('series_id, len')} FROM bl, {_SEEDS} s)"
_AT = "att AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY t) AS k FROM o1), mp AS (SELECT a.series_id, a.day, a.seed, b.day AS src FROM mv a JOIN bl b ON b.series_id = a.series_id AND b.len = a.len AND b.rn = a.mv)"
_MV = "SELECT a.series_id, m.seed, a.t, round(b.y, 6) AS y_shuffled, m.src <> m.day AS moved FROM att a JOIN mp m ON m.series_id = a.series_id AND m.day = a.day JOIN att b ON b.series_id = a.series_id AND b.day = m.src AND b.k = a.k"


@query("s10_block_shuffle", f"WITH {_BL}, mv AS ({_moved_places_sql('bs', 'n')}), {_AT} {_MV}")
def s10(spark, d):
    return fixed(S.block_shuffle(_one(spark, d), ["series_id"], "day", "t", 7, SEEDS).select("series_id", "seed", "t", "y_shuffled", "moved"))


@query("s11_block_bootstrap", f"WITH {_BL}, mv AS (SELECT *, {_moved_sql(0, 'rn')} % n AS mv FROM bs), {_AT} {_MV}")
def s11(spark, d):
    return fixed(S.block_bootstrap(_one(spark, d), ["series_id"], "day", "t", 7, SEEDS).select("series_id", "seed", "t", "y_shuffled", "moved"))


_FB = f"""{O1}, fb AS (SELECT *, {_keys_sql('series_id')} FROM (SELECT DISTINCT series_id, rn // 24 AS blk, (n + 23) // 24 AS nb, n FROM o1), {_SEEDS} s), pos AS ({_permuted_sql('fb', 'blk', 'nb', 'pos')}),
st AS (SELECT *, coalesce(sum(least(24, n - blk * 24)) OVER (PARTITION BY series_id, seed ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pos),
nw AS (SELECT o1.series_id, st.seed, o1.y, st.start + o1.rn % 24 AS nn FROM o1 JOIN st ON st.series_id = o1.series_id AND st.blk = o1.rn // 24)"""


@query("s12_fixed_block_permutation", f"WITH {_FB} SELECT a.series_id, c.seed, a.t, round(c.y, 6) AS y_shuffled FROM o1 a JOIN nw c ON a.series_id = c.series_id AND a.rn = c.nn")
def s12(spark, d):
    return fixed(S.fixed_block_permutation(_one(spark, d), ["series_id"], ["t"], 24, 7, SEEDS).select("series_id", "seed", "t", "y_shuffled"))


_EF = f"{_SH}, ef AS (SELECT series_id, seed, covar_pop(f, ys) / nullif(stddev_pop(f) * stddev_pop(ys), 0) AS effect, covar_pop(f, y) / nullif(stddev_pop(f) * stddev_pop(y), 0) AS observed FROM sh GROUP BY 1, 2), gt AS (SELECT series_id, count(*) AS runs, count(*) FILTER (abs(effect) > abs(observed)) AS passes FROM ef GROUP BY 1)"


def _effects(spark, d):
    return _shuffled(spark, d).groupBy("series_id", "seed").agg(D.pearson("f", "y_shuffled").alias("effect"), D.pearson("f", "y").alias("observed"))


@query("s13_surrogate_gate", f"WITH {_EF} SELECT series_id, runs, passes, CAST(0 AS BIGINT) AS errors, round(passes / runs, 6) AS pass_rate, round((passes + 1) / (runs + 1), 6) AS p_bound FROM gt")
def s13(spark, d):
    return fixed(S.surrogate_gate(_effects(spark, d), ["series_id"]))


@query("s14_surrogate_calibration", f"WITH {_EF} SELECT count(DISTINCT series_id) AS studies, count(*) AS runs, count(*) FILTER (abs(effect) >= 0.05) AS passes, round(count(*) FILTER (abs(effect) >= 0.05) / count(*), 6) AS pass_rate FROM ef")
def s14(spark, d):
    hit = F.abs("effect") >= 0.05
    return fixed(_effects(spark, d).agg(F.count_distinct("series_id").alias("studies"), F.count("*").alias("runs"), F.count_if(hit).alias("passes"), F.avg(hit.cast("int")).alias("pass_rate")))


@query("s15_surrogate_p_bound", f"WITH {_EF} SELECT series_id, round((passes + 1) / (runs + 1), 6) AS p_bound FROM gt")
def s15(spark, d):
    return fixed(S.surrogate_gate(_effects(spark, d), ["series_id"]).select("series_id", "p_bound"))


_TS = f"{A.DAILY}, ts AS (SELECT series_id % 10 AS family, series_id AS test, 1 / (1 + abs(covar_pop(close, volume) / (stddev_pop(close) * stddev_pop(volume))) * sqrt(count(*))) ** 3 AS p, count(*) AS runs FROM daily GROUP BY 1, 2 HAVING count(*) > 2)"


def _tests(spark, d):
    c = F.abs(D.pearson("close", "volume")) * F.sqrt(F.count("*"))
    return A.daily(spark, d).groupBy((F.col("series_id") % 10).alias("family"), F.col("series_id").alias("test")).agg((1 / (1 + c) ** 3).alias("p"), F.count("*").alias("runs")).filter("runs > 2")


@query("s16_family_correction", f"WITH {_TS}, r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS k FROM ts), c AS (SELECT family, max(k) FILTER (p <= k * 0.1::DOUBLE / m) AS cut FROM r GROUP BY 1) SELECT family, test, round(p, 6) AS p, coalesce(k <= cut, false) AS bh_pass, p <= 0.1::DOUBLE / m AS bonferroni_pass, 1 / (runs + 1) <= 0.1::DOUBLE / m AS resolution_ok FROM r JOIN c USING (family)")
def s16(spark, d):
    return fixed(S.family_correction(_tests(spark, d), "family", "p", "runs").select("family", "test", "p", "bh_pass", "bonferroni_pass", "resolution_ok"))


_CM = f"{OBS}, cm AS (SELECT horizon_seconds, series_id, covar_pop(f, y) / (stddev_pop(f) * stddev_pop(y) FILTER (f IS NOT NULL)) AS est, 1 / sqrt(count(*) FILTER (f IS NOT NULL) - 1) AS se, count(*) FILTER (f IS NOT NULL) AS ne FROM obs GROUP BY 1, 2)"


def _components(spark, d):
    g = observations(spark, d).groupBy("horizon_seconds", "series_id").agg(D.pearson("f", "y").alias("estimate"), D.pairs("f", "y").alias("n_eff"))
    return g.withColumn("se", S.ic_standard_error(F.col("n_eff")))


@query("s17_pooled_metric", f"WITH {_CM} SELECT horizon_seconds, count(*) AS components, round(avg(est), 6) AS pooled_mean, round(sqrt(0.4::DOUBLE * sum(se * se) + 0.6::DOUBLE * sum(se) * sum(se)) / count(*), 6) AS pooled_se, CAST(floor(sum(ne) / (1 + 0.6::DOUBLE * (count(*) - 1))) AS BIGINT) AS pooled_n FROM cm GROUP BY 1")
def s17(spark, d):
    return fixed(S.pooled(_components(spark, d), ["horizon_seconds"], S.POOLED_CORRELATION["cross_symbol"]))


_PB = f"{OBS}, pb AS (SELECT *, liquidity >= 10 AS c, coalesce(f > 0.01, false) AS g FROM obs)"
_PBC = "count(*) FILTER (c) AS n_context, count(*) FILTER (c AND g) AS n_trigger, round(avg(y) FILTER (c AND g), 6) AS trigger_mean, round(avg(y) FILTER (c AND NOT g), 6) AS rest_mean, round(avg(y) FILTER (c AND g) - avg(y) FILTER (c AND NOT g), 6) AS lift"


def _probe(spark, d, by):
    return S.conditional_probe(observations(spark, d), by, S.predicate("liquidity", ">=", 10.0), S.predicate("f", ">", 0.01))


@query("s18_conditional_probe", f"WITH {_PB} SELECT {_B}, {_PBC} FROM pb GROUP BY {_B}")
def s18(spark, d):
    return fixed(_probe(spark, d, BY))


@query("s19_conditioned_power", f"WITH {_PB}, x AS (SELECT {_B}, greatest(1, CAST(floor(count(*) FILTER (c AND g) / (horizon_seconds / 3600)) AS BIGINT)) AS n_eff FROM pb GROUP BY {_B}) SELECT *, round(1 / sqrt(n_eff - 1), 6) AS ic_se, round(1.96 / sqrt(n_eff - 1), 6) AS min_detectable_ic FROM x")
def s19(spark, d):
    g = _probe(spark, d, BY).select(*BY, S.effective_n(F.col("n_trigger"), F.col("horizon_seconds") / 3600).alias("n_eff"))
    return fixed(S.power_report(g))


@query("s20_multi_partition_pool", f"WITH {_PB}, x AS (SELECT horizon_seconds, day, avg(y) FILTER (c AND g) - avg(y) FILTER (c AND NOT g) AS lift, count(*) FILTER (c AND g) AS nt FROM pb GROUP BY 1, 2), z AS (SELECT *, 1 / sqrt(nt - 1) AS se FROM x WHERE nt > 1 AND lift IS NOT NULL) SELECT horizon_seconds, count(*) AS components, round(avg(lift), 6) AS pooled_mean, round(sqrt(sum(se * se)) / count(*), 6) AS pooled_se, CAST(sum(nt) AS BIGINT) AS pooled_n FROM z GROUP BY 1")
def s20(spark, d):
    g = _probe(spark, d, ["horizon_seconds", "day"]).filter("n_trigger > 1 and lift is not null")
    c = g.select("horizon_seconds", F.col("lift").alias("estimate"), S.ic_standard_error(F.col("n_trigger")).alias("se"), F.col("n_trigger").alias("n_eff"))
    return fixed(S.pooled(c, ["horizon_seconds"], 0.0))


_RKS = f"{_BK}, rk AS (SELECT *, rank() OVER (PARTITION BY {_B} ORDER BY f) + (count(*) OVER (PARTITION BY {_B}, f) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {_B} ORDER BY y) + (count(*) OVER (PARTITION BY {_B}, y) - 1) / 2.0 AS ry FROM bk), bm AS (SELECT {_B}, bucket, avg(y) AS m FROM bk GROUP BY {_B}, bucket), bd AS (SELECT *, m - lag(m) OVER (PARTITION BY {_B} ORDER BY bucket) AS d FROM bm), mo AS (SELECT {_B}, bool_and(d >= 0) OR bool_and(d <= 0) AS mono FROM bd GROUP BY {_B}), st AS (SELECT {_B}, count(*) AS n, covar_pop(f, y) / (stddev_pop(f) * stddev_pop(y)) AS ic, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS ri FROM rk GROUP BY {_B})"


@query("s21_mechanism_state", f"WITH {_RKS} SELECT {_B}, CASE WHEN n < 100 THEN 'insufficient_sample' WHEN abs(ic) < 1.96 / sqrt(n - 1) THEN 'not_detectable' WHEN sign(ic) <> sign(ri) THEN 'inconsistent' WHEN mono THEN 'supported' ELSE 'non_monotonic' END AS state FROM st JOIN mo USING ({_B})")
def s21(spark, d):
    o = observations(spark, d)
    m = D.bucket_monotonicity(D.bucket_returns(o, BY, 5, ["t"]), BY)
    g = D.information_coefficients(o, BY).join(m, BY)
    least = S.Z_MULTIPLE * S.ic_standard_error(F.col("n"))
    return g.select(*BY, S.mechanism_state(F.col("pearson_ic"), F.col("rank_ic"), F.col("n"), least, F.col("non_decreasing") | F.col("non_increasing"), 100).alias("state"))


_LF = f"{O1}, lf AS (SELECT series_id, count(*) AS n, avg(y) AS my, avg(f) AS mf, avg(liquidity) AS ml, covar_pop(f, y) / (var_pop(f) + 0.01::DOUBLE) AS wf, covar_pop(liquidity, y) / (var_pop(liquidity) + 0.01::DOUBLE) AS wl FROM o1 GROUP BY 1)"
FEATURES = ["f", "liquidity"]


@query("s22_linear_fit", f"WITH {_LF} SELECT series_id, n, round(wf, 6) AS w_f, round(wl, 6) AS w_liquidity, round(my - wf * mf - wl * ml, 6) AS intercept FROM lf")
def s22(spark, d):
    return fixed(S.fit_linear(_one(spark, d), ["series_id"], FEATURES, "y", 0.01))


@query("s23_score_rows", f"WITH {_LF} SELECT series_id, t, round(my - wf * mf - wl * ml + wf * f + wl * liquidity, 6) AS score FROM o1 JOIN lf USING (series_id)")
def s23(spark, d):
    o = _one(spark, d)
    return fixed(S.score_rows(o, S.fit_linear(o, ["series_id"], FEATURES, "y", 0.01), ["series_id"], FEATURES).select("series_id", "t", "score"))


@query("s24_combine_scores", f"WITH {_LF}, s AS (SELECT series_id, t, my - wf * mf - wl * ml + wf * f + wl * liquidity AS score FROM o1 JOIN lf USING (series_id)) SELECT series_id, count(*) AS n, round(sum(score), 6) AS total FROM (SELECT * FROM s WHERE t % 7200 = 0 UNION ALL SELECT * FROM s WHERE t % 7200 <> 0) GROUP BY 1")
def s24(spark, d):
    o = _one(spark, d)
    s = S.score_rows(o, S.fit_linear(o, ["series_id"], FEATURES, "y", 0.01), ["series_id"], FEATURES).select("series_id", "t", "score")
    return fixed(S.combine_scores(s.filter("t % 7200 = 0"), s.filter("t % 7200 <> 0")).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("score").alias("total")))


@query("s25_walk_forward_scores", f"WITH {_WF}, stt AS (SELECT series_id, fold, min(t) AS s0 FROM wf WHERE role = 'validation' GROUP BY 1, 2), trn AS (SELECT wf.* FROM wf JOIN stt USING (series_id, fold) WHERE role = 'train' AND wf.t + 7201 <= s0), ft AS (SELECT series_id, fold, avg(y) AS my, avg(f) AS mf, avg(liquidity) AS ml, covar_pop(f, y) / var_pop(f) AS wf_, covar_pop(liquidity, y) / var_pop(liquidity) AS wl FROM trn GROUP BY 1, 2) SELECT series_id, fold, t, round(my - wf_ * mf - wl * ml + wf_ * f + wl * liquidity, 6) AS score FROM wf JOIN ft USING (series_id, fold) WHERE role = 'validation'")
def s25(spark, d):
    o = _one(spark, d).withColumn("known_t", F.unix_timestamp("label_available_ts"))
    return fixed(S.cross_validated_scores(o, ["series_id"], ["t"], FEATURES, "y", "known_t", **_WIN).select("series_id", "fold", "t", "score"))


@query("s26_trial_accounting", "SELECT o_orderpriority AS study, count(*) AS attempts, count(DISTINCT o_custkey % 40) AS variants, count(*) FILTER (o_orderstatus <> 'P') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderkey % 10 = 0) AS touched_oos, count(DISTINCT o_custkey % 40) > 30 AS over_budget FROM orders GROUP BY 1")
def s26(spark, d):
    o = A.table(spark, d, "orders")
    t = o.select(F.col("o_orderpriority").alias("study"), (F.col("o_custkey") % 40).alias("variant"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"), (F.col("o_orderkey") % 10 == 0).alias("touched_oos"))
    return S.trial_accounting(t, 30)


@query("s27_detection_statistic", f"WITH {OBS}, x AS (SELECT {_B}, count(*) FILTER (f IS NOT NULL) AS n, covar_pop(f, y) / (stddev_pop(f) * stddev_pop(y) FILTER (f IS NOT NULL)) AS ic FROM obs GROUP BY {_B}) SELECT {_B}, n, n AS n_eff, round(ic, 6) AS ic, round(1 / sqrt(n - 1), 6) AS ic_se, round(1.96 / sqrt(n - 1), 6) AS min_detectable_ic, abs(ic) >= 0.3 AS detected FROM x")
def s27(spark, d):
    return fixed(S.detection(observations(spark, d), BY, 0.3))


@query("s28_post_cost_level", f"WITH {_BK} SELECT {_B}, count(*) AS n, round(avg(y) * 1e4, 6) AS mean_bps, avg(y) * 1e4 > 2 * 1.5 AS clears_cost FROM bk WHERE bucket = 5 GROUP BY {_B}")
def s28(spark, d):
    b = D.with_bucket(observations(spark, d).filter("f is not null and y is not null"), BY, "f", 5, ["t"])
    return fixed(S.post_cost_level(b, BY, "bucket", 5, 2, 1.5))


@query("s29_holdout_exclusion", f"WITH {OBS} SELECT series_id, count(*) AS n FROM obs WHERE NOT (day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' OR day >= DATE '2024-01-25') GROUP BY 1")
def s29(spark, d):
    sealed = spark.createDataFrame([("2024-01-10", "2024-01-12"), ("2024-01-25", "2099-01-01")], "a string, b string").select(F.col("a").cast("date").alias("first"), F.col("b").cast("date").alias("last"))
    return S.exclude_holdout(observations(spark, d), sealed, "day").groupBy("series_id").agg(F.count("*").alias("n"))


_FRS = f"{OBS}, m AS (SELECT {_B}, avg(f) AS m, stddev_pop(f) AS s FROM obs GROUP BY {_B})"


@query("s30_main_effect_panel", f'WITH {_FRS} SELECT {_B}, count(*) AS "rows", {_C} AS pearson_ic, CAST(floor(count(*) / (horizon_seconds / 3600)) AS BIGINT) AS effective_rows FROM obs GROUP BY {_B}')
def s30(spark, d):
    r = D.factor_report(observations(spark, d), BY)
    return fixed(r.select(*BY, "rows", "pearson_ic", F.floor(F.col("rows") / (F.col("horizon_seconds") / 3600)).cast("long").alias("effective_rows")))


@query("s31_constant_factor_exclusion", f"WITH {A.DAILY} SELECT series_id, count(*) AS n FROM daily WHERE trade_count > 1 GROUP BY 1 HAVING max(trade_count) > min(trade_count)")
def s31(spark, d):
    return S.varying_factors(A.daily(spark, d).filter("trade_count > 1"), "series_id", "trade_count")


@query("j8_three_way_alignment", f"WITH {OBS}, c AS (SELECT series_id, t FROM bars WHERE volume >= 10), g AS (SELECT series_id, t FROM nb WHERE fv > 0.01) SELECT {_B}, count(*) AS n, round(avg(mfe), 6) AS mean_mfe FROM obs JOIN c USING (series_id, t) JOIN g USING (series_id, t) GROUP BY {_B}")
def j8(spark, d):
    from barloom.plans.observations import factors

    f = factors(spark, d)
    context, trigger = f.filter("volume >= 10").select("series_id", "t"), f.filter("f > 0.01").select("series_id", "t")
    j = observations(spark, d).join(context, ["series_id", "t"]).join(trigger, ["series_id", "t"])
    return fixed(j.groupBy(*BY).agg(F.count("*").alias("n"), F.avg("mfe").alias("mean_mfe")))
