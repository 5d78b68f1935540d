"""Factor and label diagnostics over observations: one row for each (series, time, horizon).

Columns used: factor f, forward return y; optional mfe, mae, tbs (target before
stop), steps, spread, liquidity, slippage, participation, regime, available_ts.
Every diagnostic takes grouping columns, so many factors or horizons are one
job; ranks are those of ``functions.ranks``, for groups of any size, all else is
one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import ranks as R
from barloom.functions import timeline as T

F_, Y = "f", "y"


def pearson(x, y) -> Column:
    """Correlation of the rows that have both; null for fewer than two or a flat side."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b)), F.try_divide(F.covar_pop(a, b), spread))


def pairs(x, y) -> Column:
    return F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))


def ranked(obs: DataFrame, by: list[str], x: str = F_, y: str = Y, one_task: bool | None = None) -> DataFrame:
    """Rows that have both values, with their ranks in the group (rank_x, rank_y); groups may be of any size."""
    have = obs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return R.average_rank(R.average_rank(have, by, x, "rank_x", one_task), by, y, "rank_y", one_task)


def information_coefficients(obs: DataFrame, by: list[str], x: str = F_, y: str = Y) -> DataFrame:
    """n, pearson_ic and rank_ic of each group."""
    return ranked(obs, by, x, y).groupBy(*by).agg(F.count("*").alias("n"), pearson(x, y).alias("pearson_ic"), pearson("rank_x", "rank_y").alias("rank_ic"))


def ic_decay(by_horizon: DataFrame, by: list[str], horizon: str = "horizon_seconds") -> DataFrame:
    """Change of the IC from the shortest to the longest horizon for each second between them."""
    first, last = F.min_by("pearson_ic", horizon), F.max_by("pearson_ic", horizon)
    span = F.max(horizon) - F.min(horizon)
    return by_horizon.groupBy(*by).agg(first.alias("first_ic"), last.alias("last_ic"), F.try_divide(last - first, F.nullif(span, F.lit(0))).alias("slope"))


def period_key(ts, period: str) -> Column:
    day = F.to_date(ts)
    iso_week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return {"day": F.date_format(day, "yyyy-MM-dd"), "month": F.date_format(day, "yyyy-MM"), "week": iso_week}[period]


def icir(ics: DataFrame, by: list[str], value: str = "pearson_ic") -> DataFrame:
    """Mean of ICs by their sample deviation; null for fewer than two or next to no deviation."""
    std = F.stddev_samp(value)
    return ics.groupBy(*by).agg(F.count(value).alias("periods"), F.avg(value).alias("mean_ic"), F.when(std > 1e-12, F.avg(value) / std).alias("icir"))


def with_bucket(obs: DataFrame, by: list[str], value: str, k: int, ties: list[str], name: str = "bucket", one_task: bool | None = None) -> DataFrame:
    """Equal-count buckets 1..k by place: min(k, floor(place * k / n) + 1), places from 0, ties by the given columns."""
    d = R.placed(obs, by, [value, *ties], "__place", "__n", one_task)
    return d.withColumn(name, F.least(F.lit(k), F.floor(F.col("__place") * k / F.col("__n")) + 1).cast("long")).drop("__place", "__n")


def bucket_returns(obs: DataFrame, by: list[str], k: int, ties: list[str]) -> DataFrame:
    """n, mean return and hit rate of each bucket of the factor."""
    b = with_bucket(obs.filter("f is not null and y is not null"), by, F_, k, ties)
    return b.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.avg(Y).alias("mean_return"), F.avg((F.col(Y) > 0).cast("int")).alias("hit_rate"))


def bucket_monotonicity(buckets: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("bucket")
    d = buckets.withColumn("d", F.col("mean_return") - F.lag("mean_return").over(w))
    d = d.withColumn("sign", F.when(F.col("d") != 0, F.signum("d"))).withColumn("last_sign", F.last("sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rising, falling = F.bool_and(F.col("d") >= 0), F.bool_and(F.col("d") <= 0)
    return d.groupBy(*by).agg(
        F.coalesce(rising, F.lit(True)).alias("non_decreasing"), F.coalesce(falling, F.lit(True)).alias("non_increasing"),
        F.count_if(F.col("sign") != F.col("last_sign")).alias("sign_changes"), pearson(F.col("bucket").cast("double"), "mean_return").alias("bucket_correlation"),
    )


def tail_expectancy(buckets: DataFrame, by: list[str]) -> DataFrame:
    return buckets.groupBy(*by).agg((F.max_by("mean_return", "bucket") - F.min_by("mean_return", "bucket")).alias("tail_expectancy"))


def u_shape(buckets: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the edge buckets, of the others, and the difference; null with fewer than three."""
    w = Window.partitionBy(*by)
    edge = (F.col("bucket") == F.min("bucket").over(w)) | (F.col("bucket") == F.max("bucket").over(w))
    g = buckets.withColumn("edge", edge).groupBy(*by).agg(F.count("*").alias("k"), F.avg(F.when(F.col("edge"), F.col("mean_return"))).alias("edge_mean"), F.avg(F.when(~F.col("edge"), F.col("mean_return"))).alias("center_mean"))
    return g.withColumn("u_shape", F.when(F.col("k") >= 3, F.col("edge_mean") - F.col("center_mean"))).drop("k")


def extreme_hit_rates(obs: DataFrame, by: list[str], k: int, ties: list[str]) -> DataFrame:
    b = with_bucket(obs.filter("f is not null and y is not null"), by, F_, k, ties)
    rate = lambda n: F.avg(F.when(F.col("bucket") == n, (F.col(Y) > 0).cast("int")))
    return b.groupBy(*by).agg(rate(1).alias("low_hit_rate"), rate(k).alias("high_hit_rate"))


def excursions_by_bucket(obs: DataFrame, by: list[str], k: int, ties: list[str]) -> DataFrame:
    b = with_bucket(obs.filter("f is not null and y is not null"), by, F_, k, ties)
    return b.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"), F.count("mfe").alias("n_mfe"))


# --- events, regimes, execution, management


def _mean(condition, what=Y) -> Column:
    return F.avg(F.when(condition, F.col(what) if isinstance(what, str) else what))


def event_study(obs: DataFrame, by: list[str], event: Column) -> DataFrame:
    """Counts and mean returns of events and the others, uplift, false breakouts, first targets and excursions."""
    e = F.coalesce(event, F.lit(False))
    d = obs.filter("y is not null").withColumn("__e", e)
    e = F.col("__e")
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(e).alias("events"), F.count_if(~e).alias("others"), _mean(e).alias("event_mean"), _mean(~e).alias("other_mean"), (_mean(e) - _mean(~e)).alias("uplift"),
        _mean(e, (F.col(Y) <= 0).cast("int")).alias("false_breakout_rate"), _mean(e, F.col("tbs").cast("int")).alias("target_first_rate"), _mean(e, "mfe").alias("event_mfe"), _mean(e, "mae").alias("event_mae"),
    )


def filter_effect(obs: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Uplift, coverage, false rejections and improvement of a filter."""
    d = obs.filter("y is not null").withColumn("__k", F.coalesce(keep, F.lit(False)))
    k, hit = F.col("__k"), (F.col(Y) > 0).cast("int")
    return d.groupBy(*by).agg(
        (_mean(k) - _mean(~k)).alias("uplift"), F.avg(k.cast("int")).alias("coverage"), _mean(F.col(Y) > 0, (~k).cast("int")).alias("false_rejection_rate"),
        (_mean(k) - F.avg(Y)).alias("mean_improvement"), (_mean(k, hit) - F.avg(hit)).alias("hit_rate_improvement"),
    )


def sensitivity(obs: DataFrame, by: list[str], field: str, k: int, ties: list[str]) -> DataFrame:
    """Correlation of a field with the return, and the return's mean in each of the field's buckets."""
    d = obs.filter(F.col(field).isNotNull() & F.col(Y).isNotNull())
    b = with_bucket(d, by, field, k, ties)
    means = [F.avg(F.when(F.col("bucket") == n, F.col(Y))).alias(f"bucket_{n}") for n in range(1, k + 1)]
    return b.groupBy(*by).agg(F.count("*").alias("n"), pearson(field, Y).alias("correlation"), *means)


def adverse_selection(obs: DataFrame, by: list[str]) -> DataFrame:
    side = F.when(F.col(F_) >= 0, 1).otherwise(-1)
    return obs.filter("f is not null and y is not null").groupBy(*by).agg((-F.avg(side * F.col(Y))).alias("adverse_selection"))


def execution_summary(obs: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Adverse selection and the correlation of each field with the return, as rows (by, measure, value) from one aggregation."""
    side = F.when(F.col(F_) >= 0, 1).when(F.col(F_).isNotNull(), -1)
    measures = {"adverse_selection": -F.avg(side * F.col(Y))} | {x: pearson(x, Y) for x in fields}
    wide = obs.groupBy(*by).agg(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("value")) for n, v in measures.items()]).alias("__measures"))
    return wide.select(*by, F.inline("__measures"))


def management_summary(obs: DataFrame, by: list[str]) -> DataFrame:
    """Target-first probability, mean steps to either, and what breakeven and trailing stops could have kept."""
    t = F.col("tbs")
    return obs.groupBy(*by).agg(
        F.avg(t.cast("int")).alias("target_before_stop"), _mean(t, "steps").alias("time_to_target"), _mean(F.col("stop_first"), "steps").alias("time_to_stop"),
        _mean(F.col("stop_first"), (F.col("mfe") > 0).cast("int")).alias("breakeven_usefulness"), F.avg((F.col("mfe") > F.greatest(F.col(Y), F.lit(0.0))).cast("int")).alias("trailing_usefulness"),
    )


def stability(obs: DataFrame, by: list[str], group: Column, name: str) -> DataFrame:
    """n, mean return and IC of each value of a grouping, null as unknown."""
    d = obs.filter("f is not null and y is not null").withColumn(name, F.coalesce(group.cast("string"), F.lit("unknown")))
    return d.groupBy(*by, name).agg(F.count("*").alias("n"), F.avg(Y).alias("mean_return"), pearson(F_, Y).alias("ic"))


def session_segment(index: str, segments: int, by: list[str]) -> Column:
    top = F.max(index).over(Window.partitionBy(*by))
    return F.least(F.lit(segments), F.floor(F.col(index) * segments / (top + 1)) + 1).cast("long")


def factor_correlations(values: DataFrame, factor: str, key: list[str], value: str = "value") -> DataFrame:
    """Pearson and rank correlation of every pair of factors over their common keys.

    Factors are few; each pair is one equi-join on the key, and no pair is met twice.
    """
    a = values.select(*key, F.col(factor).alias("factor_a"), F.col(value).alias("f"))
    b = values.select(*key, F.col(factor).alias("factor_b"), F.col(value).alias("y"))
    return information_coefficients(a.join(b, key).filter("factor_a < factor_b"), ["factor_a", "factor_b"])


def cross_sectional_rank(rows: DataFrame, at: str, instrument: str, value: str, available: str, decision: str) -> DataFrame:
    """Rank (value descending, then instrument) and percentile of what is known at the decision; others are flagged."""
    known = F.col(value).isNotNull() & (F.col(available) <= F.col(decision))
    d = rows.withColumn("known", F.coalesce(known, F.lit(False)))
    w = Window.partitionBy(at, "known")
    rank = F.row_number().over(w.orderBy(F.col(value).desc(), instrument))
    n = F.count("*").over(w)
    return d.withColumn("rank", F.when(F.col("known"), rank).cast("long")).withColumn("percentile", F.when(F.col("known"), F.when(n > 1, (n - rank) / (n - 1)).otherwise(1.0))).withColumn("missing", ~F.col("known"))


# --- reports


def factor_report(obs: DataFrame, by: list[str], outlier_z: float = 3.0) -> DataFrame:
    """Coverage, missing values, outliers and spread of a factor in one pass over two aggregates."""
    base = obs.groupBy(*by).agg(F.avg(F_).alias("__m"), F.stddev_pop(F_).alias("__s"))
    d = obs.join(base, by)
    z = F.abs(F.try_divide(F.col(F_) - F.col("__m"), F.col("__s")))
    return d.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count(F_).alias("values"), F.avg(F.col(F_).isNull().cast("int")).alias("missing_rate"), F.count_if(z > outlier_z).alias("outliers"),
        F.count_distinct(F_).alias("distinct_values"), (F.count_distinct(F_) <= 1).alias("constant"), pearson(F_, Y).alias("pearson_ic"),
    )


def label_report(labels: DataFrame, by: list[str], value: str = Y) -> DataFrame:
    """Class counts and balance, ambiguity and missing rate of labels."""
    v = F.col(value)
    up, down, flat = F.count_if(v > 0), F.count_if(v < 0), F.count_if(v == 0)
    have = F.count(value)
    return labels.groupBy(*by).agg(
        F.count("*").alias("rows"), up.alias("positive"), down.alias("negative"), flat.alias("neutral"), F.avg(v.isNull().cast("int")).alias("missing_rate"),
        F.try_divide(F.greatest(up, down, flat), have).alias("majority_share"), F.try_divide(F.least(up, down), have).alias("minority_share"), F.avg(F.coalesce(F.col("ambiguous"), F.lit(False)).cast("int")).alias("ambiguous_rate"),
    )


def horizon_coverage(labels: DataFrame, by: list[str], horizon: str = "horizon_seconds") -> DataFrame:
    """Horizons of each group's labels: their number, samples, labels without one, and the least by the most samples."""
    per = labels.groupBy(*by, horizon).agg(F.count("*").alias("__n"))
    some = F.col(horizon).isNotNull()
    n = F.when(some, F.col("__n"))
    return per.groupBy(*by).agg(
        F.count(horizon).alias("horizons"), F.coalesce(F.sum(n), F.lit(0)).alias("horizon_samples"), F.coalesce(F.sum(F.when(~some, F.col("__n"))), F.lit(0)).alias("missing_horizon"),
        F.min(horizon).alias("min_horizon"), F.max(horizon).alias("max_horizon"), F.min(n).alias("min_samples"), F.max(n).alias("max_samples"), F.try_divide(F.min(n), F.max(n)).alias("coverage_ratio"),
    )


def horizon_overlap(labels: DataFrame, by: list[str], start: str, end: str, one_task: bool | None = None) -> DataFrame:
    """Least and most labels whose span [start, end) holds a time, over the times from the first start to the last end.

    Starts and ends are summed by time and then in order, so no label meets
    another; a group longer than a task is summed in chunks of time.
    """
    spans = labels.filter(F.col(start) < F.col(end))
    turns = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d"))))
    steps = spans.select(*by, turns.alias("x")).groupBy(*by, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    if T.fits_one_task(labels) if one_task is None else one_task:
        open_ = steps.withColumn("open", F.sum("d").over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        open_ = T.running_total(steps, by, ["at"], "d", "open")
    last = open_.groupBy(*by).agg(F.max_by("open", "at").alias("__end"), F.max("at").alias("__at"))
    # after the last end nothing is open any more, so that step is no time between
    inside = T.attach(open_, last, by).filter(F.col("at") < F.col("__at"))
    return inside.groupBy(*by).agg(F.min("open").alias("min_overlap"), F.max("open").alias("max_overlap"))


def split_report(obs: DataFrame, by: list[str], bucket: Column, minimum: int) -> DataFrame:
    """For each bucket, the effect of keeping only its rows, from one aggregation and the groups' totals."""
    d = obs.withColumn("bucket", F.coalesce(bucket.cast("string"), F.lit("unknown")))
    hit = (F.col(Y) > 0).cast("int")
    per = d.groupBy(*by, "bucket").agg(F.count("*").alias("rows"), F.count(Y).alias("n"), F.sum(Y).alias("s"), F.sum(hit).alias("h"))
    w = Window.partitionBy(*by)
    tot = lambda c: F.sum(c).over(w)
    rest = tot("n") - F.col("n")
    mean = F.try_divide(F.col("s"), F.col("n"))
    out = per.select(
        *by, "bucket", "rows", (F.col("n") / tot("n")).alias("coverage"), (1 - F.col("n") / F.col("rows")).alias("missing_rate"),
        (mean - F.try_divide(tot("s") - F.col("s"), rest)).alias("uplift"), (mean - tot("s") / tot("n")).alias("mean_delta"), (F.try_divide(F.col("h"), F.col("n")) - tot("h") / tot("n")).alias("hit_rate_delta"),
        F.try_divide(tot("h") - F.col("h"), tot("h")).alias("false_rejection_rate"), (F.col("n") < minimum).alias("low_sample"),
    )
    return out


def alignment_coverage(rows: DataFrame, symbols: list[str], key: str = "event_ts", symbol: str = "series_id") -> DataFrame:
    """Event times by fault: repeated symbol, missing symbol, known after the decision, or aligned; with availability skew."""
    d = rows.filter(F.col(symbol).isin(*symbols)).groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct(symbol).alias("d"), F.max("available_ts").alias("hi"), F.min("available_ts").alias("lo"), F.min("decision_ts").alias("dec"), F.count_distinct("decision_ts").alias("decs")
    )
    fault = F.when(F.col("n") > F.col("d"), "duplicate_symbol").when(F.col("d") < len(symbols), "missing_symbol").when(F.col("decs") > 1, "decision_mismatch").when(F.col("hi") > F.col("dec"), "late").otherwise("aligned")
    skew = F.unix_timestamp("hi") - F.unix_timestamp("lo")
    return d.groupBy(fault.alias("status")).agg(F.count("*").alias("times"), F.max(skew).alias("max_skew_seconds"))


def market_pairs(markets: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(markets) for b in markets[i + 1 :]]


def _stacked(aligned: DataFrame, found: list[tuple[str, str, Column, Column]], extra: list[str]) -> DataFrame:
    """One row for each pair: (anchor, peer, x, y)."""
    rows = F.array(*[F.struct(F.lit(a).alias("anchor"), F.lit(b).alias("peer"), x.alias("x"), y.alias("y")) for a, b, x, y in found])
    return aligned.select(*extra, F.explode(rows).alias("p")).select(*extra, "p.*").filter("x is not null and y is not null")


def pair_correlations(aligned: DataFrame, markets: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    keys = [*by, "anchor", "peer"]
    d = _stacked(aligned, [(a, b, F.col(a), F.col(b)) for a, b in market_pairs(markets)], by)
    r = ranked(d, keys, "x", "y")
    gap = F.col("y") - F.col("x")
    return r.groupBy(*keys).agg(F.count("*").alias("n"), pearson("x", "y").alias("pearson"), pearson("rank_x", "rank_y").alias("rank"), F.avg(gap).alias("mean_gap"), F.avg(F.abs(gap)).alias("mean_abs_gap"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"))


def lead_lag(aligned: DataFrame, markets: list[str], lags: list[int], order: str = "event_ts", size: int = T.BLOCK_ROWS, chunk_seconds: int = T.DAY) -> DataFrame:
    """corr(leader k steps ago, target) for every ordered pair and lag, and the mean seconds between the two steps.

    Steps are rows in the order of a time; they meet in blocks that carry the longest lag's rows before them.
    """

    def build(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("__place")
        since = lambda k: F.col(order).cast("double") - F.lag(F.col(order).cast("double"), k).over(w)
        return d.select("*", *[F.lag(m, k).over(w).alias(f"{m}_{k}") for m in markets for k in lags], *[since(k).alias(f"__since_{k}") for k in lags])

    lagged = T.in_blocks(aligned, [], [order], build, max(lags), size=size, seconds=chunk_seconds)
    rows = F.array(*[
        F.struct(F.lit(a).alias("leader"), F.lit(b).alias("target"), F.lit(k).cast("long").alias("lag"), F.col(f"__since_{k}").alias("since"), F.col(f"{a}_{k}").alias("x"), F.col(b).alias("y"))
        for a in markets for b in markets if a != b for k in lags
    ])
    d = lagged.select(F.explode(rows).alias("p")).select("p.*").filter("x is not null and y is not null")
    return d.groupBy("leader", "target", "lag").agg(F.count("*").alias("n"), F.avg("since").alias("mean_lag_seconds"), pearson("x", "y").alias("correlation"))


def quality_report(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return values.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.avg((v.isNull() | F.isnan(v)).cast("int")).alias("missing_rate"), F.count_distinct(v).alias("distinct_values"),
        (F.count_distinct(v) <= 1).alias("constant"), F.count_if(F.col("available_ts") < F.col("event_ts")).alias("availability_violations"), F.count_if(F.size("value_flags") > 0).alias("flagged"),
    )


def coverage_rollup(values: DataFrame, dims: list[str], value: str = "value") -> DataFrame:
    """Rows, values and coverage at every grain of a rollup of the dimensions; null is the total."""
    return values.rollup(*dims).agg(F.count("*").alias("rows"), F.count(value).alias("values"), F.avg(F.col(value).isNotNull().cast("int")).alias("coverage"))


def coverage_against(values: DataFrame, expected: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Expected keys with the values found for them (column expected is their number)."""
    got = values.groupBy(*key).agg(F.count(value).alias("found"))
    return expected.join(got, key, "left").select(*key, "expected", F.coalesce("found", F.lit(0).cast("long")).alias("found"), (F.coalesce("found", F.lit(0).cast("long")) / F.col("expected")).alias("coverage"))


def joint_report(features: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Keys on either side, on both, and of those the features known after the label's event."""
    f = features.select(*key, F.col("available_ts").alias("__f"), F.col("value").alias("__v"), F.lit(1).alias("__a"))
    y = labels.select(*key, F.col("decision_ts").alias("__d"), F.lit(1).alias("__b"))
    j = f.join(y, key, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.agg(F.count("*").alias("keys"), F.count_if(both).alias("overlap"), F.count_if(F.col("__b").isNull()).alias("features_only"), F.count_if(F.col("__a").isNull()).alias("labels_only"), F.count_if(both & (F.col("__f") > F.col("__d"))).alias("late_features"), F.count_if(both & F.col("__v").isNull()).alias("missing_features"))


def no_lookahead_audit(panel: DataFrame, key: list[str]) -> DataFrame:
    """Counts of rows that break point in time: known after the decision, repeated, label no later than the factor."""
    twice = F.count("*").over(Window.partitionBy(*key)) > 1
    d = panel.withColumn("__twice", twice)
    rule = lambda name, bad: F.struct(F.lit(name).alias("rule"), F.count_if(bad).alias("n"))
    rows = d.agg(F.array(rule("available_after_decision", F.col("available_ts") > F.col("decision_ts")), rule("duplicate_key", F.col("__twice")), rule("label_not_after_factor", F.col("label_available_ts") <= F.col("available_ts"))).alias("r"))
    return rows.select(F.explode("r").alias("x")).select("x.rule", "x.n")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
