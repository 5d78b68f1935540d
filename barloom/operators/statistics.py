"""Effective samples, splits, surrogates, multiplicity, pooling and scoring.

Pseudo-random orders are keyed permutations of a row's place in its group, with
keys from md5 of the seed and the group, so they do not depend on the layout
and a SQL engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import permutation as P
from barloom.functions import ranks as R
from barloom.functions import timeline as T
from barloom.operators.diagnostics import pearson

Z_MULTIPLE = 1.96
FDR_ALPHA = 0.10
# fixed values: correlations assumed between pooled components
POOLED_CORRELATION = {"cross_horizon": 1.0, "cross_symbol": 0.6, "cross_family": 0.5}


def effective_n(rows: Column, discount: Column, purge: int = 0, embargo: int = 0) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor((rows - purge - embargo) / discount).cast("long"))


def session_day_units(obs: DataFrame, by: list[str], session: str, day: str) -> DataFrame:
    return obs.groupBy(*by).agg(
        F.count_distinct(session).alias("sessions"), F.count_distinct(day).alias("days"), F.count_distinct(session, day).alias("session_days"),
        F.count_if(F.col(session).isNull()).alias("missing_session"), F.count_if(F.col(day).isNull()).alias("missing_day"),
    )


def overlap_block(required_bars: Column, horizon_seconds: Column, cadence_seconds: int) -> Column:
    """Bars that neighbouring outcomes share: the required future bars, else the horizon in bars, at least one."""
    return F.greatest(F.coalesce(required_bars, F.ceil(horizon_seconds / cadence_seconds)), F.lit(1)).cast("long")


def ic_standard_error(n: Column) -> Column:
    return F.when(n > 1, 1 / F.sqrt(n - 1))


def power_report(stats: DataFrame, n: str = "n_eff", z: float = Z_MULTIPLE) -> DataFrame:
    se = ic_standard_error(F.col(n))
    return stats.withColumn("ic_se", se).withColumn("min_detectable_ic", z * se)


# --- splits


def numbered(obs: DataFrame, by: list[str], order: list[str], name: str = "rn", count: str | None = "n") -> DataFrame:
    """Places from 0 in the given order, and the number of rows (n) of each group."""
    return R.placed(obs, by, order, name, count)


def train_validation(obs: DataFrame, by: list[str], order: list[str], fraction: float, purge: int = 0, embargo: int = 0) -> DataFrame:
    """The last round(n * fraction) rows validate; the purge and embargo before them are left out (role gap)."""
    d = numbered(obs, by, order)
    start = F.col("n") - F.greatest(F.round(F.col("n") * fraction), F.lit(1.0))
    role = F.when(F.col("rn") >= start, "validation").when(F.col("rn") < start - purge - embargo, "train").otherwise("gap")
    return d.withColumn("role", role).drop("n")


def walk_forward(obs: DataFrame, by: list[str], order: list[str], train: int, validation: int, step: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """Rows with every fold they are in: fold k trains on [k*step, +train) and validates after purge and embargo.

    A row finds its folds by arithmetic on its place, so no folds are listed.
    """
    d = numbered(obs, by, order)
    length = train + purge + embargo + validation
    folds = F.floor((F.col("n") - length) / step) + 1
    lo = F.greatest(F.ceil((F.col("rn") - length + 1) / step), F.lit(0).cast("long"))
    hi = F.least(F.floor(F.col("rn") / step), folds - 1)
    d = d.withColumn("fold", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    at = F.col("rn") - F.col("fold") * step
    role = F.when(at < train, "train").when(at >= train + purge + embargo, "validation")
    return d.withColumn("role", role).filter("role is not null").drop("n")


def purge_embargo(rows: DataFrame, purge: int, embargo: int, by: list[str], place: str = "rn") -> DataFrame:
    """Train rows without those within [first - purge, last + embargo] of their group's validation rows."""
    w = Window.partitionBy(*by)
    v0, v1 = (f(F.when(F.col("role") == "validation", F.col(place))).over(w) for f in (F.min, F.max))
    near = (F.col("role") == "train") & (F.col(place) >= v0 - purge) & (F.col(place) <= v1 + embargo)
    return rows.withColumn("__near", F.coalesce(near, F.lit(False))).filter("not __near").drop("__near")


def walk_forward_defaults(half_life: int) -> dict[str, int]:
    """Windows from a half-life: train four, validate one, step one, purge a quarter."""
    return {"train": 4 * half_life, "validation": half_life, "step": half_life, "purge": half_life // 4, "embargo": 0}


# --- surrogates


def _draws(sizes: DataFrame, group: list[str], first_seed: int, seeds: int) -> DataFrame:
    """(group, n, seed, keys) for every group of a table of sizes and every seed."""
    each = sizes.withColumn("seed", F.explode(F.sequence(F.lit(first_seed).cast("long"), F.lit(first_seed + seeds - 1).cast("long"))))
    return P.with_keys(each, group)


def label_shuffle(obs: DataFrame, group: list[str], order: list[str], first_seed: int, seeds: int, label: str = "y") -> DataFrame:
    """Every row once for each seed, with the label of another row of its group (y_shuffled).

    Rows are numbered once, by ``order``, which must be unique in a group; a seed moves
    every place to another one by arithmetic.  A group of one row keeps its label.
    """
    d = numbered(obs, group, order, "__place", None)
    labels = d.select(*group, F.col("__place").alias("__from"), F.col(label).alias(f"{label}_shuffled"))
    draws = _draws(obs.groupBy(*group).agg(F.count("*").alias("__n")), group, first_seed, seeds)
    rows = P.moved_places(T.attach(d, draws, group), "__place", "__n", "__from")
    return T.attach(rows.select(*obs.columns, "seed", "__from"), labels, [*group, "__from"]).drop("__from")


def _blocks(obs: DataFrame, group: list[str], block: str) -> DataFrame:
    """Blocks with their length and their place among the blocks of that length (of which there are __n)."""
    b = obs.groupBy(*group, block).agg(F.count("*").alias("length"))
    w = Window.partitionBy(*group, "length")
    return b.withColumn("__place", F.row_number().over(w.orderBy(block)) - 1).withColumn("__n", F.count("*").over(w))


def _block_sources(obs: DataFrame, group: list[str], block: str, order: str, label: str, first_seed: int, seeds: int, choose) -> DataFrame:
    """Rows for each seed with the label at their place in the block that ``choose`` takes for theirs."""
    b, alike = _blocks(obs, group, block), [*group, "length"]
    draws = _draws(b.select(*alike, "__n").distinct(), alike, first_seed, seeds)
    chosen = choose(T.attach(b.drop("__n"), draws, alike), "__place", "__n", "__from")
    source = b.select(*alike, F.col("__place").alias("__from"), F.col(block).alias("source"))
    mapping = T.attach(chosen.select(*alike, block, "seed", "__from"), source, [*alike, "__from"]).select(*group, block, "seed", "source")
    at = obs.withColumn("__at", F.row_number().over(Window.partitionBy(*group, block).orderBy(order)))
    labels = at.select(*group, F.col(block).alias("source"), "__at", F.col(label).alias(f"{label}_shuffled"))
    moved = T.attach(at, mapping, [*group, block]).withColumn("moved", ~F.col("source").eqNullSafe(F.col(block)))
    return T.attach(moved, labels, [*group, "source", "__at"]).drop("__at")


def block_shuffle(obs: DataFrame, group: list[str], block: str, order: str, first_seed: int, seeds: int, label: str = "y") -> DataFrame:
    """Whole blocks (trade dates) take the labels of another block of the same length; a length met once stays (moved false)."""
    return _block_sources(obs, group, block, order, label, first_seed, seeds, P.moved_places)


def block_bootstrap(obs: DataFrame, group: list[str], block: str, order: str, first_seed: int, seeds: int, label: str = "y") -> DataFrame:
    """Whole blocks take the labels of a block of the same length drawn with replacement."""
    return _block_sources(obs, group, block, order, label, first_seed, seeds, P.picked_places)


def fixed_block_permutation(obs: DataFrame, group: list[str], order: list[str], size: int, first_seed: int, seeds: int, label: str = "y") -> DataFrame:
    """Blocks of ``size`` rows in time order, put in a drawn order whole; labels follow.

    All blocks but the last have one length, so the block at a new place, and
    the place in it, are found by arithmetic from where the last block went.
    """
    d = numbered(obs, group, order, "__place", None)
    labels = d.select(*group, F.col("__place").alias("__from"), F.col(label).alias(f"{label}_shuffled"))
    sizes = obs.groupBy(*group).agg(F.count("*").alias("__rows"))
    draws = _draws(sizes.withColumn("__n", F.ceil(F.col("__rows") / size).cast("long")).withColumn("__end", F.col("__n") - 1), group, first_seed, seeds)
    draws = P.permuted(draws, "__end", "__n", "__last").withColumn("__short", F.col("__rows") - F.col("__end") * size)
    place, last, short = F.col("__place"), F.col("__last") * size, F.col("__short")
    whole = lambda x: F.floor(x / size).cast("long")
    slot = F.when(place < last, whole(place)).when(place < last + short, F.col("__last")).otherwise(1 + whole(place - short))
    inside = F.when(place < last, place % size).when(place < last + short, place - last).otherwise((place - short) % size)
    rows = T.attach(d, draws, group).withColumn("__slot", slot).withColumn("__inside", inside)
    rows = P.permuted(rows, "__slot", "__n", "__block", inverse=True).withColumn("__from", F.col("__block") * size + F.col("__inside"))
    return T.attach(rows.select(*obs.columns, "seed", "__from"), labels, [*group, "__from"]).drop("__from")


def surrogate_gate(effects: DataFrame, by: list[str], observed: str = "observed", effect: str = "effect") -> DataFrame:
    """Surrogate runs stronger than the observed effect, their rate, and the bound (pass + 1) / (runs + 1)."""
    hit = F.abs(F.col(effect)) > F.abs(F.col(observed))
    g = effects.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(hit).alias("passes"), F.count_if(F.col(effect).isNull()).alias("errors"))
    return g.withColumn("pass_rate", F.col("passes") / F.col("runs")).withColumn("p_bound", p_upper_bound(F.col("passes"), F.col("runs")))


def p_upper_bound(passes: Column, runs: Column) -> Column:
    return (passes + 1) / (runs + 1)


def family_correction(tests: DataFrame, family: str, p: str, runs: str | None = None, alpha: float = FDR_ALPHA) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni decisions within a family, and whether the runs can resolve the threshold."""
    w = Window.partitionBy(family)
    d = tests.withColumn("m", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(p)))
    d = d.withColumn("line", F.col("place") * alpha / F.col("m"))
    cut = F.max(F.when(F.col(p) <= F.col("line"), F.col("place"))).over(w)
    d = d.withColumn("bh_pass", F.coalesce(F.rank().over(w.orderBy(p)) <= cut, F.lit(False))).withColumn("bonferroni_pass", F.col(p) <= alpha / F.col("m"))
    return d.withColumn("resolution_ok", 1 / (F.col(runs) + 1) <= alpha / F.col("m")) if runs else d


def pooled(components: DataFrame, by: list[str], rho: float) -> DataFrame:
    """Mean of the components, its error under one correlation between them, and the samples discounted by it."""
    se2, se = F.sum(F.col("se") ** 2), F.sum("se")
    k = F.count("*")
    g = components.groupBy(*by).agg(k.alias("components"), F.avg("estimate").alias("pooled_mean"), F.sqrt((1 - rho) * se2 + rho * se * se).alias("__s"), F.sum("n_eff").alias("__n"))
    c = F.col("components")
    return g.withColumn("pooled_se", F.col("__s") / c).withColumn("pooled_n", F.floor(F.col("__n") / (1 + rho * (c - 1))).cast("long")).drop("__s", "__n")


# --- conditional probes and scoring


OPERATORS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def predicate(field: str, operator: str, threshold) -> Column:
    return F.coalesce(OPERATORS[operator](F.col(field), F.lit(threshold)), F.lit(False))


def conditional_probe(panel: DataFrame, by: list[str], context: Column, trigger: Column, outcome: str = "y") -> DataFrame:
    """Mean outcome where context and trigger hold against the other rows of the context."""
    both, rest = context & trigger, context & ~trigger
    mean = lambda c: F.avg(F.when(c, F.col(outcome)))
    return panel.groupBy(*by).agg(F.count_if(context).alias("n_context"), F.count_if(both).alias("n_trigger"), mean(both).alias("trigger_mean"), mean(rest).alias("rest_mean"), (mean(both) - mean(rest)).alias("lift"))


def detection(obs: DataFrame, by: list[str], threshold: float, block: int = 1) -> DataFrame:
    g = obs.groupBy(*by).agg(F.count(F.when(F.col("f").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"), pearson("f", "y").alias("ic"))
    return power_report(g.withColumn("n_eff", effective_n(F.col("n"), F.lit(block)))).withColumn("detected", F.coalesce(F.abs("ic") >= threshold, F.lit(False)))


def mechanism_state(ic: Column, rank_ic: Column, n_eff: Column, minimum: Column, monotonic: Column, least_n: int) -> Column:
    return (
        F.when(n_eff < least_n, "insufficient_sample").when(F.coalesce(F.abs(ic) < minimum, F.lit(True)), "not_detectable")
        .when(F.signum(ic) != F.signum(rank_ic), "inconsistent").when(monotonic, "supported").otherwise("non_monotonic")
    )


def fit_linear(rows: DataFrame, by: list[str], features: list[str], label: str, l2: float = 0.0, gross: bool = False, ic_weighted: bool = False) -> DataFrame:
    """Per-feature weights cov / (var + l2) (or the IC), in one pass; gross scales them to sum 1 in size; with an intercept."""
    have = rows.filter(F.col(label).isNotNull())
    for f in features:
        have = have.filter(F.col(f).isNotNull())
    w = {f: pearson(f, label) if ic_weighted else F.try_divide(F.covar_pop(f, label), F.var_pop(f) + l2) for f in features}
    g = have.groupBy(*by).agg(F.count("*").alias("n"), F.avg(label).alias("__y"), *[F.avg(f).alias(f"__m_{f}") for f in features], *[F.coalesce(x, F.lit(0.0)).alias(f"w_{f}") for f, x in w.items()])
    total = sum((F.abs(f"w_{f}") for f in features), F.lit(0.0))
    if gross:
        g = g.select(*by, "n", "__y", *[f"__m_{f}" for f in features], *[F.coalesce(F.try_divide(F.col(f"w_{f}"), total), F.lit(0.0)).alias(f"w_{f}") for f in features])
    inner = sum((F.col(f"w_{f}") * F.col(f"__m_{f}") for f in features), F.lit(0.0))
    return g.withColumn("intercept", F.col("__y") - inner).drop("__y", *[f"__m_{f}" for f in features])


def score_rows(rows: DataFrame, fit: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    weights = fit.select(*by, "intercept", *[f"w_{f}" for f in features])
    s = sum((F.col(f"w_{f}") * F.col(f) for f in features), F.col("intercept"))
    return rows.join(weights, by).withColumn("score", s).drop("intercept", *[f"w_{f}" for f in features])


def combine_scores(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o)
    return first


def cross_validated_scores(obs: DataFrame, by: list[str], order: list[str], features: list[str], label: str, available: str, **windows) -> DataFrame:
    """Walk-forward folds: fit on each fold's train rows, score its validation rows; all folds are one job.

    The label must not be a feature, and train labels known only after the fold's first validation row are left out.
    """
    if label in features:
        raise ValueError("the label is among the features")
    folds = walk_forward(obs, by, order, **windows)
    keys = [*by, "fold"]
    start = folds.filter("role = 'validation'").groupBy(*keys).agg(F.min(order[0]).alias("__start"))
    train = folds.filter("role = 'train'").join(start, keys).filter(F.col(available) <= F.col("__start")).drop("__start")
    return score_rows(folds.filter("role = 'validation'"), fit_linear(train, keys, features, label), keys, features)


def trial_accounting(trials: DataFrame, budget: int) -> DataFrame:
    ok = F.col("status") == "ok"
    g = trials.groupBy("study").agg(F.count("*").alias("attempts"), F.count_distinct("variant").alias("variants"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.count_if("touched_oos").alias("touched_oos"))
    return g.withColumn("over_budget", F.col("variants") > budget)


def post_cost_level(obs: DataFrame, by: list[str], bucket: str, traded: int, legs: int, round_trip_bps: float) -> DataFrame:
    """Mean return of the traded bucket in bps, and whether it clears the cost of all legs."""
    g = obs.filter(F.col(bucket) == traded).groupBy(*by).agg(F.count("y").alias("n"), (F.avg("y") * 1e4).alias("mean_bps"))
    return g.withColumn("clears_cost", F.col("mean_bps") > legs * round_trip_bps)


def exclude_holdout(rows: DataFrame, holdout: DataFrame, date: str) -> DataFrame:
    """Rows whose date is in no sealed range (first, last) of the holdout table."""
    return rows.join(F.broadcast(holdout), (F.col(date) >= F.col("first")) & (F.col(date) <= F.col("last")), "left_anti")


def varying_factors(values: DataFrame, factor: str, value: str) -> DataFrame:
    """Factors whose values differ; constants are left out before calibration."""
    return values.groupBy(factor).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).filter("hi > lo").select(factor, "n")
