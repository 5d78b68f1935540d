"""Signals, costs, sizing, exposure, position probes and parameter grids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.diagnostics import period_key

# fixed values: stress factors of the cost profiles and penalties of the sessions
STRESS_FACTORS = (1.0, 1.25, 1.5, 2.0)
SESSION_PENALTIES = {"RTH": 1.0, "ETH": 1.5, "ILLIQUID": 2.0}


def threshold_signal(value: str, entry: float, exit_: float) -> Column:
    v = F.col(value)
    return F.when(v >= entry, "ENTRY").when(v <= exit_, "EXIT").otherwise("HOLD")


def context_trigger_signal(rows: DataFrame, context: Column, trigger: Column, exposure: float) -> DataFrame:
    """ENTRY with the exposure where both predicates hold, else HOLD and flat."""
    both = F.coalesce(context & trigger, F.lit(False))
    return rows.withColumn("signal", F.when(both, "ENTRY").otherwise("HOLD")).withColumn("desired_exposure", F.when(both, exposure).otherwise(0.0))


def late_signals(signals: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Signals older than the latest of their sources became available."""
    s = sources.groupBy(*key).agg(F.max("available_ts").alias("source_available_ts"))
    return signals.join(s, key).filter(F.col("signal_ts") < F.col("source_available_ts"))


# --- positions


def desired_position(value: Column, threshold: Column, policy: str) -> Column:
    up, down = value >= threshold, value <= -threshold
    return {
        "long_only": F.when(up, 1).otherwise(0), "short_only": F.when(down, -1).otherwise(0), "long_short": F.when(up, 1).when(down, -1).otherwise(0)
    }[policy]


def next_bar_positions(obs: DataFrame, by: list[str], order: str, delay: int, threshold: str = "threshold", policy: str = "long_short") -> DataFrame:
    """Positions that follow the signal ``delay`` rows later, with fills, gross result and its running sum.

    late_signal marks a fill row that starts before its signal was known.
    """
    w = Window.partitionBy(*by).orderBy(order)
    d = obs.withColumn("desired", desired_position(F.coalesce("f", F.lit(0.0)), F.col(threshold), policy))
    d = d.withColumn("position", F.coalesce(F.lag("desired", delay).over(w), F.lit(0)))
    d = d.withColumn("late_signal", F.coalesce(F.lag("available_ts", delay).over(w) > F.col("event_ts"), F.lit(False)))
    d = d.withColumn("delta", F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))).withColumn("gross", F.col("position") * F.coalesce("y", F.lit(0.0)))
    return d.withColumn("gross_total", F.sum("gross").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def position_summary(positions: DataFrame, by: list[str], order: str) -> DataFrame:
    """Turnover, trades, total, expectancy and the largest fall of the running sum from its peak (which starts at 0)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = positions.withColumn("__peak", F.greatest(F.max("gross_total").over(w), F.lit(0.0)))
    trades = F.count_if(F.col("delta") != 0)
    return d.groupBy(*by).agg(
        F.count("*").alias("bars"), F.sum(F.abs("delta")).cast("long").alias("turnover"), trades.alias("trades"), F.sum("gross").alias("gross"),
        F.when(trades > 0, F.sum("gross") / trades).alias("expectancy"), F.max(F.col("__peak") - F.col("gross_total")).alias("drawdown"), F.count_if("late_signal").alias("late_signals"),
    )


def path_states(rows: DataFrame, by: list[str], period: Column, order: str, value: str, name: str = "period") -> DataFrame:
    """State of a running sum in each period: total, peak and trough (both at least, at most the start's 0), and deepest fall from a peak.

    States of neighbouring periods combine to that of both, so any coarser grain needs no rows.
    """
    d = rows.withColumn(name, period)
    w = Window.partitionBy(*by, name).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__run", F.sum(value).over(w))
    d = d.withColumn("__fall", F.greatest(F.max("__run").over(w), F.lit(0.0)) - F.col("__run"))
    return d.groupBy(*by, name).agg(
        F.sum(value).alias("total"), F.greatest(F.max("__run"), F.lit(0.0)).alias("peak"), F.least(F.min("__run"), F.lit(0.0)).alias("trough"), F.max("__fall").alias("fall"),
        F.count("*").alias("bars"), F.count_if(F.col("delta") != 0).alias("trades"), F.sum(F.abs("delta")).cast("long").alias("turnover"),
    )


def merged_states(states: DataFrame, by: list[str], period: str = "period") -> DataFrame:
    """One state for each group of period states: a fold over its periods in order."""
    kept = F.sort_array(F.collect_list(F.struct(F.col(period), "total", "peak", "trough", "fall")))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("total", "peak", "trough", "fall")])

    def merge(s, x):
        return F.struct(
            (s["total"] + x["total"]).alias("total"), F.greatest(s["peak"], s["total"] + x["peak"]).alias("peak"), F.least(s["trough"], s["total"] + x["trough"]).alias("trough"),
            F.greatest(s["fall"], x["fall"], s["peak"] - s["total"] - x["trough"]).alias("fall"),
        )

    g = states.groupBy(*by).agg(F.aggregate(kept, start, merge).alias("__s"), F.sum("bars").alias("bars"), F.sum("trades").alias("trades"), F.sum("turnover").alias("turnover"))
    return g.select(*by, "__s.*", "bars", "trades", "turnover")


def period_results(positions: DataFrame, by: list[str], ts: str, order: str, periods: tuple[str, ...] = ("month",), start_equity: float = 1.0, cost: float = 0.0) -> DataFrame:
    """Result of each configuration by period (day, week, month) and over all (grain total), from one pass over the rows.

    Days' states are taken once and combined to every grain.  net is the gross
    result less ``cost`` for each unit of turnover, final_equity the equity at
    the period's end, drawdown the deepest fall of the gross running sum inside
    the period.
    """
    days = path_states(positions, by, F.to_date(ts), order, "gross", "day")
    found = None
    for grain in (*periods, "total"):
        key = F.lit("") if grain == "total" else period_key(F.col("day"), grain)
        d = merged_states(days.withColumn("period", key), [*by, "period"], "day").withColumn("grain", F.lit(grain))
        found = d if found is None else found.unionByName(d)
    w = Window.partitionBy(*by, "grain").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    d = found.withColumn("net", F.col("total") - F.col("turnover") * cost)
    return d.select(*by, "grain", "period", "bars", "trades", "turnover", F.col("total").alias("gross"), "net", (start_equity + F.sum("net").over(w)).alias("final_equity"), F.col("fall").alias("drawdown"))


def with_grid(df: DataFrame, **parameters: list[float]) -> DataFrame:
    """Every row with every combination of the parameters."""
    for name, values in sorted(parameters.items()):
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def sweep_stability(summary: DataFrame, by: list[str]) -> DataFrame:
    """Spread of the results over a threshold sweep, and the share of thresholds with a gain."""
    return summary.groupBy(*by).agg(F.count("*").alias("thresholds"), F.min("gross").alias("worst"), F.max("gross").alias("best"), F.avg((F.col("gross") > 0).cast("int")).alias("positive_share"))


# --- costs of a fill: columns price, quantity, multiplier, spread, side, symbol, session


def notional() -> Column:
    return F.col("price") * F.col("quantity") * F.col("multiplier")


def fixed_commission(amount: float) -> Column:
    return F.lit(amount)


def per_unit_commission(amount: float) -> Column:
    return amount * F.col("quantity")


def bps_cost(bps: float, minimum: float = 0.0) -> Column:
    return F.greatest(notional() * bps / 1e4, F.lit(minimum))


def spread_cost(half: bool = True) -> Column:
    return F.coalesce("spread", F.lit(0.0)) * (0.5 if half else 1.0) * F.col("quantity") * F.col("multiplier")


def futures_fees(fills: DataFrame, schedule: DataFrame, version: str) -> DataFrame:
    """fee: the sum of the schedule's components (symbol, version, component, fee) for each contract; null if none."""
    s = schedule.filter(F.col("version") == version).groupBy("symbol").agg(F.sum("fee").alias("__fee"))
    return fills.join(s, "symbol", "left").withColumn("fee", F.col("__fee") * F.col("quantity")).drop("__fee")


def composite_cost(**components: Column) -> tuple[Column, Column]:
    """(total, map of the components)."""
    total = reduce(lambda a, b: a + b, components.values())
    return total, F.create_map(*[x for k, v in components.items() for x in (F.lit(k), v)])


def _side() -> Column:
    return F.when(F.col("side") == "buy", 1).otherwise(-1)


def bps_slippage(bps: float) -> Column:
    """Price after slippage against the side."""
    return F.col("price") * (1 + _side() * bps / 1e4)


def spread_slippage(fraction: float = 0.25, fallback_bps: float = 1.0) -> Column:
    return F.col("price") + _side() * F.coalesce(F.col("spread") * fraction, F.col("price") * fallback_bps / 1e4)


def proxy_slippage(proxy: Callable, *columns: str) -> Column:
    """User code: a function of pandas Series that gives bps."""
    bps = F.pandas_udf(proxy, "double")(*columns)
    return F.col("price") * (1 + _side() * bps / 1e4)


def composite_slippage(*bps: Column) -> Column:
    return F.col("price") * (1 + _side() * reduce(lambda a, b: a + b, bps) / 1e4)


def participation_cap(requested: str, volume: str, cap: float = 0.10) -> tuple[Column, Column]:
    """(filled, participation): what the bar's volume allows of a request."""
    filled = F.least(F.col(requested), F.coalesce(volume, F.lit(0.0)) * cap)
    return filled, F.coalesce(F.try_divide(filled, F.col(volume)), F.lit(0.0))


def liquidity_policy(requested: str, volume: str, cap: float = 0.10, reject: bool = False, penalty_bps: float = 0.0) -> tuple[Column, Column, Column]:
    """(filled, flag, penalty bps)."""
    filled, _ = participation_cap(requested, volume, cap)
    none, over = F.coalesce(volume, F.lit(0.0)) <= 0, F.col(requested) > filled
    flag = F.when(none, "no_liquidity").when(over, "rejected" if reject else "capped").otherwise("ok")
    return F.when(none | (over & F.lit(reject)), 0.0).otherwise(filled), flag, F.when(over & ~none & F.lit(not reject), penalty_bps).otherwise(0.0)


def cost_stress(fills: DataFrame, cost: str, by: list[str], session: str = "session") -> DataFrame:
    """Cost of each stress profile and session, with penalties, and its rise from the first profile."""
    penalty = reduce(lambda c, x: c.when(F.col(session) == x[0], x[1]), SESSION_PENALTIES.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    base = fills.withColumn("__c", F.col(cost) * penalty).groupBy(*by, session).agg(F.count("*").alias("fills"), F.sum("__c").alias("__s"))
    p = with_grid(base, profile=list(STRESS_FACTORS))
    return p.select(*by, session, "profile", "fills", (F.col("__s") * F.col("profile")).alias("cost"), (F.col("__s") * (F.col("profile") - 1)).alias("gradient"))


# --- sizing and exposure


def fixed_notional_size(amount: float, minimum: float = 0.0, fractional: bool = False) -> tuple[Column, Column]:
    return _sized(amount * F.coalesce("desired_exposure", F.lit(1.0)), minimum, fractional)


def risk_size(equity: str, risk: float, stop: str, minimum: float = 0.0, fractional: bool = False) -> tuple[Column, Column]:
    raw = F.try_divide(F.col(equity) * risk * F.col("price"), F.col(stop)) * F.coalesce("desired_exposure", F.lit(1.0))
    return _sized(raw, minimum, fractional)


def _sized(raw: Column, minimum: float, fractional: bool) -> tuple[Column, Column]:
    """(notional, quantity): nothing under the minimum; whole units unless fractional."""
    kept = F.when(raw < minimum, 0.0).otherwise(raw)
    quantity = F.coalesce(F.try_divide(kept, F.col("price")), F.lit(0.0))
    whole = quantity if fractional else F.floor(quantity).cast("double")
    return whole * F.col("price") if not fractional else kept, whole


def scale_exposure(targets: DataFrame, at: list[str], notional_col: str, equity: str, max_gross: float, max_net: float) -> DataFrame:
    """Targets (signed notional) of each time scaled to the gross limit, then to the net limit."""
    w = Window.partitionBy(*at)
    gross = F.sum(F.abs(notional_col)).over(w)
    d = targets.withColumn("__g", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(equity) * max_gross, gross), F.lit(1.0)))).withColumn("__n", F.col(notional_col) * F.col("__g"))
    net = F.abs(F.sum("__n").over(w))
    d = d.withColumn("__s", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(equity) * max_net, net), F.lit(1.0))))
    return d.withColumn("target", F.col("__n") * F.col("__s")).drop("__g", "__n", "__s")


def exposure_by(targets: DataFrame, at: list[str], groups: list[str]) -> DataFrame:
    parts = [targets.groupBy(*at, F.lit(g).alias("level"), F.col(g).alias("name")).agg(F.sum(F.abs("target")).alias("gross"), F.sum("target").alias("net")) for g in groups]
    return reduce(lambda a, b: a.unionByName(b), parts)


def portfolio_limits(decisions: DataFrame, at: list[str], order: str, equity: float, max_instruments: int, max_position: float, max_gross: float, capital: float, max_net: float | None = None, side: str | None = None, policy: str = "cap") -> DataFrame:
    """Limits in turn: repeats, active instruments, position share, gross scale, net scale, then capital spent in order.

    ``side`` is a column of 1 and -1 for the net limit; without it all are long.
    Everything is a window over the decisions of one time.  Under the policy
    "cap" a decision that does not fit takes what is left, which is a running
    sum cut at the capital; under "reject" it gets nothing and later ones that
    fit still do, which is a fold over the active ones (max_instruments at most).
    """
    w = Window.partitionBy(*at)
    d = decisions.withColumn("__rep", F.row_number().over(w.partitionBy(*at, "instrument_id").orderBy(order)) > 1)
    live = (F.col("notional") > 0) & ~F.col("__rep")
    d = d.withColumn("__k", F.when(live, F.sum(live.cast("int")).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))))
    reason = F.when(F.col("__rep") & (F.col("notional") > 0), "repeated_instrument").when(F.col("__k") > max_instruments, "max_active_instruments")
    d = d.withColumn("reason", reason).withColumn("__x", F.when(F.col("reason").isNull(), F.least(F.col("notional"), F.lit(equity * max_position))).otherwise(0.0))
    d = d.withColumn("__x", F.col("__x") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(equity * max_gross), F.sum("__x").over(w)), F.lit(1.0))))
    if max_net is not None:
        net = F.abs(F.sum(F.col("__x") * (F.col(side) if side else F.lit(1.0))).over(w))
        d = d.withColumn("__x", F.col("__x") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(equity * max_net), net), F.lit(1.0))))
    if policy == "reject":
        active = F.sort_array(F.collect_list(F.when(F.col("__x") > 0, F.struct(F.col(order).alias("k"), F.col("__x").alias("x")))).over(w))
        start = F.struct(F.lit(float(capital)).alias("left"), F.array().cast(f"array<{dict(d.dtypes)[order]}>").alias("taken"))
        spend = lambda s, e: F.when(e["x"] <= s["left"], F.struct((s["left"] - e["x"]).alias("left"), F.concat(s["taken"], F.array(e["k"])).alias("taken"))).otherwise(s)
        d = d.withColumn("__taken", F.aggregate(active, start, spend)["taken"])
        d = d.withColumn("allocated", F.when((F.col("__x") > 0) & F.array_contains("__taken", F.col(order)), F.col("__x")).otherwise(0.0)).drop("__taken")
        short = F.col("reason").isNull() & (F.col("allocated") < F.col("__x"))
        return d.withColumn("reason", F.when(short, "insufficient_capital").otherwise(F.col("reason"))).drop("__rep", "__k", "__x")
    before = F.coalesce(F.sum("__x").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = d.withColumn("allocated", F.least(F.col("__x"), F.greatest(capital - before, F.lit(0.0))))
    short = F.col("reason").isNull() & (F.col("allocated") < F.col("__x"))
    return d.withColumn("reason", F.when(short, "insufficient_capital").otherwise(F.col("reason"))).drop("__rep", "__k", "__x")


# --- equity and grids


def equity_metrics(equity: DataFrame, by: list[str], order: str, value: str, seconds: str) -> DataFrame:
    """Returns, exact median cadence, Sharpe of a year of that cadence (population deviation) and the largest drawdown."""
    w = Window.partitionBy(*by).orderBy(order)
    prior = F.lag(value).over(w)
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = equity.withColumn("__r", F.when(prior != 0, (F.col(value) - prior) / F.nullif(prior, F.lit(0.0)))).withColumn("__gap", F.col(seconds) - F.lag(seconds).over(w)).withColumn("__dd", F.when(peak > 0, (peak - F.col(value)) / peak))
    g = d.groupBy(*by).agg(
        F.count("__r").alias("n"), F.avg("__r").alias("mean"), F.stddev_pop("__r").alias("sd"), F.percentile(F.when(F.col("__gap") > 0, F.col("__gap")), F.lit(0.5)).alias("cadence_seconds"), F.max("__dd").alias("max_drawdown"),
        F.max_by(value, order).alias("final_equity"),
    )
    year = F.lit(365 * 86400) / F.col("cadence_seconds")
    return g.withColumn("sharpe", F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("mean") / F.col("sd") * F.sqrt(year))).drop("mean", "sd")


def leaderboard(results: DataFrame, k: int) -> DataFrame:
    """The best k: net result, then final equity, then lower costs, then configuration."""
    return results.orderBy(F.desc("net"), F.desc("final_equity"), "costs", "config_id").limit(k)


def first_touch_exits(entries: DataFrame, n: int, stops: list[Column], reward: float, long: bool = True, session: str | None = None) -> DataFrame:
    """Exit of each entry: the most conservative stop, a target of reward times the risk, after n bars, or at the session's end.

    A bar that meets both counts as stopped; n bars that end with the session
    count as n bars.  Exits by time are at the bid (a long one) or ask of the
    bar where there is one, else at its close.
    """
    from barloom.operators import labels as L

    c = F.col("close")
    stop = stops[0] if len(stops) == 1 else F.greatest(*stops) if long else F.least(*stops)
    e = entries.withColumn("stop_price", stop).withColumn("target_price", c + (c - F.col("stop_price")) * reward)
    s, t = (L.level(low_at=F.col("stop_price")), L.level(high_at=F.col("target_price"))) if long else (L.level(high_at=F.col("stop_price")), L.level(low_at=F.col("target_price")))
    side = "bid" if long else "ask"
    quoted = side in entries.columns
    if quoted:  # the price to leave at stands in for the close while paths are looked at
        e = e.withColumn("__close", c).withColumn("close", F.coalesce(side, "close"))
    d = L.first_touch(e, n, s, t, "first", session)
    if quoted:
        d = d.withColumn("close", F.col("__close")).drop("__close")
    o = F.col("outcome")
    named = F.when(o == "first", "stop").when(o == "second", "target").when(o == "none", "time").when(o == "session_end", "session_end")
    price = F.when(o == "first", F.col("stop_price")).when(o == "second", F.col("target_price")).when(o.isNotNull(), F.col("resolution_close"))
    return d.withColumn("exit", named).withColumn("exit_price", price).drop("resolution_close")


def apply_user_factor(bars: DataFrame, compute: Callable, inputs: list[str], key: list[str], order: str, warm_up: int, out: str = "value") -> DataFrame:
    """User code over one series at a time: compute(frame of the declared inputs in order) gives a value for each row.

    Only the declared columns reach the function; the first warm_up rows are null and flagged.
    """
    kinds = dict(bars.dtypes)
    cols = list(dict.fromkeys([*key, order, *inputs]))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + f", {out} double, {out}_flags array<string>"

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        values = compute(pdf[inputs].copy())
        warm = pdf.index < warm_up
        pdf[out] = values.where(~warm) if hasattr(values, "where") else values
        pdf[f"{out}_flags"] = [["warm_up"] if x else [] for x in warm]
        return pdf

    return bars.select(*cols).groupBy(*key).applyInPandas(run, schema)
