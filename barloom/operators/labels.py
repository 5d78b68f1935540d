"""Forward-looking labels: exact-timestamp returns, costs, paths and events.

A label looks ahead of its row and says when it can be known: the later of its
terminal's availability and its horizon's end.  Terminals meet by an equi-join
on (series, contract, time); paths look over the next real-trade bars of one
series and contract by row windows, so no bars are paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import sessions
from barloom.functions import timeline as T
from barloom.functions import windows as W
from barloom.functions.passage import first_passage

KEYS = ("series_id", "contract_id")
_PATH = W.Series(KEYS, ("event_ts",))


def terminals(rows: DataFrame, minutes: list[int], cols: list[str]) -> DataFrame:
    """Each row and horizon with the row of its series and contract at exactly that time: cols as terminal_*."""
    ahead = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in minutes])))
    ahead = ahead.withColumn("horizon_end_ts", F.col("event_ts") + F.make_dt_interval(mins=F.col("horizon")))
    other = rows.select(*[F.col(k).alias(f"__{k}") for k in KEYS], F.col("event_ts").alias("__ts"), F.col("available_ts").alias("terminal_available_ts"), *[F.col(c).alias(f"terminal_{c}") for c in cols])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in KEYS]) & (F.col("horizon_end_ts") == F.col("__ts"))
    met = ahead.join(other, on)
    return met.drop(*[f"__{k}" for k in KEYS], "__ts").withColumn("label_available_ts", F.greatest("terminal_available_ts", "horizon_end_ts"))


def guarded(labels: DataFrame) -> DataFrame:
    """Without the windows that cross a maintenance break."""
    return labels.filter(~sessions.crosses_maintenance(F.col("event_ts"), F.col("horizon_end_ts")))


def forward_returns(bars: DataFrame, minutes: list[int], guard: bool = True) -> DataFrame:
    """close at the terminal / close - 1; null with a flag where the source or terminal is not a trade."""
    met = terminals(bars, minutes, ["close"])
    met = guarded(met) if guard else met
    bad = F.col("close").isNull() | F.col("terminal_close").isNull()
    return met.withColumn("value", F.try_divide("terminal_close", "close") - 1).withColumn("value_flags", W.flags(("no_trade", bad)))


def mid_forward_returns(quotes: DataFrame, minutes: list[int], valid: Column, guard: bool = True) -> DataFrame:
    q = quotes.withColumn("mid", F.when(valid, (F.col("ask") + F.col("bid")) / 2))
    met = terminals(q, minutes, ["mid"])
    met = guarded(met) if guard else met
    bad = F.col("mid").isNull() | F.col("terminal_mid").isNull()
    return met.withColumn("value", F.try_divide("terminal_mid", "mid") - 1).withColumn("value_flags", W.flags(("invalid_quote", bad)))


def close_out_returns(bars: DataFrame, cutoff_minute: int, first_minute: int | None = None) -> DataFrame:
    """Return to the last bar of the trade date that ends by a local minute; only for rows before it."""
    end_minute = F.when(sessions.local_minute("event_ts") == 0, 24 * 60).otherwise(sessions.local_minute("event_ts"))
    day = bars.withColumn("trade_date", sessions.trade_date("bar_start_ts")).withColumn("__m", end_minute)
    inside = (F.col("__m") <= cutoff_minute) & (F.col("close").isNotNull())
    if first_minute is not None:
        inside = inside & (F.col("__m") > first_minute)
    last = day.filter(inside).groupBy(*KEYS, "trade_date").agg(F.max("event_ts").alias("horizon_end_ts"), F.max_by("close", "event_ts").alias("terminal_close"), F.max_by("available_ts", "event_ts").alias("label_available_ts"))
    met = day.drop("__m").join(last, [*KEYS, "trade_date"]).filter("event_ts < horizon_end_ts")
    return met.withColumn("value", F.try_divide("terminal_close", "close") - 1)


def collapse_quotes(quotes: DataFrame) -> DataFrame:
    """One quote for each (series, contract, bar end): the first known; a repeated key is flagged unusable."""
    w = Window.partitionBy(*KEYS, "bar_end_ts")
    q = quotes.withColumn("event_ts", F.col("bar_end_ts")).withColumn("duplicate_key", F.count("*").over(w) > 1)
    return q.withColumn("__n", F.row_number().over(w.orderBy("available_ts"))).filter("__n = 1").drop("__n")


def cost_adjusted_returns(quotes: DataFrame, minutes: list[int], valid: Column, fixed_bps: float = 1.0, entry_fraction: float = 0.5, exit_fraction: float = 0.5) -> DataFrame:
    """Mid return less fixed cost and shares of the entry and exit spreads; reasons for null in value_flags."""
    ok = valid & ~F.col("duplicate_key")
    q = quotes.withColumn("mid", F.when(ok, (F.col("ask") + F.col("bid")) / 2)).withColumn("spread", F.when(ok, F.col("ask") - F.col("bid")))
    met = terminals(q, minutes, ["mid", "spread", "duplicate_key"])
    cost = fixed_bps / 1e4 + entry_fraction * F.col("spread") / F.col("mid") + exit_fraction * F.col("terminal_spread") / F.col("terminal_mid")
    named = (("duplicate_quote_key", F.col("duplicate_key") | F.col("terminal_duplicate_key")), ("invalid_entry_quote", F.col("mid").isNull()), ("invalid_exit_quote", F.col("terminal_mid").isNull()))
    return met.withColumn("value", F.try_divide("terminal_mid", "mid") - 1 - cost).withColumn("value_flags", W.flags(*named))


# --- paths


def _ahead(n: int):
    return _PATH.rows(1, n)


def excursions(bars: DataFrame, n: int, long: bool = True) -> DataFrame:
    """mfe and mae of the next n real-trade bars of a series and contract, only where all n are there."""
    b = bars.filter("close is not null")
    w = _ahead(n)
    full = F.count(F.lit(1)).over(w) == n
    best, worst = F.max("high").over(w), F.min("low").over(w)
    up, down = best / F.col("close") - 1, worst / F.col("close") - 1
    mfe, mae = (up, down) if long else (1 - worst / F.col("close"), 1 - best / F.col("close"))
    out = b.withColumn("mfe", F.when(full, mfe)).withColumn("mae", F.when(full, mae))
    return out.withColumn("horizon_end_ts", F.when(full, F.max("event_ts").over(w))).withColumn("label_available_ts", F.when(full, F.max("available_ts").over(w)))


#: Bars ahead that a row holds itself; further ones are found by a descent through block extremes.
HELD = 64


def first_touch(bars: DataFrame, n: int, first: Column, second: Column, policy: str = "ambiguous", session: str | None = None, held: int = HELD) -> DataFrame:
    """Outcome of the first of the next n bars that meets a test on (high, low) against the row's levels.

    first and second are columns struct(high_at, low_at): a bar meets one if its
    high is at or above high_at or its low at or below low_at (null: no test).
    Adds outcome (first, second, both, none, session_end), steps and
    resolution_ts; a bar that meets both is resolved by policy: ambiguous, first
    or second.  No touch without all n bars leaves the outcome null: it is not
    known yet.  With a ``session`` column a row looks to the last bar of its
    session; if that is nearer than n bars, no touch is session_end there.
    """
    b = bars.filter("close is not null").withColumn("__a", first).withColumn("__b", second)
    b = _touched(b, n, session) if session is not None or n > held else _touched_ahead(b, n)
    hit = lambda level: F.coalesce(F.col("__hit.high") >= F.col(f"{level}.high_at"), F.lit(False)) | F.coalesce(F.col("__hit.low") <= F.col(f"{level}.low_at"), F.lit(False))
    both = {"ambiguous": "both", "first": "first", "second": "second"}[policy]
    found = F.when(hit("__a") & hit("__b"), both).when(hit("__a"), "first").otherwise("second")
    outcome = F.when(F.col("__hit").isNotNull(), found).when(F.col("__full"), "none").when(F.col("__cut"), "session_end")
    ends = F.col("__full") | F.col("__cut")
    out = b.withColumn("outcome", outcome).withColumn("steps", F.coalesce(F.col("__hit.steps"), F.when(ends, F.col("__steps"))).cast("long"))
    out = out.withColumn("resolution_ts", F.coalesce("__hit.event_ts", F.when(ends, F.col("__last.event_ts"))))
    out = out.withColumn("label_available_ts", F.coalesce("__hit.available_ts", F.when(ends, F.col("__last.available_ts"))))
    return out.withColumn("resolution_close", F.coalesce("__hit.close", F.when(ends, F.col("__last.close")))).drop("__a", "__b", "__hit", "__full", "__cut", "__last", "__steps")


_SEEN = ("event_ts", "available_ts", "close")


def _touched_ahead(b: DataFrame, n: int) -> DataFrame:
    """The next few bars of a row in the row."""
    b = b.withColumn("__next", F.collect_list(F.struct("high", "low", *_SEEN)).over(_ahead(n)))
    meets = lambda x, level: F.coalesce(x["high"] >= F.col(f"{level}.high_at"), F.lit(False)) | F.coalesce(x["low"] <= F.col(f"{level}.low_at"), F.lit(False))
    hits = F.transform("__next", lambda x, i: F.when(meets(x, "__a") | meets(x, "__b"), F.struct(x["high"].alias("high"), x["low"].alias("low"), *[x[c].alias(c) for c in _SEEN], (i + 1).cast("long").alias("steps"))))
    b = b.withColumn("__hit", F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))).withColumn("__full", F.size("__next") == n)
    return b.withColumn("__cut", F.lit(False)).withColumn("__last", F.get("__next", F.lit(n - 1))).withColumn("__steps", F.lit(n)).drop("__next")


def _touched(b: DataFrame, n: int, session: str | None) -> DataFrame:
    """Any number of bars ahead, or to the session's end, by first passage; the last bar looked at by an equi-join on its place."""
    up, down = F.least("__a.high_at", "__b.high_at"), F.greatest("__a.low_at", "__b.low_at")
    d = first_passage(b, KEYS, _PATH.order, n, up, down, _SEEN, session, "__hit")
    last = d.select(*KEYS, F.col("place").alias("end_place"), F.struct(*_SEEN).alias("__last"))
    d = T.attach(d, last, [*KEYS, "end_place"])
    full, ahead = F.col("place") + n <= F.col("end_place"), F.col("end_place") > F.col("place")
    # a session that ends on the row itself leaves nothing ahead: the row's own bar ends it
    cut = ~full & F.lit(session is not None) & (ahead | (F.col("end_place") < F.col("last_place")))
    return d.withColumn("__full", full).withColumn("__cut", cut).withColumn("__steps", F.col("end_place") - F.col("place")).drop("place", "end_place", "last_place")


def level(high_at=None, low_at=None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct((none if high_at is None else high_at).alias("high_at"), (none if low_at is None else low_at).alias("low_at"))


def barrier(bars: DataFrame, n: int, target: float, stop: float, long: bool = True, policy: str = "ambiguous") -> DataFrame:
    """target_before_stop (boolean) and triple_barrier (1, -1, 0); null where one bar meets both."""
    c = F.col("close")
    t, s = (level(high_at=c * (1 + target)), level(low_at=c * (1 - stop))) if long else (level(low_at=c * (1 - target)), level(high_at=c * (1 + stop)))
    d = first_touch(bars, n, t, s, {"ambiguous": "ambiguous", "target_first": "first", "stop_first": "second"}[policy])
    o = F.col("outcome")
    return d.withColumn("target_before_stop", F.when(o != "both", o == "first")).withColumn("triple_barrier", F.when(o == "first", 1).when(o == "second", -1).when(o == "none", 0).cast("long"))


def breakout_success(events: DataFrame, n: int, success: float, failure: float, up: bool = True) -> DataFrame:
    """True if the success level is met before the failure level, which a bar meeting both counts as."""
    c = F.col("close")
    bad, good = (level(low_at=c * (1 - failure)), level(high_at=c * (1 + success))) if up else (level(high_at=c * (1 + failure)), level(low_at=c * (1 - success)))
    d = first_touch(events, n, bad, good, "first")
    return d.withColumn("breakout_success", F.when(F.col("outcome").isNotNull(), F.col("outcome") == "second"))


def return_to_vwap(events: DataFrame, n: int, vwap: str = "vwap", tolerance_bps: float = 0.0) -> DataFrame:
    """True if a bar comes back to vwap, give or take, from the side the row starts on."""
    tol = F.col(vwap) * tolerance_bps / 1e4
    above = F.col("close") >= F.col(vwap)
    none = F.lit(None).cast("double")
    touch = level(high_at=F.when(~above, F.col(vwap) - tol).otherwise(none), low_at=F.when(above, F.col(vwap) + tol).otherwise(none))
    d = first_touch(events, n, touch, level())
    return d.withColumn("returned", F.when(F.col("outcome").isNotNull(), F.col("outcome") == "first"))


def sweep_outcome(events: DataFrame, n: int, continuation: float, reversal: float, buy_side: bool = True) -> DataFrame:
    """reversal, continuation or unresolved; reversal is tested first."""
    c = F.col("close")
    rev, con = (level(low_at=c * (1 - reversal)), level(high_at=c * (1 + continuation))) if buy_side else (level(high_at=c * (1 + reversal)), level(low_at=c * (1 - continuation)))
    d = first_touch(events, n, rev, con, "first")
    o = F.col("outcome")
    return d.withColumn("sweep_outcome", F.when(o == "first", "reversal").when(o == "second", "continuation").when(o == "none", "unresolved"))


def future_liquidity(quotes: DataFrame, n: int, valid: Column, cap_bps: float) -> DataFrame:
    """Whether the mean spread of the next n grid rows is within a cap; null if any quote is missing or invalid."""
    w = _ahead(n)
    bps = F.when(valid, (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 1e4)
    q = quotes.withColumn("__bps", bps)
    full = F.count("__bps").over(w) == n
    return q.withColumn("mean_spread_bps", F.when(full, F.avg("__bps").over(w))).withColumn("liquid", F.when(full, F.avg("__bps").over(w) <= cap_bps)).drop("__bps")


# --- generated label sets by bar index in a session


def generated(bars: DataFrame, horizons: list[int], key: tuple[str, ...] = ("series_id", "session_id"), index: str = "bar_index") -> DataFrame:
    """All standard labels of session bars, a row for each horizon: forward return, MFE/MAE with their bars,
    stop/target order inputs, realised volatility, spread and liquidity; a short future leaves them null.

    Bars of a session must have consecutive indices; a hole counts as too short a future.
    """
    s = W.Series(key, (index,))
    r = bars.withColumn("__r", F.col("close") / F.lag("close").over(s.window()) - 1)
    out = None
    for h in horizons:
        w = s.rows(1, h)
        full = (F.count(F.lit(1)).over(w) == h) & (F.max(index).over(w) == F.col(index) + h)
        last = F.last("close").over(w)
        high, low = F.max("high").over(w), F.min("low").over(w)
        later = r.select(
            *key, index, "t", F.lit(h).cast("long").alias("horizon"),
            F.when(full, last / F.col("close") - 1).alias("forward_return"), F.when(full, high / F.col("close") - 1).alias("mfe"), F.when(full, low / F.col("close") - 1).alias("mae"),
            F.when(full, F.max_by(index, F.struct("high", -F.col(index))).over(w)).cast("long").alias("mfe_bar"), F.when(full, F.min_by(index, F.struct("low", index)).over(w)).cast("long").alias("mae_bar"),
            F.when(full & F.lit(h >= 2), F.when(F.max("__r").over(w) == F.min("__r").over(w), 0.0).otherwise(F.stddev_pop("__r").over(w))).alias("realized_volatility"),
            F.when(full, F.sum("volume").over(w)).alias("future_volume"), F.when(full, F.avg("trade_count").over(w)).alias("future_trades"), F.when(full, F.max("available_ts").over(w)).alias("label_available_ts"),
        )
        out = later if out is None else out.unionByName(later)
    return out


def available_from(*sources) -> Column:
    return F.greatest(*sources)


def overlap_metadata(labels: DataFrame, sampling_minutes: int) -> DataFrame:
    """Rows and non-overlapping rows of each horizon (minutes)."""
    step = F.greatest(F.ceil(F.col("horizon") / sampling_minutes), F.lit(1).cast("long"))
    return labels.groupBy("horizon").agg(F.count("*").alias("rows")).withColumn("effective_rows", F.floor(F.col("rows") / step).cast("long"))


def label_issues(labels: DataFrame, key: list[str]) -> DataFrame:
    """Labels with the rules that they break: known too early, a value without a future, repeated key."""
    twice = F.count("*").over(Window.partitionBy(*key)) > 1
    rule = lambda name, bad: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    return labels.withColumn("issues", F.array_compact(F.array(
        rule("available_before_horizon_end", F.col("label_available_ts") < F.col("horizon_end_ts")), rule("available_before_event", F.col("label_available_ts") < F.col("event_ts")),
        rule("value_without_future", F.col("horizon_end_ts").isNull() & F.col("value").isNotNull()), rule("duplicate_key", twice),
    )))


def guard_drop_counts(labels: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Windows by horizon and the first guard that drops them."""
    reason = F.when(sessions.crosses_maintenance(F.col("event_ts"), F.col("horizon_end_ts")), "maintenance_crossing").otherwise("keep")
    return labels.withColumn("reason", reason).groupBy("horizon", "reason").agg(F.count("*").alias("windows"))
