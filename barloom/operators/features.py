"""Feature families: trade bars, sessions, structure.  Every feature is frame in, frame with value and value_flags out.

Inputs are bars of a dense grid: hours or minutes without a trade have null
prices.  ``segment`` (see windows.session_reset_groups) numbers the contiguous
sessions of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import sessions
from barloom.functions import timeline as T
from barloom.functions import windows as W

SERIES = W.Series()
SESSION = W.Series(segment="segment")
WINDOW = 20


def _with(df: DataFrame, value: Column, *named: tuple[str, Column]) -> DataFrame:
    """value where no named reason to have none holds; the first reason that does is the flag."""
    bad = F.lit(False)
    for _, condition in named:
        bad = bad | F.coalesce(condition, F.lit(False))
    return df.withColumn("value", F.when(~bad, value)).withColumn("value_flags", W.flags(*named))


def _point(df: DataFrame, p: W.Point) -> DataFrame:
    return df.select("*", *p.named())


def _rolled(df: DataFrame, make, before: int, s: W.Series = SERIES) -> DataFrame:
    """The frame with the point that ``make`` builds over a series whose windows reach ``before`` rows back."""
    return W.over(df, s, lambda d, w: _point(d, make(w)), before)


# --- trade bars


def returns(df, horizon: int = 1, label: str | None = None):
    return _rolled(df, lambda s: W.simple_returns(s, "close", horizon, label), horizon)


def log_returns(df, horizon: int = 1, label: str | None = None):
    return _rolled(df, lambda s: W.log_returns(s, "close", horizon, label), horizon)


def rolling_volatility(df, window: int = WINDOW, horizon: int = 1, ddof: int = 0):
    def build(d, s):
        return _point(d.withColumn("__r", W.simple_returns(s, "close", horizon).value), W.rolling_std(s, "__r", window, ddof)).drop("__r")

    return W.over(df, SERIES, build, window + horizon)


def rolling_range(df, window: int = WINDOW):
    def make(s):
        high, low = W.rolling_max(s, "high", window), W.rolling_min(s, "low", window)
        return W.Point(high.value - low.value, high.flags)

    return _rolled(df, make, window)


def atr(df, window: int = WINDOW):
    return W.average_true_range(df, SERIES, window)


def volume_zscore(df, window: int = WINDOW):
    return _rolled(df, lambda s: W.causal_zscore(s, "volume", window), window)


def rolling_volume(df, window: int = WINDOW):
    return _rolled(df, lambda s: W.rolling_sum(s, "volume", window), window)


def session_minute(df):
    first = F.first("bar_start_ts").over(SESSION.expanding())
    return _with(df, ((F.unix_timestamp("bar_start_ts") - F.unix_timestamp(first)) / 60).cast("long"))


def session_flag(df, label: str):
    return _with(df, (F.col("session_label") == label).cast("long"))


def _opening(df, minutes: int) -> DataFrame:
    """Running extremes of the first minutes of each segment."""
    first = F.first("bar_start_ts").over(SESSION.expanding())
    inside = F.unix_timestamp("bar_start_ts") < F.unix_timestamp(first) + 60 * minutes
    d = df.withColumn("__in", inside)
    w = SESSION.expanding()
    return d.withColumn("open_high", F.max(F.when(F.col("__in"), F.col("high"))).over(w)).withColumn("open_low", F.min(F.when(F.col("__in"), F.col("low"))).over(w)).drop("__in")


def opening_range(df, minutes: int = 60):
    d = _opening(df, minutes)
    return _with(d, F.col("open_high") - F.col("open_low"), ("outside_rth", F.col("session_label") != "RTH"), ("no_opening_trade", F.col("open_high").isNull()))


def overnight_range(df):
    """Running ETH range; the following RTH segment holds the range that the ETH segment ended with."""
    w = SESSION.expanding()
    d = df.withColumn("__range", F.max("high").over(w) - F.min("low").over(w))
    ended = d.groupBy("series_id", (F.col("segment") + 1).alias("segment")).agg(F.max_by("__range", "t").alias("__held"), F.first("session_label").alias("__of"))
    d = d.join(ended, ["series_id", "segment"], "left")
    eth = F.col("session_label") == "ETH"
    held = F.when(F.col("__of") == "ETH", F.col("__held"))
    return _with(d, F.when(eth, F.col("__range")).otherwise(held), ("no_overnight_trade", eth & F.col("__range").isNull()), ("no_overnight_range", ~eth & held.isNull())).drop("__range", "__held", "__of")


def _vwap(w) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.try_divide(F.sum(typical * F.col("volume")).over(w), F.sum(F.when(F.col("close").isNotNull(), F.col("volume"))).over(w))




def _traded() -> tuple:
    return ("no_trade", F.col("close").isNull()), ("zero_volume", F.coalesce(F.col("volume"), F.lit(0.0)) <= 0)


def vwap(df, session_reset: bool = True):
    return _with(df, _vwap((SESSION if session_reset else SERIES).expanding()), *_traded())


def anchored_vwap(df, anchor: str = "RTH"):
    """VWAP since the start of the latest segment with the anchor label."""

    def build(d, s):
        before = F.lag("segment").over(s.window())
        starts = (F.col("session_label") == anchor) & (before.isNull() | (before != F.col("segment")))
        return d.withColumn("__start", F.coalesce(starts, F.lit(False)).cast("int"))

    d = W.over(df, SERIES, build, 1)
    if T.fits_one_task(df):
        d = d.withColumn("__anchor", F.sum("__start").over(SERIES.expanding()))
    else:
        d = T.running_total(d, SERIES.keys, SERIES.order, "__start", "__anchor")
    return _with(d, _vwap(W.Series(segment="__anchor").expanding()), ("before_anchor", F.col("__anchor") == 0), *_traded()).drop("__start", "__anchor")


def distance_to_vwap(df):
    d = vwap(df).withColumnRenamed("value", "__vwap").drop("value_flags")
    return _with(d, F.try_divide(F.col("close") - F.col("__vwap"), F.col("__vwap")), *_traded(), ("zero_denominator", F.col("__vwap") == 0)).drop("__vwap")


def range_position(df, window: int = WINDOW):
    def make(s):
        high, low = W.rolling_max(s, "high", window), W.rolling_min(s, "low", window)
        flat = high.value == low.value
        return W.Point(F.try_divide(F.col("close") - low.value, high.value - low.value), F.when(flat, F.array(F.lit("zero_range"))).otherwise(high.flags))

    return _rolled(df, make, window)


def trendiness(df, window: int = WINDOW):
    """Net move over the window by the sum of its steps."""

    def build(df, s):
        d = df.withColumn("__step", F.abs(F.col("close") - F.lag("close").over(s.window())))
        p = W.rolling_mean(s, "close", window)
        moved = F.sum("__step").over(s.rows(-(window - 2), 0))
        value = F.when(p.value.isNotNull(), F.try_divide(F.abs(F.col("close") - F.lag("close", window - 1).over(s.window())), moved))
        return _point(d, W.Point(value, F.when(p.value.isNotNull() & (moved == 0), F.array(F.lit("zero_movement"))).otherwise(p.flags))).drop("__step")

    return W.over(df, SERIES, build, window)


# --- sessions and calendar


def session_id(df):
    return _with(df, sessions.segment_key(F.col("series_id"), F.col("bar_start_ts")))


def rth_minutes(df, from_open: bool = True):
    """Whole minutes since the RTH open, or to the close; none outside RTH."""
    m = sessions.local_minute("bar_start_ts")
    value = (m - sessions.RTH_OPEN if from_open else sessions.RTH_CLOSE - m).cast("long")
    return _with(df, value, ("before_rth", m < sessions.RTH_OPEN), ("after_rth", m >= sessions.RTH_CLOSE))


def day_of_week(df):
    """Weekday of the UTC bar start, Monday 0."""
    return _with(df, F.weekday("bar_start_ts").cast("long"))


def to_roll(df, minutes: bool = False):
    """Offline: bars or minutes to the next contract."""
    d = sessions.run_boundaries(df, ("series_id",), "available_ts", "contract_id", "bar_start_ts")
    return _with(d, F.col("minutes_to_change" if minutes else "bars_to_change"), ("no_future_roll", F.col("bars_to_change").isNull())).drop("bars_to_change", "minutes_to_change")


def _as_of(df: DataFrame, facts: DataFrame, fact: str) -> DataFrame:
    """The latest fact (series_id, known_ts, fact) known at each row, by a union and a running last."""
    both = df.withColumn(fact, F.lit(None).cast(dict(facts.dtypes)[fact])).withColumn("__k", F.col("available_ts")).withColumn("__row", F.lit(1))
    empty = [F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c != "series_id"]
    other = facts.select("series_id", *empty, F.col(fact), F.col("known_ts").alias("__k"), F.lit(0).alias("__row"))
    w = Window.partitionBy("series_id").orderBy("__k", "__row").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other).withColumn(fact, F.last(fact, ignorenulls=True).over(w)).filter("__row = 1").drop("__k", "__row")


def minutes_to_expiration(df, expirations: DataFrame):
    """Minutes to the expiry known as of the row (series_id, known_ts, expiry_ts); none if unknown or past."""
    d = _as_of(df, expirations, "expiry_ts")
    left = ((F.unix_timestamp("expiry_ts") - F.unix_timestamp("bar_start_ts")) / 60).cast("long")
    return _with(d, left, ("missing_expiration", F.col("expiry_ts").isNull()), ("expired", left < 0)).drop("expiry_ts")


def halt_status(df, statuses: DataFrame, halts: tuple[str, ...] = ("halt", "halted", "suspended")):
    """1 where the status known as of the row (series_id, known_ts, status) is a halt."""
    d = _as_of(df, statuses, "status")
    return _with(d, F.lower("status").isin(*halts).cast("long"), ("missing_status", F.col("status").isNull())).drop("status")


def is_opex_day(df):
    d = sessions.trade_date("bar_start_ts")
    return _with(df, (d == sessions.third_friday(d)).cast("long"))


def is_quad_witch_day(df):
    d = sessions.trade_date("bar_start_ts")
    return _with(df, ((d == sessions.third_friday(d)) & F.month(d).isin(3, 6, 9, 12)).cast("long"))


def is_period_end_session(df, calendar: DataFrame, quarter: bool = False):
    """1 on the last session date of its month (quarter: of the third month); none outside the calendar's years."""
    last = calendar.groupBy(F.trunc("date", "month").alias("__m")).agg(F.max("date").alias("__last"))
    years = calendar.agg(F.min(F.year("date")).alias("__y0"), F.max(F.year("date")).alias("__y1"))
    d = df.withColumn("__d", sessions.trade_date("bar_start_ts")).crossJoin(F.broadcast(years))
    d = d.join(last, F.trunc("__d", "month") == F.col("__m"), "left")
    hit = F.coalesce(F.col("__d") == F.col("__last"), F.lit(False)) & (F.month("__d").isin(3, 6, 9, 12) if quarter else F.lit(True))
    return _with(d, hit.cast("long"), ("outside_calendar", ~F.year("__d").between(F.col("__y0"), F.col("__y1")))).drop("__d", "__m", "__last", "__y0", "__y1")


def in_roll_window(df):
    return _with(df, sessions.in_roll_window(F.to_date(sessions.local("bar_start_ts"))).cast("long"))


# --- structure


def _prior(df, window: int, session: bool) -> DataFrame:
    def build(d, s):
        return d.withColumn("__high", W.prior_window(s, "high", window, F.max)).withColumn("__low", W.prior_window(s, "low", window, F.min))

    return W.over(df, SESSION if session else SERIES, build, window)


def _gap(x) -> tuple:
    return ("no_trade", F.col("close").isNull()), ("input_gap", x.isNull())


def prior_distance(df, high: bool = True, window: int = WINDOW, session: bool = False):
    x = F.col("__high" if high else "__low")
    return _with(_prior(df, window, session), F.col("close") - x, *_gap(x)).drop("__high", "__low")


def opening_range_distance(df, high: bool = True, minutes: int = 60, session: str = "RTH"):
    d = _opening(df, minutes)
    x = F.col("open_high" if high else "open_low")
    return _with(d, F.col("close") - x, ("no_trade", F.col("close").isNull()), ("outside_opening_session", F.col("session_label") != session), ("no_opening_trade", x.isNull()))


def sweep(df, high: bool = True, window: int = WINDOW, session: bool = False, failed: bool = False):
    """1 where the bar passes the prior extreme; failed: and closes back inside."""
    x = F.col("__high" if high else "__low")
    hit = F.col("high") > x if high else F.col("low") < x
    if failed:
        hit = hit & (F.col("close") <= x if high else F.col("close") >= x)
    return _with(_prior(df, window, session), hit.cast("long"), *_gap(x)).drop("__high", "__low")


def close_location(df):
    r = F.col("high") - F.col("low")
    return _with(df, F.try_divide(F.col("close") - F.col("low"), r), ("no_trade", F.col("close").isNull()), ("zero_range", r <= 0))


def wick_rejection(df):
    r = F.col("high") - F.col("low")
    lower, upper = F.least("open", "close") - F.col("low"), F.col("high") - F.greatest("open", "close")
    return _with(df, F.try_divide(lower - upper, r), ("no_trade", F.col("close").isNull()), ("zero_range", r <= 0))


def range_contraction(df, window: int = WINDOW, session: bool = False):
    d = df.withColumn("__r", F.col("high") - F.col("low"))
    d = W.over(d, SESSION if session else SERIES, lambda d, s: d.withColumn("__mean", W.prior_window(s, "__r", window, F.avg)), window)
    return _with(d, 1 - F.try_divide(F.col("__r"), F.col("__mean")), *_gap(F.col("__mean")), ("zero_prior_range", F.col("__mean") <= 0), ("zero_range", F.col("__r") <= 0)).drop("__r", "__mean")


def merge_quote_flags(df, quotes: DataFrame):
    """Adds the flags of the quote that became available at the same time to value_flags."""
    q = quotes.select("series_id", "available_ts", F.col("quality_flags").alias("__q"))
    return df.join(q, ["series_id", "available_ts"], "left").withColumn("value_flags", F.array_sort(F.array_union("value_flags", F.coalesce("__q", F.array().cast("array<string>"))))).drop("__q")
