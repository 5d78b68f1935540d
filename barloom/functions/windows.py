"""Causal window primitives over ordered series.

A series is named by its key columns and ordered by available time with a full
tie-break.  Every rolling primitive returns a value column and a flags column:
too short a history is ``insufficient_window``, any gap (null) in the window
``input_gap``, a degenerate denominator its own reason; the value is then null.
Expressions over one Series share its sort, so Spark plans one Window for all.

``over`` is the way to apply them to a frame: where a series may be too long
for one task it is cut into blocks of rows, each with the rows around it that
the windows reach.  ``with_halo`` cuts into chunks of time instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import timeline as T

NO_FLAGS = "array<string>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flags(*named: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, as an array, or an empty array."""
    out = F.when(F.lit(False), F.array(F.lit("")))
    for name, condition in named:
        out = out.when(condition, F.array(F.lit(name)))
    return out.otherwise(F.array().cast(NO_FLAGS))


@dataclass(frozen=True)
class Series:
    """Key columns of a series, its order, and the segment that windows must not cross, if any."""

    keys: tuple[str, ...] = ("series_id",)
    order: tuple[str, ...] = ("available_ts",)
    segment: str | None = None

    def window(self):
        return Window.partitionBy(*self.keys, *([self.segment] if self.segment else [])).orderBy(*self.order)

    def rows(self, first: int, last: int):
        return self.window().rowsBetween(first, last)

    def trailing(self, n: int):
        return self.rows(-(n - 1), 0)

    def expanding(self):
        return self.rows(Window.unboundedPreceding, 0)

    def whole(self):
        """The series without its segment: returns look across segments and flag it."""
        return Window.partitionBy(*self.keys).orderBy(*self.order)


def over(df: DataFrame, s: Series, build: Callable[[DataFrame, Series], DataFrame], before: int = 0, after: int = 0, one_task: bool | None = None, size: int = T.BLOCK_ROWS) -> DataFrame:
    """build(frame, series), whose windows reach ``before`` rows back and ``after`` ahead, over series of any length.

    The series' order must be full and start with a time.  Expanding windows
    have no such reach: they need a segment that a task can hold, or the
    running values of ``timeline``.
    """
    if T.fits_one_task(df) if one_task is None else one_task:
        return build(df, s)
    return T.in_blocks(df, s.keys, s.order, lambda d, keys: build(d, replace(s, keys=tuple(keys))), before, after, size)


@dataclass(frozen=True)
class Point:
    value: Column
    flags: Column

    def named(self, name: str = "value") -> list[Column]:
        return [self.value.alias(name), self.flags.alias(f"{name}_flags")]


def _rolling(s: Series, value: Column, n: int, reduced: Callable, undefined: Column | None = None, reason: str = "undefined", gap: Column | None = None) -> Point:
    w = s.trailing(n)
    gap = value.isNull() if gap is None else gap
    short, gaps = F.count(F.lit(1)).over(w) < n, F.sum(gap.cast("int")).over(w) > 0
    bad = F.lit(False) if undefined is None else F.coalesce(undefined, F.lit(True))
    point = F.when(~short & ~gaps & ~bad, reduced(w))
    return Point(point, flags(("insufficient_window", short), ("input_gap", gaps), (reason, bad)))


def rolling_mean(s: Series, value, n: int) -> Point:
    v = col(value)
    return _rolling(s, v, n, lambda w: F.avg(v).over(w))


def rolling_sum(s: Series, value, n: int) -> Point:
    v = col(value)
    return _rolling(s, v, n, lambda w: F.sum(v).over(w))


def _std(v: Column, n: int, ddof: int, w) -> Column:
    # equal values have zero deviation, whatever a moving variance leaves over
    flat = F.max(v).over(w) == F.min(v).over(w)
    return F.when(flat, 0.0).otherwise((F.stddev_pop(v) if ddof == 0 else F.stddev_samp(v)).over(w))


def rolling_std(s: Series, value, n: int, ddof: int = 0) -> Point:
    v = col(value)
    return _rolling(s, v, n, lambda w: _std(v, n, ddof, w))


def rolling_volatility(s: Series, value, n: int, ddof: int = 0) -> Point:
    """Standard deviation of returns that are given as values."""
    return rolling_std(s, value, n, ddof)


def rolling_min(s: Series, value, n: int) -> Point:
    v = col(value)
    return _rolling(s, v, n, lambda w: F.min(v).over(w))


def rolling_max(s: Series, value, n: int) -> Point:
    v = col(value)
    return _rolling(s, v, n, lambda w: F.max(v).over(w))


def rolling_range(s: Series, value, n: int) -> Point:
    v = col(value)
    return _rolling(s, v, n, lambda w: F.max(v).over(w) - F.min(v).over(w))


def _return(s: Series, value: Column, h: int, made: Callable, positive: bool, label: Column | None) -> Point:
    w = s.whole()
    prior = F.lag(value, h).over(w)
    short = F.row_number().over(w) <= h
    reset = F.lit(False)
    if label is not None:
        changed = (label != F.lag(label).over(w)).cast("int")
        reset = F.sum(changed).over(w.rowsBetween(-(h - 1), 0)) > 0
    gap, zero = value.isNull() | prior.isNull(), prior == 0
    low = (value <= 0) | (prior <= 0) if positive else F.lit(False)
    good = ~short & ~F.coalesce(reset, F.lit(False)) & ~gap & ~zero & ~low
    return Point(
        F.when(good, made(value, prior)),
        flags(("insufficient_window", short), ("session_reset", reset), ("input_gap", gap), ("zero_denominator", zero), ("non_positive_price", low)),
    )


def simple_returns(s: Series, value, h: int = 1, label: str | None = None) -> Point:
    """x / x[h rows ago] - 1; with a label, none across a change of it."""
    return _return(s, col(value), h, lambda x, p: x / F.nullif(p, F.lit(0.0)) - 1, False, None if label is None else F.col(label))


def log_returns(s: Series, value, h: int = 1, label: str | None = None) -> Point:
    return _return(s, col(value), h, lambda x, p: F.ln(x / F.nullif(p, F.lit(0.0))), True, None if label is None else F.col(label))


def _wider(h: Column, l: Column, c: Column, prior: Column) -> Point:
    gap = h.isNull() | l.isNull() | c.isNull()
    wide = F.greatest(h - l, F.abs(h - prior), F.abs(l - prior))
    return Point(F.when(~gap, F.when(prior.isNull(), h - l).otherwise(wide)), flags(("input_gap", gap)))


def true_range(df: DataFrame, s: Series, out: str = "value", high="high", low="low", close="close", one_task: bool | None = None) -> DataFrame:
    """The frame with the range of the bar and its distance from the last close before it, gaps skipped, however far back."""
    if T.fits_one_task(df) if one_task is None else one_task:
        d = df.withColumn("__prior", F.last(close, ignorenulls=True).over(s.rows(Window.unboundedPreceding, -1)))
    else:
        d = T.last_before(df, [*s.keys, *([s.segment] if s.segment else [])], s.order, close, "__prior")
    return d.select("*", *_wider(col(high), col(low), col(close), F.col("__prior")).named(out)).drop("__prior")


def average_true_range(df: DataFrame, s: Series, n: int, out: str = "value", high="high", low="low", close="close") -> DataFrame:
    """The frame with the mean true range; a window over a window, so it takes the frame."""
    ranged = true_range(df, s, "__tr", high, low, close).drop("__tr_flags")
    return over(ranged, s, lambda d, w: d.select("*", *rolling_mean(w, "__tr", n).named(out)), n).drop("__tr")


def causal_zscore(s: Series, value, n: int, ddof: int = 0) -> Point:
    """Distance from the window's mean in standard deviations; a flat window has none."""
    v, w = col(value), s.trailing(n)
    flat = F.max(v).over(w) == F.min(v).over(w)
    std = (F.stddev_pop(v) if ddof == 0 else F.stddev_samp(v)).over(w)
    return _rolling(s, v, n, lambda w: F.try_divide(v - F.avg(v).over(w), std), flat, "zero_variance")


def causal_demean(s: Series, value, n: int) -> Point:
    v = col(value)
    return _rolling(s, v, n, lambda w: v - F.avg(v).over(w))


def causal_minmax(s: Series, value, n: int) -> Point:
    v, w = col(value), s.trailing(n)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return _rolling(s, v, n, lambda _: F.try_divide(v - low, high - low), low == high, "zero_range")


def segment_id(keys: tuple[str, ...], label: str, order: tuple[str, ...]) -> tuple[Column, Callable[[DataFrame], DataFrame]]:
    """Numbers contiguous runs of a label within a series: (changed flag, the frame with segment)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = lambda w: F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1))
    changed = new(w)

    def add(df: DataFrame, name: str = "segment") -> DataFrame:
        if T.fits_one_task(df):
            d = df.withColumn("__changed", changed)
            return d.withColumn(name, F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")
        d = over(df, Series(tuple(keys), tuple(order)), lambda d, s: d.withColumn("__changed", new(s.window())), 1, one_task=False)
        return T.running_total(d, keys, order, "__changed", name).drop("__changed")

    return changed, add


def session_reset_groups(df: DataFrame, s: Series, label: str = "session_label", name: str = "segment") -> DataFrame:
    return segment_id(s.keys, label, s.order)[1](df, name)


def centered_mean(s: Series, value, n: int) -> Point:
    """Offline only: half of the window lies in the future."""
    v, k = col(value), n // 2
    w = s.rows(-k, k)
    short, gaps = F.count(F.lit(1)).over(w) < 2 * k + 1, F.sum(v.isNull().cast("int")).over(w) > 0
    return Point(F.when(~short & ~gaps, F.avg(v).over(w)), flags(("insufficient_window", short), ("input_gap", gaps)))


def future_mean(s: Series, value, n: int) -> Point:
    """Offline only: the mean of the next n rows."""
    v, w = col(value), s.rows(1, n)
    short, gaps = F.count(F.lit(1)).over(w) < n, F.sum(v.isNull().cast("int")).over(w) > 0
    return Point(F.when(~short & ~gaps, F.avg(v).over(w)), flags(("insufficient_window", short), ("input_gap", gaps)))


def prior_window(s: Series, value, n: int, reduced: Callable[[Column], Column]) -> Column:
    """An aggregate of the n rows before this one; null if fewer, or if one is a gap."""
    v, w = col(value), s.rows(-n, -1)
    full = (F.count(F.lit(1)).over(w) == n) & (F.count(v).over(w) == n)
    return F.when(full, reduced(v).over(w))


def expanding(s: Series, value, reduced: Callable[[Column], Column]) -> Column:
    """A running aggregate since the segment's start."""
    return reduced(col(value)).over(s.expanding())


def pit_normalize(s: Series, value, window_bars: int, min_periods: int) -> Column:
    """Rolling z-score over the values that are there: zero for a flat window, null below min_periods."""
    v, w = col(value), s.trailing(window_bars)
    flat = F.max(v).over(w) == F.min(v).over(w)
    z = F.try_divide(v - F.avg(v).over(w), F.stddev_pop(v).over(w))
    return F.when(v.isNotNull() & (F.count(v).over(w) >= min_periods), F.when(flat, 0.0).otherwise(z))


def with_halo(df: DataFrame, ts: str, chunk: str, halo_seconds: int, chunk_seconds: int) -> DataFrame:
    """Rows dealt to chunks of time, each with the rows of the ``halo_seconds`` before it (in_halo).

    Add ``chunk`` to the series' keys, so one series spreads over many tasks, and
    drop the in_halo rows afterwards.  The halo must span what the windows look back.
    """
    sec = F.unix_timestamp(ts)
    own, last = F.floor(sec / chunk_seconds), F.floor((sec + halo_seconds) / chunk_seconds)
    return df.withColumn(chunk, F.explode(F.sequence(own, last))).withColumn("in_halo", F.col(chunk) != own)
