"""Sessions, trade dates, calendars and contract rolls as column expressions and dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/Chicago"
# fixed values: minutes of the local day
RTH_OPEN, RTH_CLOSE, TRADE_DATE_ROLL = 8 * 60 + 30, 15 * 60, 17 * 60
BREAK_START, BREAK_END = 16 * 60, 17 * 60
ROLL_OFFSET_DAYS, ROLL_BEFORE, ROLL_AFTER = 8, 2, 1


def local(ts, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_minute(ts, zone: str = ZONE) -> Column:
    t = local(ts, zone)
    return F.hour(t) * 60 + F.minute(t)


def session_label(ts, zone: str = ZONE) -> Column:
    """RTH from 08:30 to before 15:00 local time, else ETH; daylight saving follows the zone."""
    m = local_minute(ts, zone)
    return F.when((m >= RTH_OPEN) & (m < RTH_CLOSE), "RTH").otherwise("ETH")


def trade_date(ts, zone: str = ZONE) -> Column:
    """Local date, the next one from 17:00 on."""
    return F.date_add(F.to_date(local(ts, zone)), F.when(local_minute(ts, zone) >= TRADE_DATE_ROLL, 1).otherwise(0))


def segment_key(series, ts, zone: str = ZONE) -> Column:
    """series:trade date:label."""
    return F.concat_ws(":", series, trade_date(ts, zone).cast("string"), session_label(ts, zone))


def third_friday(date) -> Column:
    """Third Friday of a date's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(date, "month"), 1), "Fri"), 14)


def roll_date(date, offset: int = ROLL_OFFSET_DAYS) -> Column:
    return F.date_sub(third_friday(date), offset)


def roll_calendar(spark: SparkSession, roots: DataFrame, first_year: int, last_year: int, offset: int = ROLL_OFFSET_DAYS) -> DataFrame:
    """(root, from_contract, to_contract, roll_date) of the quarterly months for every root (column root)."""
    months = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(3), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(1)), F.expr("interval 3 month"))).alias("m"))
    code = lambda d: F.concat(F.col("root"), F.element_at(F.array(*[F.lit(c) for c in "HMUZ"]), F.quarter(d)), F.date_format(d, "yy"))
    return roots.select("root").distinct().crossJoin(F.broadcast(months)).select("root", code(F.col("m")).alias("from_contract"), code(F.add_months("m", 3)).alias("to_contract"), roll_date(F.col("m"), offset).alias("roll_date"))


def in_roll_window(date: Column, before: int = ROLL_BEFORE, after: int = ROLL_AFTER) -> Column:
    """Whether a date is near the roll of its own, the previous or the next quarterly month."""
    near = F.lit(False)
    for shift in (-1, 0, 1):
        m = F.add_months(date, shift)
        r = roll_date(m)
        near = near | (F.month(m).isin(3, 6, 9, 12) & (date >= F.date_sub(r, before)) & (date <= F.date_add(r, after)))
    return near


def roll_guard(rows: DataFrame, calendar: DataFrame, root: str, entry: str, terminal: str, policy: str = "drop") -> DataFrame:
    """Adds rolls_crossed, first_roll and guard_action (keep, drop, truncate, flag) for entry < roll <= terminal.

    More than one roll in the window is ambiguous and dropped under every policy.
    """
    # the calendar is folded to one list a root, so rows are neither grouped nor repeated
    rolls = calendar.groupBy(F.col("root").alias("__root")).agg(F.sort_array(F.collect_list("roll_date")).alias("__rolls"))
    first, last = F.to_date(local(entry)), F.to_date(local(terminal))
    crossed = F.coalesce(F.filter("__rolls", lambda r: (first < r) & (r <= last)), F.array().cast("array<date>"))
    met = rows.join(rolls, F.col(root) == F.col("__root"), "left").withColumn("__crossed", crossed)
    met = met.select(*[F.col(f"`{c}`") for c in rows.columns], F.size("__crossed").cast("long").alias("rolls_crossed"), F.get("__crossed", F.lit(0)).alias("first_roll"))
    return met.withColumn("guard_action", F.when(F.col("rolls_crossed") == 0, "keep").when(F.col("rolls_crossed") == 1, policy).otherwise("drop"))


def crosses_maintenance(entry, terminal, zone: str = ZONE) -> Column:
    """Whether [entry, terminal] meets 16:00-17:00 local time of any day it touches."""
    a, b = local(entry, zone), local(terminal, zone)
    days = F.sequence(F.to_date(a), F.to_date(b))
    at = lambda d, minutes: d.cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes))
    return F.when(b < a, False).otherwise(F.exists(days, lambda d: (a < at(d, BREAK_END)) & (b > at(d, BREAK_START))))


def expand_calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame | None = None, half_days: DataFrame | None = None) -> DataFrame:
    """Sessions (date, open_ts, close_ts, half_day, bars) of weekdays without holidays; half days close at noon."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")).filter(F.weekday("date") < 5)
    if holidays is not None:
        days = days.join(holidays.select("date"), "date", "left_anti")
    half = F.lit(False)
    if half_days is not None:
        days = days.join(half_days.select("date", F.lit(True).alias("__half")), "date", "left")
        half = F.coalesce("__half", F.lit(False))
    at = lambda minutes: F.to_utc_timestamp(F.col("date").cast("timestamp") + F.make_dt_interval(mins=minutes), ZONE)
    close = F.when(half, 12 * 60).otherwise(RTH_CLOSE)
    return days.select("date", at(F.lit(RTH_OPEN)).alias("open_ts"), at(close).alias("close_ts"), half.alias("half_day"), (close - RTH_OPEN).cast("long").alias("minutes"))


def sessionize(bars: DataFrame, sessions: DataFrame, bar_minutes: int, start: str = "bar_start_ts", end: str = "bar_end_ts", key: str = "series_id") -> DataFrame:
    """Adds session_id, bar_index, expected_bars and half_day; bars outside every session keep '' and -1."""
    day = sessions.select(F.col("date").alias("__date"), "open_ts", "close_ts", "half_day", (F.col("minutes") / bar_minutes).cast("long").alias("expected_bars"))
    inside = (F.to_date(local(start)) == F.col("__date")) & (F.col(start) >= F.col("open_ts")) & (F.col(end) <= F.col("close_ts"))
    met = bars.join(day, inside, "left")
    index = ((F.unix_timestamp(start) - F.unix_timestamp("open_ts")) / (60 * bar_minutes)).cast("int")
    return met.select(
        *[F.col(f"`{c}`") for c in bars.columns],
        F.coalesce(F.concat_ws(":", F.col(key), F.col("__date").cast("string")).alias("x"), F.lit("")).alias("__id"), "__date", "half_day", "expected_bars", index.alias("__index"),
    ).withColumn("session_id", F.when(F.col("__date").isNull(), "").otherwise(F.col("__id"))).withColumn("bar_index", F.coalesce("__index", F.lit(-1))).drop("__id", "__date", "__index")


def active_members(universe: DataFrame, date) -> DataFrame:
    return universe.filter((F.col("active_from") <= date) & (F.coalesce("active_to", F.lit("9999-12-31").cast("date")) >= date))


def resolve_symbols(rows: DataFrame, master: DataFrame, symbol: str, date: str) -> DataFrame:
    """instrument_id of the one member with the symbol active at the date; null if none or several."""
    # the master is folded to one list a symbol, so rows are neither grouped nor repeated
    member = F.struct(F.col("instrument_id").alias("i"), F.col("active_from").alias("f"), F.coalesce("active_to", F.lit("9999-12-31").cast("date")).alias("t"))
    members = master.groupBy(F.col("symbol").alias("__s")).agg(F.collect_list(member).alias("__members"))
    active = F.filter("__members", lambda m: m["i"].isNotNull() & (m["f"] <= F.col(date)) & (m["t"] >= F.col(date)))
    met = rows.join(members, F.col(symbol) == F.col("__s"), "left").withColumn("__active", active)
    return met.select(*[F.col(f"`{c}`") for c in rows.columns if c != "instrument_id"], F.when(F.size("__active") == 1, F.get("__active", F.lit(0))["i"]).alias("instrument_id"))


def align_universe(universe: DataFrame, calendar: DataFrame) -> DataFrame:
    """Active members x their calendar's dates: (instrument_id, calendar_id, date)."""
    cal = calendar.select(F.col("calendar_id").alias("__c"), "date")
    on = (F.col("calendar_id") == F.col("__c")) & (F.col("date") >= F.col("active_from")) & (F.col("date") <= F.coalesce("active_to", F.lit("9999-12-31").cast("date")))
    return universe.join(cal, on).select("instrument_id", "calendar_id", "date")


def run_boundaries(df: DataFrame, keys: tuple[str, ...], order: str, label: str, ts: str) -> DataFrame:
    """Offline: rows and minutes to the next change of ``label`` in a series (bars_to_change, minutes_to_change)."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = df.withColumn("__n", F.row_number().over(w)).withColumn("__c", F.col(label) != F.lag(label).over(w))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    at = F.first(F.when(F.col("__c"), F.struct("__n", ts)), ignorenulls=True).over(ahead)
    n = n.withColumn("__at", at)
    return n.withColumn("bars_to_change", (F.col("__at.__n") - F.col("__n")).cast("long")).withColumn("minutes_to_change", ((F.unix_timestamp(F.col(f"__at.{ts}")) - F.unix_timestamp(ts)) / 60).cast("long")).drop("__n", "__c", "__at")
