"""Canonical rows from raw ones, validation, coverage, dense grids and source comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import sessions

LONG_NO_TRADE_MINUTES = 240


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, with the number of rows it had (copies)."""
    w = Window.partitionBy(*key)
    return df.withColumn("copies", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(*order))).filter("__n = 1").drop("__n")


def parse_raw(raw: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON texts as typed columns; a text that does not fit gives nulls."""
    return raw.withColumn("__p", F.from_json(text, schema)).select(*raw.columns, "__p.*")


def bar_issues() -> Column:
    """Names of the rules that a bar breaks."""
    rule = lambda name, bad: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    null = o.isNull() | h.isNull() | l.isNull() | c.isNull() | F.col("volume").isNull()
    return F.array_compact(F.array(
        rule("missing_field", null), rule("high_below_low", h < l), rule("open_out_of_range", (o > h) | (o < l)), rule("close_out_of_range", (c > h) | (c < l)),
        rule("negative_volume", F.col("volume") < 0), rule("negative_trade_count", F.col("trade_count") < 0), rule("available_before_end", F.col("available_ts") < F.col("bar_end_ts")),
    ))


def canonical_bars(raw: DataFrame, latency_seconds: int, bar_minutes: int, in_session: Column, key: tuple[str, ...] = ("series_id", "bar_start_ts"), order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """First row of each (series, bar start) with event and available times; status ok, duplicate, invalid or out_of_session.

    Nothing is dropped here: filter on status, and count the others as quarantined.
    """
    end = F.col("bar_start_ts") + F.make_dt_interval(mins=F.lit(bar_minutes))
    timed = raw.withColumn("bar_end_ts", end).withColumn("event_ts", end).withColumn("available_ts", end + F.make_dt_interval(secs=F.lit(latency_seconds)))
    d = timed.withColumn("issues", bar_issues())
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    status = F.when(rank > 1, "duplicate").when(F.size("issues") > 0, "invalid").when(~in_session, "out_of_session").otherwise("ok")
    return d.withColumn("status", status)


def _hosts(bars: DataFrame, key: str, seconds: int) -> DataFrame:
    """The bar that takes the quotes of a span of time: the span's own bar (rank 1), else the bar before it (rank 2)."""
    step = F.make_dt_interval(secs=F.lit(seconds))
    spans = F.explode(F.array(F.struct(F.col("bar_start_ts").alias("span"), F.lit(1).alias("rank")), F.struct((F.col("bar_start_ts") + step).alias("span"), F.lit(2).alias("rank"))))
    d = bars.select(F.col(key).alias("__key"), "bar_start_ts", spans.alias("x"))
    return d.groupBy("__key", F.col("x.span").alias("__span")).agg(F.min(F.struct("x.rank", "bar_start_ts")).alias("__host"))


def placed_quotes(quotes: DataFrame, bars: DataFrame, key: str, seconds: int, arrival: list[str]) -> DataFrame:
    """The first quote to arrive for each bar start, with the number that did (copies) and the reason to quarantine it.

    A quote's bar is the one of its explicit bar_start_ts, where it has one;
    else the bar of its span of time; else the bar before, where that exists.
    Reasons: no_bar, missing_value, crossed, outside_bar (its time is not within
    the bar, ends included).
    """
    q = quotes if "bar_start_ts" in quotes.columns else quotes.withColumn("bar_start_ts", F.lit(None).cast("timestamp"))
    span = F.timestamp_micros(F.floor(F.unix_micros("event_ts") / (seconds * 1_000_000)) * seconds * 1_000_000)
    q = q.withColumn("__explicit", F.col("bar_start_ts")).withColumn("__span", F.coalesce("bar_start_ts", span)).drop("bar_start_ts")
    hosts = _hosts(bars, key, seconds).withColumnRenamed("__span", "__host_span")
    d = q.join(hosts, (F.col(key) == F.col("__key")) & (F.col("__span") == F.col("__host_span")), "left")
    taken = F.col("__host").isNotNull() & (F.col("__explicit").isNull() | (F.col("__host.rank") == 1))
    d = d.withColumn("bar_start_ts", F.when(taken, F.col("__host.bar_start_ts")).otherwise(F.col("__span"))).withColumn("__taken", taken)
    values = ("event_ts", "bid", "ask", "bid_size", "ask_size")
    first = F.min_by(F.struct(*values, "__taken"), F.struct(*arrival))
    g = d.groupBy(key, "bar_start_ts").agg(first.alias("__q"), F.count("*").alias("copies")).select(key, "bar_start_ts", "copies", *[F.col(f"__q.{c}").alias(c) for c in values], F.col("__q.__taken").alias("__taken"))
    missing = F.lit(False)
    for c in values[1:]:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    end = F.col("bar_start_ts") + F.make_dt_interval(secs=F.lit(seconds))
    outside = ~F.col("event_ts").between(F.col("bar_start_ts"), end)
    reason = F.when(~F.col("__taken"), "no_bar").when(missing, "missing_value").when(F.col("ask") < F.col("bid"), "crossed").when(outside, "outside_bar")
    return g.withColumn("reason", reason).drop("__taken")


def canonical_quotes(quotes: DataFrame, bars: DataFrame, key: str = "series_id", seconds: int = 60, latency_seconds: int = 1, arrival: list[str] | None = None) -> DataFrame:
    """A quote row for every bar: the first placed in it, or a flagged placeholder of zeros.

    bars: (key, bar_start_ts), each once.  Flags are missing_bbo for a bar
    without a usable quote, and bbo_quarantined if it had one that was not.
    """
    q = placed_quotes(quotes, bars, key, seconds, arrival or ["event_ts"]).filter("reason is null or reason <> 'no_bar'")
    j = bars.select(key, "bar_start_ts").join(q, [key, "bar_start_ts"], "left")
    usable = F.col("copies").isNotNull() & F.col("reason").isNull()
    end = F.col("bar_start_ts") + F.make_dt_interval(secs=F.lit(seconds))
    flags = F.array_compact(F.array(F.when(~usable, F.lit("missing_bbo")), F.when(F.col("reason").isNotNull(), F.lit("bbo_quarantined"))))
    held = lambda x: F.when(usable, x).otherwise(0.0)
    return j.select(
        key, "bar_start_ts", end.alias("bar_end_ts"), F.when(usable, F.col("event_ts")).otherwise(end).alias("event_ts"), (end + F.make_dt_interval(secs=F.lit(latency_seconds))).alias("available_ts"),
        *[held(F.col(c)).alias(c) for c in ("bid", "ask", "bid_size", "ask_size")], held((F.col("bid") + F.col("ask")) / 2).alias("mid"), held(F.col("ask") - F.col("bid")).alias("spread"), flags.alias("quality_flags"),
    )


def quote_counts(quotes: DataFrame, bars: DataFrame, key: str = "series_id", seconds: int = 60, arrival: list[str] | None = None) -> DataFrame:
    """Per key: quotes that repeat a bar start, quotes quarantined by reason, and bars without a usable quote."""
    q = placed_quotes(quotes, bars, key, seconds, arrival or ["event_ts"])
    g = q.groupBy(key).agg(F.sum(F.col("copies") - 1).alias("duplicates"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("no_bar", "missing_value", "crossed", "outside_bar")], F.count_if(F.col("reason").isNull()).alias("__used"))
    per = bars.groupBy(key).agg(F.count("*").alias("__bars"))
    d = per.join(g, key, "full_outer").na.fill(0)
    return d.withColumn("missing", F.col("__bars") - F.col("__used")).drop("__bars", "__used")


def canonical_trades(raw: DataFrame, key: list[str]) -> DataFrame:
    """Typed trades without repeats of the whole key."""
    return raw.dropDuplicates(key)


def normalize_metadata(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Metadata records with their kind's name; unknown kinds go."""
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return raw.withColumn("kind", F.try_element_at(names, F.lower(F.trim("record_type")))).filter("kind is not null")


def quote_issues(tolerance: float = 1e-9) -> Column:
    rule = lambda name, bad: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    b, a = F.col("bid"), F.col("ask")
    return F.array_compact(F.array(
        rule("crossed", a < b), rule("mid_mismatch", F.abs(F.col("mid") - (a + b) / 2) > tolerance), rule("spread_mismatch", F.abs(F.col("spread") - (a - b)) > tolerance),
        rule("available_before_end", F.col("available_ts") < F.col("bar_end_ts")), rule("microprice_outside", ~F.col("microprice").between(b, a)),
    ))


def is_real_trade() -> Column:
    return F.col("close").isNotNull() & (F.coalesce("volume", F.lit(0.0)) > 0)


# --- sessions and coverage


def outside_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds out_of_session: no session of the calendar holds the whole bar."""
    c = calendar.select(F.col("date").alias("__d"), "open_ts", "close_ts")
    inside = (F.to_date(sessions.local("bar_start_ts")) == F.col("__d")) & (F.col("bar_start_ts") >= F.col("open_ts")) & (F.col("bar_end_ts") <= F.col("close_ts"))
    return bars.join(c, inside, "left").withColumn("out_of_session", F.col("__d").isNull()).drop("__d", "open_ts", "close_ts")


def duplicate_counts(rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """For each key, how many of its values repeat and the rows beyond the first."""
    parts = [rows.groupBy(*k).count().filter("count > 1").agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0).cast("long")).alias("extra_rows")).select(F.lit(",".join(k)).alias("key"), "keys", "extra_rows") for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expected_bars(bars: DataFrame, calendar: DataFrame, minutes: int, key: str = "series_id") -> DataFrame:
    """Every bar start that the sessions expect of every series: (series, date, bar_start_ts)."""
    step = F.make_dt_interval(mins=F.lit(minutes))
    starts = calendar.filter(F.col("open_ts") + step <= F.col("close_ts")).select("date", F.explode(F.sequence("open_ts", F.col("close_ts") - step, step)).alias("bar_start_ts"))
    return bars.select(key).distinct().crossJoin(F.broadcast(starts))


def missing_bars(bars: DataFrame, calendar: DataFrame, minutes: int, key: str = "series_id", observed_only: bool = True) -> DataFrame:
    """Expected bars without a row; observed_only: in sessions of which the series has some bar."""
    want = expected_bars(bars, calendar, minutes, key)
    have = bars.select(key, "bar_start_ts").distinct()
    if observed_only:
        seen = want.join(have, [key, "bar_start_ts"]).select(key, "date").distinct()
        want = want.join(seen, [key, "date"], "left_semi")
    return want.join(have, [key, "bar_start_ts"], "left_anti")


def quality_run(bars: DataFrame, calendar: DataFrame, minutes: int, key: str = "series_id") -> DataFrame:
    """Counts of all checks: (series, check, n)."""
    out = outside_sessions(bars, calendar).filter("out_of_session").groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit("out_of_session").alias("check"), "n")
    dup = bars.groupBy(key, "bar_start_ts").count().filter("count > 1").groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit("duplicate").alias("check"), "n")
    gone = missing_bars(bars, calendar, minutes, key).groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit("missing").alias("check"), "n")
    return out.unionByName(dup).unionByName(gone)


def runs(rows: DataFrame, key: list[str], place: str, name: str = "run") -> DataFrame:
    """Islands of consecutive places: first, last and length of each."""
    w = Window.partitionBy(*key).orderBy(place)
    d = rows.withColumn("__i", F.col(place) - F.row_number().over(w))
    return d.groupBy(*key, "__i").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("length")).drop("__i")


def interval_coverage(intervals: DataFrame, rows: DataFrame, key: list[str], session: list[str], long_run: int, seconds: int = 60, dense: bool = False) -> DataFrame:
    """Each expected interval with what its rows cover, in bars of ``seconds``, by differences of times: no grid is listed.

    intervals: (key, session, start_t, end_t) in seconds; a session may have
    several.  rows: (key, session, t) and, for a dense grid, has_trade and
    synthetic; all sparse rows are trades.  A session without any trade expects
    nothing (non_trading).  Before its first trade an interval is unfilled; a
    run without rows between two trades is no_trade, and long if it has more
    than ``long_run`` bars; other runs after the first trade are no_trade in a
    sparse table and gap in a dense grid.
    """
    by = [*key, *session]
    trade = F.bool_or("has_trade") if dense else F.lit(True)
    filled = F.bool_or("synthetic") if dense else F.lit(False)
    r = rows.groupBy(*by, "t").agg(trade.alias("__trade"), filled.alias("__filled"))
    iv = intervals.select(*by, "start_t", "end_t").withColumn("expected", F.ceil((F.col("end_t") - F.col("start_t")) / seconds).cast("long"))
    x = r.select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col("t"), "__trade", "__filled")
    on = (F.col("t") >= F.col("start_t")) & (F.col("t") < F.col("end_t")) & ((F.col("t") - F.col("start_t")) % seconds == 0)
    for c in by:
        on = on & (F.col(c) == F.col(f"__r_{c}"))
    j = iv.join(x, on, "left").drop(*[f"__r_{c}" for c in by])
    of_session = Window.partitionBy(*by)
    of_interval = Window.partitionBy(*by, "start_t")
    traded = F.when(F.col("__trade"), F.col("t"))
    j = j.withColumn("__session_first", F.min(traded).over(of_session)).withColumn("__first", F.min(traded).over(of_interval)).withColumn("__last", F.max(traded).over(of_interval))
    w = of_interval.orderBy("t")
    j = j.withColumn("__prev", F.lag("t").over(w)).withColumn("__next", F.lead("t").over(w)).withColumn("__open", F.coalesce("__first", "__session_first"))

    def run(start, end) -> tuple[Column, Column, Column]:
        """Bars of a run without rows that count as no trade, as a long run between trades, and as a gap."""
        n = ((end - start) / seconds).cast("long")
        counts = F.col("t").isNotNull() & (n > 0) & (end > F.col("__open"))
        between = F.coalesce((F.col("__first") < start) & (F.col("__last") >= end), F.lit(False))
        long_ = counts & between & (n > long_run)
        gap = counts & ~long_ if dense else F.lit(False)
        return F.when(counts & ~gap, n).otherwise(0), F.when(long_, n).otherwise(0), F.when(gap, n).otherwise(0)

    before = run(F.coalesce(F.col("__prev") + seconds, F.col("start_t")), F.col("t"))
    behind = run(F.col("t") + seconds, F.when(F.col("__next").isNull(), F.col("start_t") + F.col("expected") * seconds).otherwise(F.col("t") + seconds))
    total = lambda k: F.sum(before[k] + behind[k]).cast("long")
    g = j.groupBy(*by, "start_t", "end_t", "expected", "__session_first", "__open").agg(
        F.count("t").alias("observed"), F.count_if("__trade").alias("traded"), F.count_if("__filled").alias("synthetic"), total(0).alias("__runs"), total(1).alias("long_run_bars"), total(2).alias("gap"),
        F.count_if(before[1] > 0).alias("__long_before"), F.count_if(behind[1] > 0).alias("__long_behind"),
    )
    absent = F.col("__session_first").isNull()
    lead = F.when(F.col("observed") == 0, F.col("expected")).otherwise(F.greatest(F.ceil((F.col("__open") - F.col("start_t")) / seconds).cast("long"), F.lit(0).cast("long")))
    kept = lambda c: F.when(absent, F.lit(0).cast("long")).otherwise(c)
    return g.select(
        *by, "start_t", "end_t", absent.alias("non_trading"), F.when(absent, F.col("expected")).otherwise(0).cast("long").alias("non_trading_bars"), kept(F.col("expected")).alias("expected"),
        *[kept(F.col(c)).alias(c) for c in ("observed", "traded", "synthetic")], kept(lead).alias("unfilled"), kept(F.col("__runs") + F.col("synthetic")).alias("no_trade"),
        kept(F.col("__long_before") + F.col("__long_behind")).alias("long_runs"), kept(F.col("long_run_bars")).alias("long_run_bars"), kept(F.col("gap")).alias("gap"),
    )


def coverage(intervals: DataFrame, rows: DataFrame, key: list[str], session: list[str], long_run: int, seconds: int = 60, dense: bool = False) -> DataFrame:
    """Per key the sums of interval_coverage, the sessions' intervals without any trade, and no-trade bars by expected ones."""
    d = interval_coverage(intervals, rows, key, session, long_run, seconds, dense)
    sums = ("expected", "observed", "traded", "synthetic", "unfilled", "no_trade", "long_runs", "long_run_bars", "gap", "non_trading_bars")
    g = d.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], F.count_if("non_trading").alias("non_trading_intervals"))
    return g.withColumn("no_trade_ratio", F.coalesce(F.try_divide("no_trade", "expected"), F.lit(0.0)))


def non_trading_sessions(grid: DataFrame, key: str, session: str) -> DataFrame:
    """Sessions of a series without any trade, and whether every series is absent then."""
    g = grid.groupBy(key, session).agg(F.bool_or("has_trade").alias("traded"))
    return g.withColumn("all_absent", ~F.bool_or("traded").over(Window.partitionBy(session))).filter("not traded").drop("traded")


def off_grid(rows: DataFrame, by: list[str], ts: str, allowed: Column | None = None) -> DataFrame:
    """Rows whose time has seconds or parts of them, and of those the allowed."""
    bad = F.col(ts) != F.date_trunc("minute", ts)
    allowed = F.lit(False) if allowed is None else allowed
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(bad & ~allowed).alias("off_grid"), F.count_if(bad & allowed).alias("allowed"))


def densify(grid: DataFrame, key: list[str]) -> DataFrame:
    """Grid rows from the first trade on; those without a trade hold the last close, volume 0 and synthetic true.

    Keys without a trade and rows before the first one are left out.
    """
    w = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = grid.withColumn("__last", F.last("close", ignorenulls=True).over(w)).filter("__last is not null")
    fill = lambda c: F.coalesce(F.col(c), F.col("__last")).alias(c)
    return d.select(*key, "t", *[fill(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"), "has_trade", (~F.col("has_trade")).alias("synthetic"), F.when(~F.col("has_trade"), "previous_close").alias("fill_method"))


def compare_sources(a: DataFrame, b: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Per group: counts, overlap, close differences, correlation, volume difference, and rows that one side lacks."""
    x = a.select(*by, *key, F.col("close").alias("__x"), F.col("volume").alias("__vx"))
    y = b.select(*by, *key, F.col("close").alias("__y"), F.col("volume").alias("__vy"))
    j = x.join(y, [*by, *key], "full_outer")
    diff = F.abs(F.col("__x") - F.col("__y"))
    from barloom.operators.diagnostics import pearson

    return j.groupBy(*by).agg(
        F.count("__x").alias("rows_a"), F.count("__y").alias("rows_b"), F.count(diff).alias("overlap"), F.avg(diff).alias("mean_abs_diff"), F.max(diff).alias("max_abs_diff"), pearson("__x", "__y").alias("correlation"),
        F.sum(F.col("__vx") - F.col("__vy")).alias("volume_diff"), F.count_if(F.col("__y").isNull()).alias("missing_in_b"), F.count_if(F.col("__x").isNull()).alias("missing_in_a"),
    )


def reconcile(a: DataFrame, b: DataFrame, by: list[str], key: list[str], tolerance: float, value: str = "value") -> DataFrame:
    """Per series: exact, within, beyond, missing each side, largest and median difference, and a verdict."""
    x, y = a.select(*by, *key, F.col(value).alias("__x"), F.lit(1).alias("__a")), b.select(*by, *key, F.col(value).alias("__y"), F.lit(1).alias("__b"))
    j = x.join(y, [*by, *key], "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    diff = F.abs(F.col("__x") - F.col("__y"))
    same = both & F.col("__x").eqNullSafe(F.col("__y"))
    within = both & ~same & F.coalesce(diff <= tolerance, F.lit(False))
    g = j.groupBy(*by).agg(
        F.count_if(same).alias("exact"), F.count_if(within).alias("within"), F.count_if(both & ~same & ~within).alias("beyond"), F.count_if(F.col("__b").isNull()).alias("missing_in_b"), F.count_if(F.col("__a").isNull()).alias("missing_in_a"),
        F.max(diff).alias("max_diff"), F.percentile(diff, F.lit(0.5)).alias("median_diff"),
    )
    clean = (F.col("beyond") == 0) & (F.col("missing_in_a") == 0) & (F.col("missing_in_b") == 0)
    return g.withColumn("verdict", F.when(clean & (F.col("within") == 0), "IDENTICAL").when(clean, "WITHIN").otherwise("BEYOND"))


def spread_proxy(rows: DataFrame) -> DataFrame:
    """Spread of an observation in price and in bps of its mid."""
    mid = (F.col("ask") + F.col("bid")) / 2
    return rows.withColumn("spread_proxy", F.col("ask") - F.col("bid")).withColumn("spread_proxy_bps", F.when(mid > 0, (F.col("ask") - F.col("bid")) / mid * 1e4))
