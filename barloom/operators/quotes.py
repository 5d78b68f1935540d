"""Quote features, book features and cross-market features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import timeline as T
from barloom.functions import windows as W
from barloom.operators.features import _with

BAD_FLAGS = ("missing_bbo", "bbo_quarantined")


def invariants_hold() -> Column:
    """ask >= bid, both positive, and the quote is known no earlier than its bar's end."""
    return F.coalesce((F.col("ask") >= F.col("bid")) & (F.col("bid") > 0) & (F.col("available_ts") >= F.col("bar_end_ts")), F.lit(False))


def is_missing() -> Column:
    return F.array_contains("quality_flags", "missing_bbo")


def is_abnormal() -> Column:
    return F.arrays_overlap("quality_flags", F.array(*[F.lit(x) for x in BAD_FLAGS])) | ~invariants_hold()


def valid() -> Column:
    return (F.size("quality_flags") == 0) & invariants_hold()




def mid() -> Column:
    return (F.col("ask") + F.col("bid")) / 2


def spread() -> Column:
    return F.col("ask") - F.col("bid")


def depth() -> Column:
    return F.col("bid_size") + F.col("ask_size")


def microprice() -> Column:
    return F.when((F.col("bid_size") > 0) & (F.col("ask_size") > 0), F.try_divide(F.col("ask") * F.col("bid_size") + F.col("bid") * F.col("ask_size"), depth()))


def bps() -> Column:
    return F.when(mid() > 0, spread() / mid() * 10000)


def quote_feature(df: DataFrame, value: Column, *named: tuple[str, Column]) -> DataFrame:
    """value for valid quotes, else none with bbo_gap."""
    return _with(df, value, ("bbo_gap", ~valid()), *named)


def spread_ticks(df, tick: float = 0.01):
    return quote_feature(df, F.round(spread() / tick, 6), ("missing_spread_ticks", spread().isNull()))


def spread_zscore(df, window: int = 20):
    d = df.withColumn("__s", F.when(valid(), spread()))
    return d.select("*", *W.causal_zscore(W.Series(), "__s", window).named()).drop("__s")


def imbalance(df):
    return quote_feature(df, F.try_divide(F.col("bid_size") - F.col("ask_size"), depth()), ("zero_depth", (F.col("bid_size") <= 0) | (F.col("ask_size") <= 0)))


def microprice_feature(df, minus_mid: bool = False):
    value = microprice() - mid() if minus_mid else microprice()
    return quote_feature(df, value, ("zero_depth", (F.col("bid_size") <= 0) | (F.col("ask_size") <= 0)))


def flag(df, condition: Column):
    """1 or 0 for every row, whether its quote is valid or not."""
    return _with(df, condition.cast("long"))


def threshold_flag(df, condition: Column):
    return quote_feature(df, condition.cast("long"))


# --- book


def book_features(rows: DataFrame, keys: tuple[str, ...] = ("series_id", "t"), depth_levels: int = 5, tight: float = 0.02, deep: float = 100.0) -> DataFrame:
    """All snapshot features of a book in one aggregation over its (level, side) rows.

    spread, l2/top1/top5 imbalance, depth by side, first-level order counts, microprice and a
    liquidity tag; a missing side leaves null values and its name in book_flags.
    """
    pick = lambda side, what, level: F.max(F.when((F.col("side") == side) & (F.col("book_level") == level), F.col(what)))
    total = lambda side, n: F.sum(F.when((F.col("side") == side) & (F.col("book_level") <= n), F.col("size")))
    agg = rows.groupBy(*keys).agg(
        pick("bid", "price", 1).alias("bid1"), pick("ask", "price", 1).alias("ask1"), pick("bid", "size", 1).alias("bs"), pick("ask", "size", 1).alias("as"),
        total("bid", 1).alias("b1"), total("ask", 1).alias("a1"), total("bid", depth_levels).alias("bid_depth"), total("ask", depth_levels).alias("ask_depth"),
        pick("bid", "order_count", 1).alias("bid_orders"), pick("ask", "order_count", 1).alias("ask_orders"),
    )
    both = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))
    spread = F.col("ask1") - F.col("bid1")
    shown = F.col("bid_depth") + F.col("ask_depth")
    return agg.select(
        *keys, spread.alias("spread"), both("b1", "a1").alias("top1_imbalance"), both("bid_depth", "ask_depth").alias("depth_imbalance"), "bid_depth", "ask_depth", "bid_orders", "ask_orders",
        F.try_divide(F.col("ask1") * F.col("bs") + F.col("bid1") * F.col("as"), F.col("bs") + F.col("as")).alias("microprice"),
        F.when(spread.isNull() | shown.isNull(), "incomplete").when((spread <= tight) & (shown >= deep), "tight_deep").otherwise("wide_or_shallow").alias("liquidity_tag"),
        F.array_compact(F.array(F.when(F.col("bid1").isNull(), F.lit("missing_bid")), F.when(F.col("ask1").isNull(), F.lit("missing_ask")))).alias("book_flags"),
    )


def update_intensity(deltas: DataFrame, key: str = "series_id", ts: str = "event_ts", tie: str = "event_id", seconds: int = 1) -> DataFrame:
    """Updates in the last seconds up to the row, in arrival order: later rows of the same time do not count."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    peers = Window.partitionBy(key, ts)
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy(tie))
    return deltas.withColumn("updates", F.count("*").over(w) - later)


def book_issues(rows: DataFrame, levels: int = 5) -> DataFrame:
    """Rows with the names of the rules that they break."""
    rule = lambda name, bad: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    return rows.withColumn("issues", F.array_compact(F.array(
        rule("bad_side", ~F.col("side").isin("bid", "ask")), rule("bad_level", ~F.col("book_level").between(1, levels)), rule("bad_price", F.col("price") <= 0),
        rule("bad_size", F.col("size") <= 0), rule("bad_order_count", F.col("order_count") < 0),
    )))


def research_order(df: DataFrame, *ties: str) -> DataFrame:
    """Rows numbered in the order in which they could be known: available, event time, then the given ties."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy("series_id").orderBy("available_ts", *ties)).cast("long"))


# --- cross-market


def strict_alignment(rows: DataFrame, markets: dict[str, str], value: str = "r") -> DataFrame:
    """One row for each event time that all markets share: a column of values for each, and the latest availability."""
    named = reduce(lambda c, x: c.when(F.col("series_id") == x[1], x[0]), markets.items(), F.when(F.lit(False), F.lit("")))
    d = rows.withColumn("__m", named).filter("__m is not null")
    picks = [F.max(F.when(F.col("__m") == m, F.col(value))).alias(m) for m in markets]
    there = [F.count(F.when(F.col("__m") == m, 1)).alias(f"__n{m}") for m in markets]
    agg = d.groupBy("event_ts").agg(*picks, *there, F.max("available_ts").alias("available_ts"))
    return agg.filter(reduce(lambda a, b: a & b, [F.col(f"__n{m}") > 0 for m in markets])).drop(*[f"__n{m}" for m in markets])


def as_of_alignment(rows: DataFrame, markets: dict[str, str], value: str = "r", chunk_seconds: int = T.DAY) -> DataFrame:
    """At each availability time the latest value of every market, those that become available at that time included.

    The timeline is cut into chunks of time; the last value of a market before a chunk is carried into it.
    """
    ours = rows.filter(F.col("series_id").isin(*markets.values()))
    return T.as_of_all(ours, "available_ts", {m: F.col("series_id") == name for m, name in markets.items()}, value, chunk_seconds)


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, cols: list[str]) -> DataFrame:
    """For each left row the latest right row of its key at or before its time: a union and a running last, no pairs."""
    kinds = dict(right.dtypes)
    packed = F.struct(*cols)
    a = left.select(*left.columns, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(f"struct<{','.join(f'{c}:{kinds[c]}' for c in cols)}>").alias("__got"))
    b = right.select(*[F.col(key) if c == key else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), packed.alias("__got"))
    w = Window.partitionBy(key).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__got", F.last("__got", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select(*left.columns, *[F.col(f"__got.{c}").alias(f"{c}_as_of") for c in cols])


def cross_features(aligned: DataFrame, base: str = "ES", others: tuple[str, str] = ("NQ", "RTY")) -> DataFrame:
    """Return spreads, confirmation, divergence and rotation of aligned markets; none if one is missing."""
    a, b = others
    whole = F.col(base).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    signs = [F.signum(m) for m in (base, a, b)]
    up, down = [s > 0 for s in signs], [s < 0 for s in signs]
    every, some = lambda xs: reduce(lambda p, q: p & q, xs), lambda xs: reduce(lambda p, q: p | q, xs)
    on = ((F.col(a) - F.col(base)) + (F.col(b) - F.col(base))) / 2
    return aligned.withColumns({
        f"{a.lower()}_minus_{base.lower()}": F.col(a) - F.col(base), f"{b.lower()}_minus_{base.lower()}": F.col(b) - F.col(base),
        "confirmation": F.when(whole, (every(up) | every(down)).cast("long")), "divergence": F.when(whole, (some(up) & some(down)).cast("long")),
        "risk_on": F.when(whole, on), "risk_off": F.when(whole, -on), "returns": F.when(whole, F.create_map(*[x for m in (base, a, b) for x in (F.lit(m), F.col(m))])),
    })


def rolling_pair(aligned: DataFrame, target: str, base: str, window: int, ddof: int = 1, size: int = T.BLOCK_ROWS, chunk_seconds: int = T.DAY) -> DataFrame:
    """Beta residual and correlation of two aligned markets over the last rows; none with a gap or a flat window.

    Rows stand by (available_ts, event_ts) and meet in blocks that carry the window's rows before them.
    """

    def build(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("__place").rowsBetween(-(window - 1), 0)
        y, x = F.col(target), F.col(base)
        full = (F.count(F.lit(1)).over(w) == window) & (F.sum((x.isNull() | y.isNull()).cast("int")).over(w) == 0)
        flat_x, flat_y = F.max(x).over(w) == F.min(x).over(w), F.max(y).over(w) == F.min(y).over(w)
        cov, vx, vy = (F.covar_samp(y, x) if ddof else F.covar_pop(y, x)).over(w), (F.var_samp(x) if ddof else F.var_pop(x)).over(w), (F.var_samp(y) if ddof else F.var_pop(y)).over(w)
        return d.withColumn("beta_residual", F.when(full & ~flat_x, y - F.try_divide(cov, vx) * x)).withColumn("correlation", F.when(full & ~flat_x & ~flat_y, F.try_divide(cov, F.sqrt(vx * vy))))

    return T.in_blocks(aligned, [], ["available_ts", "event_ts"], build, window - 1, size=size, seconds=chunk_seconds)
