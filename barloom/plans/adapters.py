"""Market tables built by Spark from the given tables, and the same tables as DuckDB SQL.

Trades are events (price 100 + value / 10, size 1 + user_id % 10); hourly bars
and the dense hourly grid of every series come from trades, quotes from bars,
book rows from quotes, daily bars from lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import sessions


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trades(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("event_ts"),
        (100 + F.col("value") / 10).alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("size"), "user_id",
    )


def bars(spark, d) -> DataFrame:
    """Hourly bars; available one second after their end."""
    t = trades(spark, d).withColumn("bar_start_ts", F.date_trunc("hour", "event_ts"))
    at = F.struct("event_ts", "event_id")
    b = t.groupBy("series_id", "bar_start_ts").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("trade_count"),
    )
    return _timed(b)


def _timed(b: DataFrame) -> DataFrame:
    end = F.col("bar_start_ts") + F.expr("interval 1 hour")
    return b.withColumns({
        "t": F.unix_timestamp("bar_start_ts"), "bar_end_ts": end, "event_ts": end, "available_ts": end + F.expr("interval 1 second"),
        "session_label": sessions.session_label(F.col("bar_start_ts")), "contract_id": F.concat("series_id", F.lit("H24")),
    })


def grid(spark, d) -> DataFrame:
    """Every hour of the month for every series; hours without a trade have null prices and has_trade false."""
    b = bars(spark, d).select("series_id", "bar_start_ts", "open", "high", "low", "close", "volume", "trade_count")
    span = b.agg(F.min("bar_start_ts").alias("a"), F.max("bar_start_ts").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("bar_start_ts"))
    hours = b.select("series_id").distinct().crossJoin(F.broadcast(span))
    return _timed(hours.join(b, ["series_id", "bar_start_ts"], "left").withColumn("has_trade", F.col("close").isNotNull()))


def quotes(spark, d) -> DataFrame:
    """Quotes at bar ends: mid the close, half spread by the hour; every 11th hour number has none (flagged)."""
    h = (F.col("t") / 3600).cast("long")
    half = 0.01 + (h % 7) / 1000
    q = bars(spark, d).withColumn("missing", h % 11 == 0)
    return q.select(
        "series_id", "contract_id", "bar_start_ts", "bar_end_ts", "event_ts", "available_ts", "t", "session_label", "missing",
        F.when(~F.col("missing"), F.col("close") - half).alias("bid"), F.when(~F.col("missing"), F.col("close") + half).alias("ask"),
        F.when(~F.col("missing"), F.col("volume") % 9).alias("bid_size"), F.when(~F.col("missing"), F.col("trade_count").cast("double")).alias("ask_size"),
        F.when(F.col("missing"), F.array(F.lit("missing_bbo"))).when(h % 13 == 0, F.array(F.lit("bbo_quarantined"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
    )


def book(spark, d) -> DataFrame:
    """Five levels a side around each bar's close, ten ticks apart by level; sizes by hour and level."""
    h = (F.col("t") / 3600).cast("long")
    levels = F.explode(F.expr("flatten(transform(sequence(1, 5), l -> array(struct(l as book_level, 'bid' as side), struct(l as book_level, 'ask' as side))))"))
    b = bars(spark, d).select("series_id", "t", "available_ts", "close", levels.alias("x")).select("series_id", "t", "available_ts", "close", "x.*")
    sign = F.when(F.col("side") == "bid", -1).otherwise(1)
    b = b.withColumn("price", F.col("close") + sign * F.col("book_level") * 0.01).withColumn("size", (10 + (h + F.col("book_level") * 3 + sign) % 13).cast("double"))
    return b.withColumn("order_count", (1 + (h + F.col("book_level")) % 5).cast("long")).filter(~((h % 17 == 0) & (F.col("side") == "ask"))).drop("close")


def daily(spark, d) -> DataFrame:
    """Daily bars of each supplier's lines."""
    at = F.struct("l_orderkey", "l_linenumber")
    x = table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return x.groupBy(F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("day")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").alias("trade_count")
    )


def universe(spark, d) -> DataFrame:
    """Suppliers as instruments: odd ones join in 1993, every third leaves after 1996; sector nation, class region."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    m = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    return m.select(
        k.alias("instrument_id"), F.concat(F.lit("S"), (k % 50).cast("string")).alias("symbol"), F.col("n_name").alias("sector"), F.col("r_name").alias("asset_class"),
        F.when(k % 2 == 1, F.lit("1993-01-01")).otherwise(F.lit("1992-01-01")).cast("date").alias("active_from"), F.when(k % 3 == 0, F.lit("1996-12-31").cast("date")).alias("active_to"),
        F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("calendar_id"), F.col("s_acctbal").alias("balance"),
    )


TRADES = """tr AS (SELECT event_type AS series_id, event_id, ts AS event_ts, 100 + value / 10 AS price, CAST(1 + user_id % 10 AS DOUBLE) AS size, user_id FROM events)"""
BARS = f"""{TRADES}, bars AS (
  SELECT *, CAST(epoch(bar_start_ts) AS BIGINT) AS t, bar_start_ts + INTERVAL 1 HOUR AS bar_end_ts, bar_start_ts + INTERVAL 3601 SECOND AS available_ts,
         CASE WHEN hour(bar_start_ts - INTERVAL 6 HOUR) BETWEEN 9 AND 14 THEN 'RTH' ELSE 'ETH' END AS session_label, series_id || 'H24' AS contract_id
  FROM (SELECT series_id, date_trunc('hour', event_ts) AS bar_start_ts, first(price ORDER BY event_ts, event_id) AS open, max(price) AS high, min(price) AS low,
               last(price ORDER BY event_ts, event_id) AS close, sum(size) AS volume, count(*) AS trade_count FROM tr GROUP BY 1, 2))"""
GRID = f"""{BARS}, hours AS (SELECT unnest(generate_series((SELECT min(bar_start_ts) FROM bars), (SELECT max(bar_start_ts) FROM bars), INTERVAL 1 HOUR)) AS bar_start_ts),
grid AS (SELECT s.series_id, h.bar_start_ts, b.open, b.high, b.low, b.close, b.volume, b.trade_count, b.close IS NOT NULL AS has_trade, CAST(epoch(h.bar_start_ts) AS BIGINT) AS t,
  CASE WHEN hour(h.bar_start_ts - INTERVAL 6 HOUR) BETWEEN 9 AND 14 THEN 'RTH' ELSE 'ETH' END AS session_label,
  CAST(CAST(h.bar_start_ts - INTERVAL 6 HOUR AS DATE) + CASE WHEN hour(h.bar_start_ts - INTERVAL 6 HOUR) >= 17 THEN 1 ELSE 0 END AS VARCHAR) AS trade_date
  FROM (SELECT DISTINCT series_id FROM bars) s CROSS JOIN hours h LEFT JOIN bars b ON b.series_id = s.series_id AND b.bar_start_ts = h.bar_start_ts)"""
QUOTES = f"""{BARS}, quotes AS (SELECT *, ask - bid AS spread, (ask + bid) / 2 AS mid, NOT missing AND h % 13 <> 0 AS valid FROM (SELECT *,
  CASE WHEN NOT missing THEN close - half END AS bid, CASE WHEN NOT missing THEN close + half END AS ask,
  CASE WHEN NOT missing THEN volume % 9 END AS bid_size, CASE WHEN NOT missing THEN CAST(trade_count AS DOUBLE) END AS ask_size
  FROM (SELECT *, t // 3600 AS h, 0.01::DOUBLE + ((t // 3600) % 7) / 1000.0::DOUBLE AS half, (t // 3600) % 11 = 0 AS missing FROM bars)))"""
BOOK = f"""{BARS}, book AS (SELECT series_id, t, available_ts, book_level, side, close + sgn * book_level * 0.01::DOUBLE AS price,
  CAST(10 + (t // 3600 + book_level * 3 + sgn) % 13 AS DOUBLE) AS size, 1 + (t // 3600 + book_level) % 5 AS order_count
  FROM bars, (SELECT unnest(generate_series(1, 5)) AS book_level), (VALUES ('bid', -1), ('ask', 1)) s(side, sgn) WHERE NOT ((t // 3600) % 17 = 0 AND side = 'ask'))"""
DAILY = """daily AS (SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS day, first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS close, sum(l_quantity) AS volume, count(*) AS trade_count FROM lineitem GROUP BY 1, 2)"""
UNIVERSE = """universe AS (SELECT s_suppkey AS instrument_id, 'S' || (s_suppkey % 50) AS symbol, n_name AS sector, r_name AS asset_class,
  CASE WHEN s_suppkey % 2 = 1 THEN DATE '1993-01-01' ELSE DATE '1992-01-01' END AS active_from, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1996-12-31' END AS active_to,
  'C' || n_regionkey AS calendar_id, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
