"""Registered queries of sources, canonical tables, validation, coverage, grids and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import quality as Y
from barloom.operators import quotes as Q
from barloom.plans import adapters as A
from barloom.plans.diagnostics_q import fixed
from barloom.plans.registry import query
from barloom.plans.windows_q import _CAL, _calendar, out
from barloom.sources import tables as T


def _scratch(spark, name):
    """A new folder in the shared one; on one machine, where none is named, in its temporary folder."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='barloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _plain(spark, d):
    return A.bars(spark, d).select("series_id", "bar_start_ts", "open", "high", "low", "close", "volume", "trade_count")


_RANGE = "bar_start_ts >= TIMESTAMP '2024-01-05' AND bar_start_ts < TIMESTAMP '2024-01-20'"


@query("src1_read_canonical", f"WITH {A.BARS} SELECT series_id, count(*) AS bars, round(sum(close), 6) AS sum_close FROM bars WHERE series_id = 'click' AND {_RANGE} GROUP BY 1")
def src1(spark, d):
    root = _scratch(spark, "canonical")
    T.write_canonical(_plain(spark, d), root, "v1", "ohlcv")
    r = T.read_canonical(spark, root, "v1", "ohlcv", "click", "2024-01-05", "2024-01-20")
    return fixed(r.groupBy("series_id").agg(F.count("*").alias("bars"), F.sum("close").alias("sum_close")))


@query("src2_read_quotes", f"WITH {A.QUOTES} SELECT series_id, count(*) AS quotes, round(sum(bid), 6) AS sum_bid FROM quotes WHERE series_id = 'view' AND {_RANGE} GROUP BY 1")
def src2(spark, d):
    root = _scratch(spark, "canonical")
    T.write_canonical(A.quotes(spark, d), root, "v1", "bbo")
    r = T.read_canonical(spark, root, "v1", "bbo", "view", "2024-01-05", "2024-01-20")
    return fixed(r.groupBy("series_id").agg(F.count("*").alias("quotes"), F.sum("bid").alias("sum_bid")))


_ALL = f"WITH {A.BARS} SELECT series_id, count(*) AS bars, round(avg(close), 6) AS mean_close FROM bars GROUP BY 1"


@query("src3_csv_bars", _ALL)
def src3(spark, d):
    path = _scratch(spark, "csv")
    _plain(spark, d).write.option("header", True).csv(path)
    return fixed(T.close_summary(T.read_csv_bars(spark, path)[0]))


@query("src4_parquet_bars", _ALL)
def src4(spark, d):
    path = _scratch(spark, "parquet")
    _plain(spark, d).write.parquet(path)
    return fixed(T.close_summary(spark.read.schema(T.BAR_SCHEMA).parquet(path)))


@query("src5_jsonl_bars", _ALL)
def src5(spark, d):
    path = _scratch(spark, "jsonl")
    _plain(spark, d).write.json(path)
    return fixed(T.close_summary(T.read_jsonl(spark, path, T.BAR_SCHEMA)))


@query("src6_sql_over_file", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY CUBE (event_type, user_id % 10) HAVING count(*) > 5")
def src6(spark, d):
    return T.sql_over_file(spark, f"{d}/events.parquet", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM data GROUP BY CUBE (event_type, user_id % 10) HAVING count(*) > 5")


@query("src7_close_summary", _ALL)
def src7(spark, d):
    return fixed(T.close_summary(A.bars(spark, d)))


def _returns(spark, d):
    b = A.bars(spark, d)
    return b.select("series_id", "t", "event_ts", "available_ts", W.simple_returns(W.Series(), "close").value.alias("value"))


_RV = f"{A.BARS}, rv AS (SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY t) - 1 AS value FROM bars)"


@query("src8_value_store", f'WITH {_RV} SELECT series_id, count(*) AS "rows", count(value) AS "values", min(t) + 3600 AS first_t, max(t) + 3600 AS last_t, true AS written, false AS written_again FROM rv GROUP BY 1')
def src8(spark, d):
    root, v = _scratch(spark, "values"), _returns(spark, d)
    first = T.write_value_pack(v, root, "f1", ["series_id", "t", "value"])
    again = T.write_value_pack(v, root, "f1", ["series_id", "t", "value"])
    s = T.value_stats(T.read_value_packs(spark, root, ["f1"]), ["series_id"])
    return s.select("series_id", "rows", "values", F.unix_timestamp("first_ts").alias("first_t"), F.unix_timestamp("last_ts").alias("last_t"), F.lit(first).alias("written"), F.lit(again).alias("written_again"))


@query("src9_content_hash", f"WITH {A.BARS} SELECT series_id, true AS same_in_any_order, true AS differs_if_changed FROM bars GROUP BY 1")
def src9(spark, d):
    b = _plain(spark, d)
    h = lambda df, n: df.groupBy("series_id").agg(T.content_hash("bar_start_ts", "close").alias(n))
    a, s, c = h(b, "a"), h(b.repartition(7, "close").sortWithinPartitions("close"), "s"), h(b.withColumn("close", F.when(F.hour("bar_start_ts") == 3, F.col("close") + 1).otherwise(F.col("close"))), "c")
    return a.join(s, "series_id").join(c, "series_id").select("series_id", (F.col("a") == F.col("s")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("differs_if_changed"))


@query("src10_as_of_snapshot", f"WITH {A.BARS} SELECT series_id, count(*) AS bars, max(t) AS last_t FROM bars WHERE available_ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def src10(spark, d):
    return T.as_of(A.bars(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp")).groupBy("series_id").agg(F.count("*").alias("bars"), F.max("t").alias("last_t"))


@query("src11_value_packs_by_id", f"WITH {_RV} SELECT 'f1' AS version_id, count(value) AS \"values\" FROM rv UNION ALL SELECT 'f3', count(volume) FROM rv")
def src11(spark, d):
    root, v = _scratch(spark, "packs"), _returns(spark, d)
    vol = A.bars(spark, d).select("series_id", "t", "event_ts", "available_ts", F.col("volume").alias("value"))
    for name, x in (("f1", v), ("f2", v), ("f3", vol)):
        T.write_value_pack(x, root, name, ["series_id", "t", "value"])
    return T.read_value_packs(spark, root, ["f1", "f3"]).groupBy("version_id").agg(F.count("value").alias("values"))


# --- canonical tables: raw rows are the bars with repeats and faults planted by rule


def _raw(spark, d):
    b = _plain(spark, d).withColumn("t", F.unix_timestamp("bar_start_ts")).withColumn("arrival", F.lit(0))
    again = b.filter("t / 3600 % 10 = 0").withColumn("arrival", F.lit(1)).withColumn("close", F.col("close") + 1)
    u = b.unionByName(again)
    return u.withColumn("high", F.when(F.col("t") / 3600 % 17 == 0, F.col("low") - 1).otherwise(F.col("high")))


_RAW = f"{A.BARS}, raw AS (SELECT series_id, t, bar_start_ts, low, open, close, CASE WHEN (t // 3600) % 17 = 0 THEN low - 1 ELSE high END AS high, 0 AS arrival FROM bars UNION ALL SELECT series_id, t, bar_start_ts, low, open, close + 1, CASE WHEN (t // 3600) % 17 = 0 THEN low - 1 ELSE high END, 1 FROM bars WHERE (t // 3600) % 10 = 0)"


@query("can1_canonical_bars", f"WITH {_RAW} SELECT series_id, CASE WHEN arrival = 1 THEN 'duplicate' WHEN high < low THEN 'invalid' WHEN isodow(bar_start_ts) > 5 THEN 'out_of_session' ELSE 'ok' END AS status, count(*) AS n FROM raw GROUP BY 1, 2")
def can1(spark, d):
    weekday = F.weekday("bar_start_ts") < 5
    return Y.canonical_bars(_raw(spark, d), 1, 60, weekday).groupBy("series_id", "status").agg(F.count("*").alias("n"))


_CQ = f"""{A.TRADES}, mb AS (SELECT DISTINCT series_id, date_trunc('minute', event_ts) AS b FROM tr),
q0 AS (SELECT series_id, event_id, event_ts + INTERVAL 40 SECOND AS ts, CASE WHEN series_id IN ('error', 'purchase') THEN date_trunc('minute', event_ts) END AS ex,
  CASE WHEN event_id % 7 > 0 THEN price - 0.05::DOUBLE END AS bid, CASE WHEN event_id % 10 = 0 THEN price - 1 ELSE price + 0.05::DOUBLE END AS ask, size AS bs, size + 1 AS asz FROM tr),
q1 AS (SELECT *, date_trunc('minute', ts) AS fl FROM q0),
q2 AS (SELECT q.*, coalesce(ex, CASE WHEN own.b IS NOT NULL THEN fl WHEN before.b IS NOT NULL THEN fl - INTERVAL 1 MINUTE ELSE fl END) AS st FROM q1 q
  LEFT JOIN mb own ON own.series_id = q.series_id AND own.b = fl LEFT JOIN mb before ON before.series_id = q.series_id AND before.b = fl - INTERVAL 1 MINUTE),
q3 AS (SELECT *, count(*) OVER (PARTITION BY series_id, st) AS copies FROM q2 QUALIFY row_number() OVER (PARTITION BY series_id, st ORDER BY ts, event_id) = 1),
q4 AS (SELECT q3.*, CASE WHEN mb.b IS NULL THEN 'no_bar' WHEN bid IS NULL OR ask IS NULL THEN 'missing_value' WHEN ask < bid THEN 'crossed' WHEN ts < st OR ts > st + INTERVAL 1 MINUTE THEN 'outside_bar' ELSE 'ok' END AS reason
  FROM q3 LEFT JOIN mb ON mb.series_id = q3.series_id AND mb.b = st)"""


def _minutes(spark, d):
    """Bars and quotes by the minute: every trade makes its minute's bar, and a quote 40 seconds later; two kinds name their bar."""
    t = A.trades(spark, d)
    minute = F.date_trunc("minute", "event_ts")
    bars = t.select("series_id", minute.alias("bar_start_ts")).distinct()
    quotes = t.select(
        "series_id", "event_id", (F.col("event_ts") + F.expr("interval 40 seconds")).alias("event_ts"), F.when(F.col("series_id").isin("error", "purchase"), minute).alias("bar_start_ts"),
        F.when(F.col("event_id") % 7 > 0, F.col("price") - 0.05).alias("bid"), F.when(F.col("event_id") % 10 == 0, F.col("price") - 1).otherwise(F.col("price") + 0.05).alias("ask"), F.col("size").alias("bid_size"), (F.col("size") + 1).alias("ask_size"),
    )
    return quotes, bars


@query("can2_canonical_quotes", f"""WITH {_CQ}
SELECT mb.series_id, CAST(epoch(mb.b) AS BIGINT) AS t, CAST(floor(epoch(CASE WHEN reason = 'ok' THEN ts ELSE mb.b + INTERVAL 1 MINUTE END)) AS BIGINT) AS event_t,
  round(CASE WHEN reason = 'ok' THEN bid ELSE 0 END, 6) AS bid, round(CASE WHEN reason = 'ok' THEN ask ELSE 0 END, 6) AS ask, CASE WHEN reason = 'ok' THEN bs ELSE 0 END AS bid_size,
  round(CASE WHEN reason = 'ok' THEN (bid + ask) / 2 ELSE 0 END, 6) AS mid, round(CASE WHEN reason = 'ok' THEN ask - bid ELSE 0 END, 6) AS spread,
  CASE WHEN reason IS NULL THEN 'missing_bbo' WHEN reason <> 'ok' THEN 'missing_bbo,bbo_quarantined' ELSE '' END AS quality_flags
FROM mb LEFT JOIN q4 ON q4.series_id = mb.series_id AND q4.st = mb.b""")
def can2(spark, d):
    q = Y.canonical_quotes(*_minutes(spark, d), arrival=["event_ts", "event_id"])
    q = q.withColumn("t", F.unix_timestamp("bar_start_ts")).withColumn("event_t", F.unix_timestamp("event_ts"))
    return out(q, "event_t", "bid", "ask", "bid_size", "mid", "spread", "quality_flags")


@query("can2_quote_counts", f"""WITH {_CQ}, n AS (SELECT series_id, count(*) AS bars FROM mb GROUP BY 1)
SELECT series_id, sum(copies - 1)::BIGINT AS duplicates, count(*) FILTER (reason = 'no_bar') AS no_bar, count(*) FILTER (reason = 'missing_value') AS missing_value, count(*) FILTER (reason = 'crossed') AS crossed,
  count(*) FILTER (reason = 'outside_bar') AS outside_bar, any_value(bars) - count(*) FILTER (reason = 'ok') AS missing FROM q4 JOIN n USING (series_id) GROUP BY 1""")
def can2_counts(spark, d):
    return Y.quote_counts(*_minutes(spark, d), arrival=["event_ts", "event_id"])


@query("can3_canonical_trades", f"WITH {A.TRADES} SELECT series_id, count(*) AS trades, round(sum(price), 4) AS total FROM tr GROUP BY 1")
def can3(spark, d):
    t = A.trades(spark, d)
    twice = t.unionByName(t.filter("event_id % 5 = 0"))
    return Y.canonical_trades(twice, ["series_id", "event_ts", "price", "size", "event_id"]).groupBy("series_id").agg(F.count("*").alias("trades"), F.round(F.sum("price"), 4).alias("total"))


@query("can4_normalize_metadata", "SELECT CASE event_type WHEN 'click' THEN 'definition' WHEN 'view' THEN 'statistics' END AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def can4(spark, d):
    raw = A.table(spark, d, "events").select(F.concat(F.lit(" "), F.upper("event_type")).alias("record_type"))
    return Y.normalize_metadata(raw, {"click": "definition", "view": "statistics"}).groupBy("kind").agg(F.count("*").alias("n"))


@query("can5_parse_raw", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def can5(spark, d):
    return Y.parse_raw(A.table(spark, d, "events"), "props", "k long").groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"))


@query("val1_bar_validation", f"WITH {_RAW} SELECT issue, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN high < low THEN ['high_below_low'] ELSE [] END, CASE WHEN open > high OR open < low THEN ['open_out_of_range'] ELSE [] END, CASE WHEN close > high OR close < low THEN ['close_out_of_range'] ELSE [] END)) AS issue FROM raw) GROUP BY 1")
def val1(spark, d):
    raw = Y.canonical_bars(_raw(spark, d), 1, 60, F.lit(True))
    return raw.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("val2_quote_invariants", f"WITH {A.QUOTES} SELECT count(*) AS quotes, count(*) FILTER (NOT missing AND (t // 3600) % 19 <> 0) AS fine, count(*) FILTER (NOT missing AND (t // 3600) % 19 = 0) AS mid_mismatch FROM quotes")
def val2(spark, d):
    q = A.quotes(spark, d).withColumn("mid", Q.mid() + F.when(F.col("t") / 3600 % 19 == 0, 0.5).otherwise(0.0)).withColumn("spread", Q.spread()).withColumn("microprice", F.coalesce(Q.microprice(), Q.mid()))
    q = q.withColumn("issues", Y.quote_issues())
    there = F.col("bid").isNotNull()
    return q.agg(F.count("*").alias("quotes"), F.count_if(there & (F.size("issues") == 0)).alias("fine"), F.count_if(there & F.array_contains("issues", "mid_mismatch")).alias("mid_mismatch"))


@query("val3_real_trade_split", f"WITH {A.GRID} SELECT series_id, count(*) FILTER (has_trade) AS real_trades, count(*) FILTER (NOT has_trade) AS no_trades FROM grid GROUP BY 1")
def val3(spark, d):
    return A.grid(spark, d).groupBy("series_id").agg(F.count_if(Y.is_real_trade()).alias("real_trades"), F.count_if(~Y.is_real_trade()).alias("no_trades"))


@query("val4_missing_quote_split", f"WITH {A.QUOTES} SELECT series_id, count(*) FILTER (missing) AS missing, count(*) FILTER (missing OR h % 13 = 0) AS abnormal FROM quotes GROUP BY 1")
def val4(spark, d):
    return A.quotes(spark, d).groupBy("series_id").agg(F.count_if(Q.is_missing()).alias("missing"), F.count_if(Q.is_abnormal()).alias("abnormal"))


_IN = f"{A.BARS}, {_CAL}, ii AS (SELECT b.*, c.day IS NULL AS outside FROM bars b LEFT JOIN cal c ON CAST(b.bar_start_ts - INTERVAL 6 HOUR AS DATE) = c.day AND b.bar_start_ts >= c.open_ts AND b.bar_end_ts <= c.close_ts)"
_EX = "ex AS (SELECT s.series_id, c.day, c.open_ts + to_hours(CAST(k AS INT)) AS b FROM (SELECT DISTINCT series_id FROM bars) s, cal c, generate_series(0, 5) g(k) WHERE c.open_ts + to_hours(CAST(k AS INT) + 1) <= c.close_ts)"


def _half(spark, d):
    """Half-hour-shifted bars, so that bar starts fall on the sessions' opening half hour."""
    b = A.bars(spark, d)
    shift = F.expr("interval 30 minutes")
    return b.withColumn("bar_start_ts", F.col("bar_start_ts") + shift).withColumn("bar_end_ts", F.col("bar_end_ts") + shift)


_HB = f"{A.BARS}, hb AS (SELECT series_id, bar_start_ts + INTERVAL 30 MINUTE AS b, bar_end_ts + INTERVAL 30 MINUTE AS e FROM bars), {_CAL}"


@query("qua1_out_of_session", f"WITH {_IN} SELECT series_id, t, outside AS out_of_session FROM ii")
def qua1(spark, d):
    return out(Y.outside_sessions(A.bars(spark, d), _calendar(spark, d)), "out_of_session")


@query("qua2_duplicate_bars", f"WITH {_RAW} SELECT 'series_id,bar_start_ts' AS key, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM raw GROUP BY series_id, bar_start_ts) WHERE n > 1 UNION ALL SELECT 'series_id,t', count(*), CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY series_id, t) WHERE n > 1")
def qua2(spark, d):
    return Y.duplicate_counts(_raw(spark, d), [["series_id", "bar_start_ts"], ["series_id", "t"]])


_MS = f"{_HB}, {_EX}, want AS (SELECT * FROM ex WHERE EXISTS (SELECT 1 FROM ex x JOIN hb ON hb.series_id = x.series_id AND hb.b = x.b WHERE x.series_id = ex.series_id AND x.day = ex.day)), ms AS (SELECT * FROM want w WHERE NOT EXISTS (SELECT 1 FROM hb WHERE hb.series_id = w.series_id AND hb.b = w.b))"


@query("qua3_missing_bars", f"WITH {_MS} SELECT series_id, CAST(day AS VARCHAR) AS date, CAST(epoch(b) AS BIGINT) AS t FROM ms")
def qua3(spark, d):
    m = Y.missing_bars(_half(spark, d), _calendar(spark, d), 60)
    return m.select("series_id", F.col("date").cast("string").alias("date"), F.unix_timestamp("bar_start_ts").alias("t"))


@query("o5_except_missing", f"WITH {_MS} SELECT series_id, count(*) AS missing FROM (SELECT series_id, b FROM want EXCEPT SELECT series_id, b FROM hb) GROUP BY 1")
def o5(spark, d):
    h = _half(spark, d)
    want = Y.expected_bars(h, _calendar(spark, d), 60)
    seen = want.join(h, ["series_id", "bar_start_ts"]).select("series_id", "date").distinct()
    want = want.join(seen, ["series_id", "date"], "left_semi").select("series_id", "bar_start_ts")
    return want.exceptAll(h.select("series_id", "bar_start_ts")).groupBy("series_id").agg(F.count("*").alias("missing"))


@query("qua4_quality_run", f"""WITH {_MS} SELECT series_id, 'missing' AS "check", count(*) AS n FROM ms GROUP BY 1 UNION ALL SELECT series_id, 'out_of_session', count(*) FROM hb WHERE NOT EXISTS (SELECT 1 FROM cal c WHERE CAST(b - INTERVAL 6 HOUR AS DATE) = c.day AND b >= c.open_ts AND e <= c.close_ts) GROUP BY 1""")
def qua4(spark, d):
    return Y.quality_run(_half(spark, d), _calendar(spark, d), 60)


@query("qua5_quality_reports", f"WITH {A.QUOTES} SELECT series_id, count(*) AS quotes, count(*) FILTER (missing) AS missing, count(*) FILTER (spread > 0.03) AS wide, round(avg(spread), 6) AS mean_spread FROM quotes GROUP BY 1")
def qua5(spark, d):
    q = A.quotes(spark, d)
    return fixed(q.groupBy("series_id").agg(F.count("*").alias("quotes"), F.count_if(Q.is_missing()).alias("missing"), F.count_if(Q.spread() > 0.03).alias("wide"), F.avg(Q.spread()).alias("mean_spread")))


@query("qua6_expected_intervals", f"WITH {A.BARS}, {_CAL}, {_EX} SELECT series_id, CAST(day AS VARCHAR) AS date, count(*) AS expected FROM ex GROUP BY 1, 2")
def qua6(spark, d):
    e = Y.expected_bars(_half(spark, d), _calendar(spark, d), 60)
    return e.groupBy("series_id", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("expected"))


def _cover_sql(mode):
    """The metrics of every slot of five minutes, listed one by one, of hourly sessions with a break of ten minutes."""
    synthetic = "c.t IS NULL AND rth" if mode == "dense" else "false"
    return f"""SELECT '{mode}' AS mode, series_id, sum(expected)::BIGINT AS expected, sum(observed)::BIGINT AS observed, sum(traded)::BIGINT AS traded, sum(synthetic)::BIGINT AS synthetic, sum(unfilled)::BIGINT AS unfilled, sum(no_trade)::BIGINT AS no_trade,
  sum(long_runs)::BIGINT AS long_runs, sum(long_run_bars)::BIGINT AS long_run_bars, sum(gap)::BIGINT AS gap, sum(absent_bars)::BIGINT AS non_trading_bars, count(*) FILTER (absent) AS non_trading_intervals, round(coalesce(sum(no_trade) / nullif(sum(expected), 0), 0), 6) AS no_trade_ratio
FROM (SELECT series_id, h, s, absent, n * absent::INT AS absent_bars, n * (1 - absent::INT) AS expected, observed * (1 - absent::INT) AS observed, traded * (1 - absent::INT) AS traded, synthetic * (1 - absent::INT) AS synthetic,
  CASE WHEN absent THEN 0 WHEN observed = 0 THEN n ELSE greatest((op - s) // 300, 0) END AS unfilled, coalesce(synthetic * (1 - absent::INT), 0) + coalesce(r_no, 0) AS no_trade, coalesce(r_long, 0) AS long_runs, coalesce(r_bars, 0) AS long_run_bars, coalesce(r_gap, 0) AS gap
  FROM (SELECT series_id, h, s, bool_and(sf IS NULL) AS absent, count(*) AS n, count(*) FILTER (tr OR sy) AS observed, count(*) FILTER (tr) AS traded, count(*) FILTER (sy) AS synthetic, any_value(coalesce(f, sf)) AS op FROM m_{mode} GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT series_id, h, s, sum(n) FILTER (lg OR '{mode}' = 'sparse') AS r_no, count(*) FILTER (lg) AS r_long, sum(n) FILTER (lg) AS r_bars, sum(n) FILTER (NOT lg AND '{mode}' = 'dense') AS r_gap
    FROM (SELECT *, coalesce(f < a AND l >= b, false) AND n > 1 AS lg FROM (SELECT series_id, h, s, i, min(t) AS a, max(t) + 300 AS b, count(*) AS n, any_value(f) AS f, any_value(l) AS l, any_value(coalesce(f, sf)) AS op, any_value(obs) AS obs
      FROM (SELECT *, t // 300 - row_number() OVER (PARTITION BY series_id, h, s ORDER BY t) AS i FROM (SELECT *, count(*) FILTER (tr OR sy) OVER (PARTITION BY series_id, h, s) AS obs FROM m_{mode}) WHERE NOT tr AND NOT sy AND obs > 0) GROUP BY 1, 2, 3, 4) WHERE b > op) GROUP BY 1, 2, 3) USING (series_id, h, s))
GROUP BY 2""", f"""m_{mode} AS (SELECT *, min(t) FILTER (tr) OVER (PARTITION BY series_id, h) AS sf, min(t) FILTER (tr) OVER (PARTITION BY series_id, h, s) AS f, max(t) FILTER (tr) OVER (PARTITION BY series_id, h, s) AS l
  FROM (SELECT x.series_id, x.h, x.s, x.t, c.t IS NOT NULL AS tr, {synthetic} AS sy FROM slots x LEFT JOIN five c ON c.series_id = x.series_id AND c.t = x.t))"""


_SLOTS = f"""{A.TRADES}, five AS (SELECT DISTINCT series_id, CAST(floor(epoch(event_ts)) AS BIGINT) // 300 * 300 AS t FROM tr), hs AS (SELECT unnest(generate_series((SELECT min(t) // 3600 * 3600 FROM five), (SELECT max(t) // 3600 * 3600 FROM five), 3600)) AS h),
slots AS (SELECT series_id, h, h + o AS s, h + o + k AS t, (h - 6 * 3600) // 3600 % 24 BETWEEN 9 AND 14 AS rth FROM (SELECT DISTINCT series_id FROM five), hs, (SELECT unnest([0, 2100]) AS o), (SELECT unnest(generate_series(0, 1200, 300)) AS k))"""


@query("qua7_coverage", f"WITH {_SLOTS}, {_cover_sql('sparse')[1]}, {_cover_sql('dense')[1]} {_cover_sql('sparse')[0]} UNION ALL {_cover_sql('dense')[0]}")
def qua7(spark, d):
    """Bars of five minutes against hourly sessions with a break, once sparse and once as a grid that is filled in RTH hours."""
    five = A.trades(spark, d).select("series_id", (F.floor(F.unix_timestamp("event_ts") / 300) * 300).alias("t")).distinct().withColumn("h", (F.floor(F.col("t") / 3600) * 3600))
    span = five.agg(F.min("h").alias("a"), F.max("h").alias("b")).select(F.explode(F.sequence("a", "b", F.lit(3600).cast("long"))).alias("h"))
    hours = five.select("series_id").distinct().crossJoin(F.broadcast(span))
    parts = F.explode(F.array(*[F.struct((F.col("h") + o).alias("start_t"), (F.col("h") + o + 1500).alias("end_t")) for o in (0, 2100)]))
    intervals = hours.select("series_id", "h", parts.alias("p")).select("series_id", "h", "p.*")
    slots = intervals.filter(F.floor((F.col("h") - 6 * 3600) / 3600) % 24 >= 9).filter(F.floor((F.col("h") - 6 * 3600) / 3600) % 24 <= 14).select("series_id", "h", F.explode(F.sequence("start_t", F.col("end_t") - 300, F.lit(300).cast("long"))).alias("t"))
    filled = slots.join(five, ["series_id", "h", "t"], "left_anti").select("series_id", "h", "t", F.lit(False).alias("has_trade"), F.lit(True).alias("synthetic"))
    grid = five.select("series_id", "h", "t", F.lit(True).alias("has_trade"), F.lit(False).alias("synthetic")).unionByName(filled)
    sparse = Y.coverage(intervals, five, ["series_id"], ["h"], 1, 300).withColumn("mode", F.lit("sparse"))
    return fixed(sparse.unionByName(Y.coverage(intervals, grid, ["series_id"], ["h"], 1, 300, dense=True).withColumn("mode", F.lit("dense"))))


@query("qua8_missing_runs", f"WITH {A.GRID}, m AS (SELECT *, t // 3600 - row_number() OVER (PARTITION BY series_id ORDER BY t) AS i FROM grid WHERE NOT has_trade) SELECT series_id, min(t // 3600) AS first, max(t // 3600) AS last, count(*) AS length FROM m GROUP BY series_id, i")
def qua8(spark, d):
    return Y.runs(A.grid(spark, d).filter("not has_trade").withColumn("h", (F.col("t") / 3600).cast("long")), ["series_id"], "h")


@query("qua9_non_trading_sessions", "WITH x AS (SELECT l_suppkey AS s, CAST(date_trunc('week', l_shipdate) AS DATE) AS w FROM lineitem), g AS (SELECT a.s, b.w FROM (SELECT DISTINCT s FROM x) a, (SELECT DISTINCT w FROM x) b) SELECT CAST(g.w AS VARCHAR) AS week, count(*) AS absent, false AS all_absent FROM g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.s = g.s AND x.w = g.w) GROUP BY 1")
def qua9(spark, d):
    x = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.trunc("l_shipdate", "week").alias("w")).distinct()
    g = x.select("s").distinct().crossJoin(F.broadcast(x.select("w").distinct())).join(x.withColumn("h", F.lit(True)), ["s", "w"], "left").withColumn("has_trade", F.coalesce("h", F.lit(False)))
    return Y.non_trading_sessions(g, "s", "w").groupBy(F.col("w").cast("string").alias("week")).agg(F.count("*").alias("absent"), F.bool_or("all_absent").alias("all_absent"))


@query("qua10_minute_grid", 'SELECT event_type, count(*) AS "rows", count(*) FILTER (ts <> date_trunc(\'minute\', ts) AND event_id % 2 = 1) AS off_grid, count(*) FILTER (ts <> date_trunc(\'minute\', ts) AND event_id % 2 = 0) AS allowed FROM events GROUP BY 1')
def qua10(spark, d):
    return Y.off_grid(A.table(spark, d, "events"), ["event_type"], "ts", F.col("event_id") % 2 == 0)


@query("den1_dense_grid", f"WITH {A.GRID}, x AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS lc FROM grid) SELECT series_id, t, round(coalesce(open, lc), 6) AS open, round(coalesce(close, lc), 6) AS close, coalesce(volume, 0) AS volume, NOT has_trade AS synthetic, CASE WHEN NOT has_trade THEN 'previous_close' END AS fill_method FROM x WHERE lc IS NOT NULL")
def den1(spark, d):
    return out(Y.densify(A.grid(spark, d), ["series_id"]), "open", "close", "volume", "synthetic", "fill_method")


_CV = f"{A.GRID}, fl AS (SELECT *, min(t) FILTER (has_trade) OVER p AS f0, max(t) FILTER (has_trade) OVER p AS l0 FROM grid WINDOW p AS (PARTITION BY series_id)), ho AS (SELECT *, t // 3600 - row_number() OVER (PARTITION BY series_id ORDER BY t) AS i FROM fl WHERE NOT has_trade AND t > f0 AND t < l0), hr AS (SELECT series_id, i, min(t) AS a, max(t) AS b, count(*) AS len FROM ho GROUP BY 1, 2)"


@query("den2_long_no_trade_runs", f"WITH {_CV} SELECT series_id, a AS first_t, b AS last_t, len AS length FROM hr WHERE len > 1")
def den2(spark, d):
    g = A.grid(spark, d)
    s = W.Series(("series_id",), ("t",))
    inner = g.withColumn("before", F.max(F.when(F.col("has_trade"), 1)).over(s.expanding())).withColumn("after", F.max(F.when(F.col("has_trade"), 1)).over(s.window().rowsBetween(0, Window.unboundedFollowing))).filter("not has_trade and before = 1 and after = 1")
    r = Y.runs(inner.withColumn("h", (F.col("t") / 3600).cast("long")), ["series_id"], "h").filter("length > 1")
    return r.select("series_id", (F.col("first") * 3600).alias("first_t"), (F.col("last") * 3600).alias("last_t"), "length")


def _other(spark, d):
    """A second source: every eleventh bar is missing, every thirteenth a cent higher."""
    h = F.col("t") / 3600
    return A.bars(spark, d).filter(h % 11 != 0).withColumn("close", F.when(h % 13 == 0, F.col("close") + 0.01).otherwise(F.col("close")))


_OT = f"{A.BARS}, ot AS (SELECT * REPLACE (CASE WHEN (t // 3600) % 13 = 0 THEN close + 0.01::DOUBLE ELSE close END AS close) FROM bars WHERE (t // 3600) % 11 <> 0)"


@query("cmp1_two_sources", f"WITH {_OT}, j AS (SELECT coalesce(a.series_id, b.series_id) AS series_id, a.close AS x, b.close AS y, a.volume - b.volume AS dv FROM bars a FULL JOIN ot b ON a.series_id = b.series_id AND a.t = b.t) SELECT series_id, count(x) AS rows_a, count(y) AS rows_b, count(abs(x - y)) AS overlap, round(avg(abs(x - y)), 6) AS mean_abs_diff, round(max(abs(x - y)), 6) AS max_abs_diff, round(corr(x, y), 6) AS correlation, sum(dv) AS volume_diff, count(*) FILTER (y IS NULL) AS missing_in_b, count(*) FILTER (x IS NULL) AS missing_in_a FROM j GROUP BY 1")
def cmp1(spark, d):
    return fixed(Y.compare_sources(A.bars(spark, d), _other(spark, d), ["series_id"], ["t"]))


@query("j7_full_outer", f"WITH {_OT} SELECT count(*) AS keys, count(b.t) AS in_both FROM bars a FULL JOIN ot b ON a.series_id = b.series_id AND a.t = b.t")
def j7(spark, d):
    r = Y.compare_sources(A.bars(spark, d), _other(spark, d), ["series_id"], ["t"])
    return r.agg((F.sum("rows_a") + F.sum("missing_in_a")).alias("keys"), F.sum("overlap").alias("in_both"))


@query("cmp2_reconciliation", f"WITH {_OT}, j AS (SELECT coalesce(a.series_id, b.series_id) AS series_id, a.close AS x, b.close AS y FROM bars a FULL JOIN ot b ON a.series_id = b.series_id AND a.t = b.t) SELECT series_id, count(*) FILTER (x = y) AS exact, count(*) FILTER (x <> y AND abs(x - y) <= 0.1) AS \"within\", count(*) FILTER (abs(x - y) > 0.1) AS beyond, count(*) FILTER (y IS NULL) AS missing_in_b, count(*) FILTER (x IS NULL) AS missing_in_a, round(max(abs(x - y)), 6) AS max_diff, round(quantile_cont(abs(x - y), 0.5), 6) AS median_diff, 'BEYOND' AS verdict FROM j GROUP BY 1")
def cmp2(spark, d):
    return fixed(Y.reconcile(A.bars(spark, d), _other(spark, d), ["series_id"], ["t"], 0.1, "close"))


@query("spr1_spread_proxy", f"WITH {A.QUOTES} SELECT series_id, t, round(spread, 6) AS spread_proxy, round(spread / mid * 1e4, 6) AS spread_proxy_bps FROM quotes")
def spr1(spark, d):
    return out(Y.spread_proxy(A.quotes(spark, d)), "spread_proxy", "spread_proxy_bps")


# --- sorts, limits and sets


@query("o1_deterministic_order", f"WITH {A.TRADES} SELECT event_id, row_number() OVER (PARTITION BY series_id ORDER BY event_ts, event_id) AS position FROM tr")
def o1(spark, d):
    return Q.research_order(A.trades(spark, d).withColumn("available_ts", F.col("event_ts")), "event_id").select("event_id", "position")


@query("o2_top_k", "SELECT c_custkey, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 20")
def o2(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "c_custkey").limit(20).select("c_custkey", F.round("s", 2).alias("total"))


@query("o3_union", f"WITH {A.BARS} SELECT series_id, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT series_id, high AS v FROM bars UNION ALL SELECT series_id, low FROM bars) GROUP BY 1")
def o3(spark, d):
    b = A.bars(spark, d)
    u = b.select("series_id", F.col("high").alias("v")).unionByName(b.select(F.col("low").alias("v"), "series_id"))
    return fixed(u.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("v").alias("total")))


@query("o4_intersect", f"WITH {A.BARS} SELECT t FROM bars WHERE series_id = 'click' INTERSECT SELECT t FROM bars WHERE series_id = 'view' INTERSECT SELECT t FROM bars WHERE series_id = 'purchase'")
def o4(spark, d):
    b = A.bars(spark, d)
    of = lambda s: b.filter(F.col("series_id") == s).select("t")
    return of("click").intersect(of("view")).intersect(of("purchase"))


@query("o6_keep_first", f"WITH {_RAW} SELECT series_id, t, round(close, 6) AS close, n AS copies FROM (SELECT *, count(*) OVER (PARTITION BY series_id, t) AS n FROM raw) WHERE arrival = 0")
def o6(spark, d):
    return out(Y.keep_first(_raw(spark, d), ["series_id", "t"], ["arrival"]), "close", "copies")


@query("j6_range_join", f"WITH {A.BARS}, {_CAL} SELECT CAST(c.day AS VARCHAR) AS date, count(*) AS bars FROM bars b JOIN cal c ON b.bar_start_ts >= c.open_ts AND b.bar_end_ts <= c.close_ts GROUP BY 1")
def j6(spark, d):
    from barloom.functions import sessions as S

    s = S.sessionize(A.bars(spark, d), _calendar(spark, d), 60).filter("bar_index >= 0")
    return s.groupBy(F.to_date(S.local("bar_start_ts")).cast("string").alias("date")).agg(F.count("*").alias("bars"))
