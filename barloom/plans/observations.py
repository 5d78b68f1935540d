"""The observation table of the diagnostics: factor F1 and label L1 of hourly bars, with path outcomes and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import labels as L
from barloom.plans import adapters as A

N, TARGET, STOP = 6, 0.05, 0.04


def factors(spark, d):
    b = A.bars(spark, d)
    return b.select("series_id", "t", "event_ts", "available_ts", "session_label", "volume", "trade_count", W.simple_returns(W.Series(), "close").value.alias("f"))


def returns(spark, d):
    r = L.forward_returns(A.bars(spark, d), [60, 180], guard=False)
    return r.select("series_id", "t", (F.col("horizon").cast("long") * 60).alias("horizon_seconds"), F.col("value").alias("y"), "label_available_ts")


def observations(spark, d):
    """Inner join of factors and returns on (series, time); path outcomes where they are known."""
    b = A.bars(spark, d)
    path = L.excursions(b, N).select("series_id", "t", "mfe", "mae")
    hit = L.barrier(b, N, TARGET, STOP).select("series_id", "t", F.col("target_before_stop").alias("tbs"), "steps", (F.col("outcome") == "second").alias("stop_first"), (F.col("outcome") == "both").alias("ambiguous"))
    h = F.col("t") / 3600
    o = factors(spark, d).join(returns(spark, d), ["series_id", "t"]).join(path, ["series_id", "t"], "left").join(hit, ["series_id", "t"], "left")
    return o.withColumns({
        "spread": F.when(h % 11 != 0, 0.02 + (h % 7) / 500), "liquidity": F.col("volume"), "slippage": F.col("trade_count") / 1000, "participation": 1 / F.col("volume"),
        "regime": F.when(h % 5 != 0, F.when(h % 2 == 0, "calm").otherwise("busy")), "bar_index": F.hour("event_ts"), "day": F.to_date("event_ts"),
    })


_T, _S = f"f.high >= e.close * (1 + {TARGET}::DOUBLE)", f"f.low <= e.close * (1 - {STOP}::DOUBLE)"
OBS = f"""{A.BARS}, nb AS (SELECT *, row_number() OVER w0 AS k, count(*) OVER (PARTITION BY series_id) AS total, close / lag(close) OVER w0 - 1 AS fv,
  CASE WHEN count(*) OVER w1 = {N} THEN max(high) OVER w1 / close - 1 END AS mfe, CASE WHEN count(*) OVER w1 = {N} THEN min(low) OVER w1 / close - 1 END AS mae FROM bars
  WINDOW w0 AS (PARTITION BY series_id ORDER BY t), w1 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {N} FOLLOWING)),
hit AS (SELECT e.series_id, e.t, min(f.k) AS hk FROM nb e JOIN nb f ON f.series_id = e.series_id AND f.k > e.k AND f.k <= e.k + {N} WHERE ({_T}) OR ({_S}) GROUP BY 1, 2),
oc AS (SELECT e.*, CASE WHEN f.k IS NULL THEN CASE WHEN e.k + {N} <= e.total THEN 'none' END WHEN {_T} AND {_S} THEN 'both' WHEN {_T} THEN 'first' ELSE 'second' END AS outcome, coalesce(f.k - e.k, CASE WHEN e.k + {N} <= e.total THEN {N} END) AS steps
  FROM nb e LEFT JOIN hit h USING (series_id, t) LEFT JOIN nb f ON f.series_id = e.series_id AND f.k = h.hk),
obs AS (SELECT a.series_id, a.t, a.fv AS f, hz * 60 AS horizon_seconds, b.close / a.close - 1 AS y, a.mfe, a.mae, CASE WHEN a.outcome <> 'both' THEN a.outcome = 'first' END AS tbs, a.steps, a.outcome = 'second' AS stop_first, a.outcome = 'both' AS ambiguous,
  CASE WHEN (a.t // 3600) % 11 <> 0 THEN 0.02::DOUBLE + ((a.t // 3600) % 7) / 500.0::DOUBLE END AS spread, a.volume AS liquidity, a.trade_count / 1000.0::DOUBLE AS slippage, 1 / a.volume AS participation, a.session_label, a.bar_end_ts,
  CASE WHEN (a.t // 3600) % 5 <> 0 THEN CASE WHEN (a.t // 3600) % 2 = 0 THEN 'calm' ELSE 'busy' END END AS regime, hour(a.bar_end_ts) AS bar_index, CAST(a.bar_end_ts AS DATE) AS day
  FROM oc a, (SELECT unnest([60, 180]) AS hz) JOIN bars b ON b.series_id = a.series_id AND b.t = a.t + hz * 60)"""


def corr_sql(x, y):
    return f"CASE WHEN count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) >= 2 THEN round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER ({y} IS NOT NULL) * stddev_pop({y}) FILTER ({x} IS NOT NULL), 0), 6) END"
