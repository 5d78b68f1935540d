"""The forms for long series as registered queries, held against the same SQL as the short ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import diagnostics as D
from barloom.operators import labels as L
from barloom.plans import adapters as A
from barloom.plans import diagnostics_q, labels_q, windows_q  # noqa: F401
from barloom.plans.diagnostics_q import fixed
from barloom.plans.observations import observations
from barloom.plans.registry import ORACLE_SQL, query
from barloom.plans.windows_q import out


@query("win_row_blocks", ORACLE_SQL["win1_rolling_mean"])
def row_blocks(spark, d):
    """A rolling mean over blocks of 100 rows, each with the eleven rows before it."""
    g = A.grid(spark, d)
    return out(W.over(g, W.Series(), lambda x, s: x.select("*", *W.rolling_mean(s, "close", 12).named()), 11, one_task=False, size=100), "value", "value_flags")


@query("d2_stretched_ranks", ORACLE_SQL["d2_rank_ic"])
def stretched_ranks(spark, d):
    """Rank correlations whose ranks come from stretches of the values."""
    by = ["series_id", "horizon_seconds"]
    r = D.ranked(observations(spark, d), by, one_task=False)
    return fixed(r.groupBy(*by).agg(F.count("*").alias("n"), D.pearson("rank_x", "rank_y").alias("rank_ic")))


@query("l11_by_descent", ORACLE_SQL["l11_triple_barrier"])
def by_descent(spark, d):
    """First touches found through block extremes."""
    c = F.col("close")
    r = L.first_touch(A.bars(spark, d), 6, L.level(high_at=c * 1.05), L.level(low_at=c * 0.96), "second", held=0)
    o = F.col("outcome")
    return out(r.withColumn("triple_barrier", F.when(o == "first", 1).when(o == "second", -1).when(o == "none", 0).cast("long")), "triple_barrier")
