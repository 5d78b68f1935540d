"""Places and ranks in groups of any size.

A table that one task can hold takes one window for each group.  A larger one
is cut by the values themselves: quantiles of the whole table are bounds, each
bound's value and each range between two bounds is a stretch, and a group's
rows of one stretch are one window.  What lies before a stretch in its group is
a running sum over the stretches' counts.  Equal values never part, so ties
need nothing at the edges; a value with so many rows that it is a bound is cut
further by the next column of the order, or, for ranks, needs no window at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import timeline as T

#: Bounds of the values, and of the next column inside one value.
STRETCHES, CUTS = 128, 32


def bounds(df: DataFrame, column: str, number: int) -> list:
    """Distinct quantiles of a column, at most ``number``: one aggregation, whose result alone goes to the driver."""
    found = df.agg(F.percentile_approx(column, [k / (number + 1) for k in range(1, number + 1)], 10 * number)).first()[0]
    return sorted(set(found or []))


def stretch(column: Column, at: list) -> Column:
    """2k + 1 for the k-th bound's value, 2k for values between the bounds k - 1 and k, -1 for null."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        bound = F.lit(at[middle])
        return F.when(column < bound, among(low, middle)).when(column == bound, F.lit(2 * middle + 1)).otherwise(among(middle + 1, high))

    return F.when(column.isNull(), F.lit(-1)).otherwise(among(0, len(at)))


def _cuttable(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType.typeName()
    return kind in ("byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal")


def _stretches(df: DataFrame, by: Sequence[str], number: int) -> DataFrame:
    """(by, __s, __c) with the rows before it in its group, those of its value's stretch, and of the group."""
    counts = df.groupBy(*by, "__s", "__c").agg(F.count("*").alias("__here"))
    group = Window.partitionBy(*by)
    before = F.sum("__here").over(group.orderBy("__s", "__c").rowsBetween(Window.unboundedPreceding, -1))
    of_value = Window.partitionBy(*by, "__s")
    d = counts.select(*by, "__s", "__c", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__here").over(of_value).alias("__alike"), F.sum("__here").over(group).alias("__all"))
    return d.withColumn("__below", F.min("__before").over(of_value))


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "place", count: str | None = None, one_task: bool | None = None, stretches: int = STRETCHES, cuts: int = CUTS) -> DataFrame:
    """Places from 0 in the order of a group, nulls first, and (``count``) the number of the group's rows.

    Of rows that are equal in the whole order any may come first.
    """
    group = Window.partitionBy(*by)
    small = T.fits_one_task(df) if one_task is None else one_task
    if small or not _cuttable(df, order[0]):
        d = df.withColumn(name, (F.row_number().over(group.orderBy(*order)) - 1).cast("long"))
        return d.withColumn(count, F.count("*").over(group)) if count else d
    d = df.withColumn("__s", stretch(F.col(order[0]), bounds(df, order[0], stretches)))
    again = len(order) > 1 and _cuttable(df, order[1])
    heavy = F.col("__s") % 2 != 0
    d = d.withColumn("__c", F.when(heavy, stretch(F.col(order[1]), bounds(df, order[1], cuts))).otherwise(0) if again else F.lit(0))
    own = F.row_number().over(Window.partitionBy(*by, "__s", "__c").orderBy(*order)) - 1
    met = T.attach(d.withColumn("__own", own), _stretches(d, by, stretches).drop("__alike", "__below"), [*by, "__s", "__c"])
    met = met.withColumn(name, (F.col("__before") + F.col("__own")).cast("long"))
    if count:
        met = met.withColumn(count, F.col("__all"))
    return met.drop("__s", "__c", "__own", "__before", "__all")


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str, one_task: bool | None = None, stretches: int = STRETCHES, salts: int = CUTS) -> DataFrame:
    """Ranks from 1 of a group's values, ties at the mean of their places, nulls first."""
    group = Window.partitionBy(*by)
    small = T.fits_one_task(df) if one_task is None else one_task
    if small or not _cuttable(df, value):
        return df.withColumn(name, F.rank().over(group.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)
    d = df.withColumn("__s", stretch(F.col(value), bounds(df, value, stretches)))
    heavy = F.col("__s") % 2 != 0
    # a heavy value's rows need no window of their own; they are only dealt out
    d = d.withColumn("__c", F.when(heavy, F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).otherwise(0))
    stretch_keys = [*by, "__s", "__c"]
    within = F.rank().over(Window.partitionBy(*stretch_keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*stretch_keys, value)) - 1) / 2
    met = T.attach(d.withColumn("__own", within), _stretches(d, by, stretches).drop("__before", "__all"), stretch_keys)
    rank = F.when(heavy, F.col("__below") + (F.col("__alike") + 1) / 2).otherwise(F.col("__below") + F.col("__own"))
    return met.withColumn(name, rank).drop("__s", "__c", "__own", "__below", "__alike")
