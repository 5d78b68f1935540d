"""First passage: the first later row of a series that meets a level, by a descent through block extremes.

Rows are numbered; nodes of 64 places hold their rows' highs and lows, nodes of
64 such nodes the extremes of each, and so on.  A row looks in the rest of its
own node, then in the rest of the node above, up to the level that spans its
reach, where it also looks into the following node; then it goes down again to
the first child that meets a level.  Each step is an equi-join on a node's
number and a search in at most 64 entries, so a row's memory does not depend on
how far it looks, and rows may look to different ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import ranks as R
from barloom.functions import timeline as T

BITS = 6
FAN = 1 << BITS


def _meets(x: Column) -> Column:
    return F.coalesce(x["high"] >= F.col("__up"), F.lit(False)) | F.coalesce(x["low"] <= F.col("__down"), F.lit(False))


def _nodes(d: DataFrame, keys: Sequence[str], levels: int, carried: Sequence[str]) -> list[DataFrame]:
    """For each level (keys, __node, kids): kids are structs (at, high, low) in order, rows also with the carried columns."""
    found, below = [], d.select(*keys, F.col("__p").alias("__id"), "high", "low", *carried)
    for k in range(levels):
        extra = carried if k == 0 else ()
        kids = F.sort_array(F.collect_list(F.struct(F.col("__id").bitwiseAND(F.lit(FAN - 1)).alias("at"), "high", "low", *extra)))
        found.append(below.groupBy(*keys, F.shiftright("__id", BITS).alias("__node")).agg(kids.alias("__kids"), F.max("high").alias("high"), F.min("low").alias("low")))
        below = found[-1].select(*keys, F.col("__node").alias("__id"), "high", "low")
    return [x.select(*keys, "__node", "__kids") for x in found]


def first_passage(rows: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int, up: Column, down: Column, carried: Sequence[str] = (), segment: str | None = None, name: str = "hit", one_task: bool | None = None) -> DataFrame:
    """The first of the next ``reach`` rows whose high is at or above ``up`` or whose low is at or below ``down``.

    With a ``segment`` a row looks no further than the last row of its own.
    Adds ``name``, a struct of high, low, the carried columns and steps (null
    where no row meets a level), place, last_place (of its key) and end_place,
    the place that the row looks to.  Null levels, highs and lows meet nothing.
    The order must be full.
    """
    levels = 1
    while FAN**levels < reach:
        levels += 1
    d = R.placed(rows, keys, order, "__p", None, one_task).withColumn("__up", up.cast("double")).withColumn("__down", down.cast("double"))
    d = T.attach(d, d.groupBy(*keys).agg(F.max("__p").alias("last_place")), keys)
    end = F.least(F.col("__p") + reach, F.col("last_place"))
    if segment is not None:
        d = T.attach(d, d.groupBy(*keys, segment).agg(F.max("__p").alias("__ends")), [*keys, segment])
        end = F.least(end, F.col("__ends"))
    d = d.withColumn("__end", end)
    nodes = _nodes(d, keys, levels, carried)

    def look(d: DataFrame, level: int, node: Column, wanted: Column, after: Column | None) -> DataFrame:
        """Adds __k, the first fitting kid of a node and its id; rows that want none meet no node."""
        d = T.attach(d.withColumn("__node", F.when(wanted, node).otherwise(-1 - F.col("__p"))), nodes[level], [*keys, "__node"])
        top = F.shiftright("__end", BITS * level)

        def fits(x):
            test = _meets(x) & (F.shiftleft("__node", BITS) + x["at"] <= top)
            return test if after is None else test & (x["at"] > after)

        kid = F.get(F.filter("__kids", fits), F.lit(0))
        return d.withColumn("__k", F.when(wanted, kid)).withColumn("__kid", F.when(wanted, F.shiftleft("__node", BITS) + F.col("__k.at"))).drop("__kids", "__node")

    place = lambda level: F.shiftright("__p", BITS * level)
    searching = F.col("__end") > F.col("__p")
    kind = d.select(*carried, F.col("high"), F.col("low")).schema
    empty = F.lit(None).cast("struct<at:bigint,high:{high},low:{low}{rest}>".format(high=kind["high"].dataType.simpleString(), low=kind["low"].dataType.simpleString(), rest="".join(f",`{c}`:{kind[c].dataType.simpleString()}" for c in carried)))
    d = d.withColumn("__row", empty).withColumn("__row_at", F.lit(None).cast("long"))
    # at level k > 0 a found kid is a node of the level below; __t<k> holds it until the row is found
    for level in range(levels):
        done = F.col("__row_at").isNotNull()
        for j in range(1, level):
            done = done | F.col(f"__t{j}").isNotNull()
        d = look(d, level, place(level + 1), searching & ~done, place(level).bitwiseAND(F.lit(FAN - 1)))
        d = d.withColumn("__row", F.coalesce("__row", "__k")).withColumn("__row_at", F.coalesce("__row_at", "__kid")) if level == 0 else d.withColumn(f"__t{level}", F.col("__kid"))
        d = d.drop("__k", "__kid")
    top = levels - 1
    done = F.col("__row_at").isNotNull()
    for j in range(1, levels):
        done = done | F.col(f"__t{j}").isNotNull()
    d = look(d, top, place(top + 1) + 1, searching & ~done & (F.shiftright("__end", BITS * (top + 1)) > place(top + 1)), None)
    d = d.withColumn("__row", F.coalesce("__row", "__k")).withColumn("__row_at", F.coalesce("__row_at", "__kid")) if top == 0 else d.withColumn(f"__t{top}", F.coalesce(f"__t{top}", "__kid"))
    d = d.drop("__k", "__kid")
    for level in range(top - 1, -1, -1):
        d = look(d, level, F.col(f"__t{level + 1}"), F.col(f"__t{level + 1}").isNotNull(), None)
        if level == 0:
            d = d.withColumn("__row", F.coalesce("__row", "__k")).withColumn("__row_at", F.coalesce("__row_at", "__kid"))
        else:
            d = d.withColumn(f"__t{level}", F.coalesce(f"__t{level}", "__kid"))
        d = d.drop("__k", "__kid")
    steps = (F.col("__row_at") - F.col("__p")).cast("long")
    hit = F.when(F.col("__row_at").isNotNull(), F.struct(F.col("__row.high").alias("high"), F.col("__row.low").alias("low"), *[F.col(f"__row.{c}").alias(c) for c in carried], steps.alias("steps")))
    return d.select(*rows.columns, hit.alias(name), F.col("__p").alias("place"), "last_place", F.col("__end").alias("end_place"))
