"""Long timelines: places, running values and row windows without one task for a whole series.

A timeline is cut into chunks of time, so that a row knows its chunk by
arithmetic.  What lies before a chunk (a number of rows, a sum, the last value
of a market) is found by a prefix scan over the chunks' totals in a tree of
fixed fan: each window of the scan holds at most FAN rows.  Row windows then
take blocks of rows by place, each with a halo of the rows around it that the
windows reach; the halo is a number of rows, however far apart they are.

Every function gives the values that one window over the whole series gives.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the tree's fan and its levels: chunk numbers within 2 ** 36, half of them before 1970.
FAN_BITS, LEVELS = 12, 3
DAY = 86_400
#: Rows of a block of row windows.
BLOCK_ROWS = 16_384
#: A table whose sources are together smaller than this, by Spark's statistics, has no series too long for a task.
ONE_TASK_BYTES = 64 << 20

BLOCK, IN_HALO = "__block", "__in_halo"


def fits_one_task(df: DataFrame, limit: int | None = None) -> bool:
    """Whether all that a table is made of is small, by the statistics of its plan's sources; no job runs.

    Then plain windows do; beyond it the chunked forms give the same values.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())) <= (ONE_TASK_BYTES if limit is None else limit)


def chunk_number(df: DataFrame, ts: str, seconds: int = DAY) -> Column:
    """Number of a time's chunk, from 0 on; a null time has chunk 0.  Times that are numbers are seconds."""
    kind = df.schema[ts].dataType.typeName()
    at = F.unix_micros(ts) / 1_000_000 if kind == "timestamp" else F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 if kind in ("date", "timestamp_ntz") else F.col(ts)
    return F.coalesce(F.floor(at / seconds) + (1 << (FAN_BITS * LEVELS - 1)), F.lit(0)).cast("long")


def _same(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [a[p].eqNullSafe(b[q]) for p, q in pairs])


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join in which null keys meet."""
    named = small.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    return df.join(named, _same(df, named, [(k, f"__r{i}") for i, k in enumerate(keys)]), "left").drop(*[f"__r{i}" for i in range(len(keys))])


def before_chunks(totals: DataFrame, keys: Sequence[str], chunk: str, sums: Sequence[str] = (), lasts: Sequence[str] = ()) -> DataFrame:
    """(keys, chunk, before_c ...) of chunk totals: sums over, and last values of, the earlier chunks of a key.

    An exclusive prefix scan: inside a node of FAN chunks, inside a node of FAN
    such nodes, and at the root; a chunk joins what lies before it at each level.
    """
    level = totals.select(*keys, F.col(chunk).alias("__0"), *sums, *lasts)
    found = None
    for k in range(LEVELS):
        own, up = f"__{k}", f"__{k + 1}"
        level = level.withColumn(up, F.shiftright(own, FAN_BITS))
        earlier = Window.partitionBy(*keys, up).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
        here = level.select(*keys, own, up, *[F.sum(c).over(earlier).alias(f"__{k}{c}") for c in sums], *[F.last(c, ignorenulls=True).over(earlier).alias(f"__{k}{c}") for c in lasts])
        found = here if found is None else attach(found, here, [*keys, own])
        last = lambda c, own=own: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(own))).alias(c)
        totalled = [*[F.sum(c).alias(c) for c in sums], *map(last, lasts)]
        level = level.groupBy(*keys, up).agg(*totalled)
    total = lambda c: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"__{k}{c}"), F.lit(0)) for k in range(LEVELS)])
    latest = lambda c: F.coalesce(*[F.col(f"__{k}{c}") for k in range(LEVELS)])
    return found.select(*keys, F.col("__0").alias(chunk), *[total(c).alias(f"before_{c}") for c in sums], *[latest(c).alias(f"before_{c}") for c in lasts])


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place", seconds: int = DAY) -> DataFrame:
    """Places from 0 in the order of a key, whose first column is a time: rows of a chunk are counted, not the series."""
    d = df.withColumn("__chunk", chunk_number(df, order[0], seconds))
    counts = d.groupBy(*keys, "__chunk").agg(F.count("*").alias("n"))
    d = d.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)) - 1)
    d = attach(d, before_chunks(counts, keys, "__chunk", sums=["n"]), [*keys, "__chunk"])
    return d.withColumn(name, (F.col("before_n") + F.col("__at")).cast("long")).drop("__chunk", "__at", "before_n")


def row_blocks(df: DataFrame, place: str, before: int, after: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Rows dealt to blocks of ``size`` places, each with the ``before`` and ``after`` rows around it (IN_HALO).

    Windows that reach so many rows back and ahead, partitioned by key and BLOCK, are whole for rows outside the halo.
    """
    number = lambda at: F.floor(at / size).cast("long")
    first, last = F.greatest(number(F.col(place) - after), F.lit(0)), number(F.col(place) + before)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(IN_HALO, F.col(BLOCK) != number(F.col(place)))


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], build: Callable[[DataFrame, list[str]], DataFrame], before: int, after: int = 0, size: int = BLOCK_ROWS, seconds: int = DAY) -> DataFrame:
    """build(frame, keys), whose row windows are partitioned by the given keys, over blocks of rows with their halo."""
    d = row_blocks(placed(df, keys, order, "__place", seconds), "__place", before, after, max(size, before, after))
    return build(d, [*keys, BLOCK]).filter(~F.col(IN_HALO)).drop(BLOCK, IN_HALO, "__place")


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, seconds: int = DAY) -> DataFrame:
    """The last value of a key before each row, gaps skipped, however far back."""
    d = df.withColumn("__chunk", chunk_number(df, order[0], seconds)).withColumn("__v", F.when(F.col(value).isNotNull(), F.struct(value)))
    at = F.when(F.col("__v").isNotNull(), F.struct(*order))
    ends = d.groupBy(*keys, "__chunk").agg(F.max_by("__v", at).alias("v"))
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = attach(d.withColumn("__own", F.last("__v", ignorenulls=True).over(w)), before_chunks(ends, keys, "__chunk", lasts=["v"]), [*keys, "__chunk"])
    return d.withColumn(name, F.coalesce("__own", "before_v")[value]).drop("__chunk", "__v", "__own", "before_v")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, seconds: int = DAY) -> DataFrame:
    """Sum of a key's values up to and with each row."""
    d = df.withColumn("__chunk", chunk_number(df, order[0], seconds))
    ends = d.groupBy(*keys, "__chunk").agg(F.sum(value).alias("s"))
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = attach(d.withColumn("__own", F.sum(value).over(w)), before_chunks(ends, keys, "__chunk", sums=["s"]), [*keys, "__chunk"])
    return d.withColumn(name, F.coalesce("__own", F.lit(0)) + F.col("before_s")).drop("__chunk", "__own", "before_s")


def as_of_all(rows: DataFrame, ts: str, named: dict[str, Column], value: str, seconds: int = DAY) -> DataFrame:
    """At each time of the rows the last value of every name up to it, rows of that time included.

    ``named`` maps an output column to the test of its rows.  Chunks find the
    last value of every name on their own; what earlier chunks leave over is
    carried to those that have none.  Of rows of one name and time the largest
    value counts.
    """
    d = rows.withColumn("__chunk", chunk_number(rows, ts, seconds))
    own = lambda test: F.when(test, F.struct(F.col(ts).alias("at"), F.col(value).alias("v")))
    times = d.groupBy("__chunk", ts).agg(*[F.max(own(test)).alias(m) for m, test in named.items()])
    ends = times.groupBy("__chunk").agg(*[F.max(m).alias(m) for m in named])
    w = Window.partitionBy("__chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    inside = times.select("__chunk", ts, *[F.last(m, ignorenulls=True).over(w).alias(m) for m in named])
    met = attach(inside, before_chunks(ends, [], "__chunk", lasts=list(named)), ["__chunk"])
    return met.select(ts, *[F.coalesce(F.col(m), F.col(f"before_{m}"))["v"].alias(m) for m in named])
