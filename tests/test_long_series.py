"""Chunked timelines, keyed permutations and distributed ranks beside one window over everything."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import permutation as P
from barloom.functions import ranks as R
from barloom.functions import timeline as T
from barloom.operators import diagnostics as D
from barloom.operators import quotes as Q
from barloom.operators import statistics as S


def same(a, b):
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    plain = lambda df: sorted((tuple(str(round(v, 9)) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=key)
    assert plain(a) == plain(b)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ticks(spark):
    """Two keys and a null one over 90 days with hours of ties, days without a row, gaps, and times before 1970."""
    rng = random.Random(3)
    rows = []
    for key in ("a", "b", None):
        for n in range(300):
            day = rng.choice([0, 1, 2, 5, 6, 40, 41, 89])
            second = day * 86400 + rng.randrange(24) * 3600 - 3 * 86400
            rows.append((key, second, n, None if rng.random() < 0.2 else float(rng.randrange(7))))
    return spark.createDataFrame(rows, "key string, second long, n long, v double").withColumn("ts", F.timestamp_seconds("second")).repartition(5).cache()


@pytest.mark.parametrize("seconds", [3600, 86400, 10 * 86400])
def test_places_and_running_values_equal_one_window(ticks, seconds):
    w = Window.partitionBy("key").orderBy("ts", "n")
    got = T.placed(ticks, ["key"], ["ts", "n"], seconds=seconds)
    same(got, ticks.withColumn("place", (F.row_number().over(w) - 1).cast("long")))
    got = T.last_before(ticks, ["key"], ["ts", "n"], "v", "prior", seconds)
    same(got, ticks.withColumn("prior", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    one = ticks.withColumn("one", F.lit(1))
    got = T.running_total(one, ["key"], ["ts", "n"], "one", "total", seconds)
    same(got, one.withColumn("total", F.sum("one").over(w.rowsBetween(Window.unboundedPreceding, 0))))


@pytest.mark.parametrize(("size", "before", "after"), [(7, 3, 0), (7, 0, 4), (10, 9, 9), (1, 2, 5), (10**6, 3, 3)])
def test_row_windows_in_blocks_equal_one_window(ticks, size, before, after):
    def build(d, keys):
        w = Window.partitionBy(*keys).orderBy("ts", "n").rowsBetween(-before, after)
        return d.withColumn("c", F.count("*").over(w)).withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("n").over(w))

    same(T.in_blocks(ticks, ["key"], ["ts", "n"], build, before, after, size), build(ticks, ["key"]))


MARKETS = {"A": "a", "B": "b", "C": "never"}


@pytest.mark.parametrize("seconds", [3600, 86400, 1000 * 86400])
def test_as_of_alignment_carries_values_over_empty_chunks(ticks, seconds):
    rows = ticks.select(F.col("key").alias("series_id"), F.col("ts").alias("available_ts"), F.col("v").alias("r")).filter("series_id is not null")
    # of equal times the largest value counts, so the window is held against one row a time
    one = rows.groupBy("series_id", "available_ts").agg(F.max("r").alias("r"))
    w = Window.orderBy("available_ts").rangeBetween(Window.unboundedPreceding, 0)
    want = one.select("available_ts", *[F.last(F.when(F.col("series_id") == s, F.struct("r")), ignorenulls=True).over(w)["r"].alias(m) for m, s in MARKETS.items()]).distinct()
    got = Q.as_of_alignment(rows, MARKETS, chunk_seconds=seconds)
    same(got, want)
    assert "SinglePartition" not in plan(got)


@pytest.mark.parametrize("size", [4, 25, 10**6])
def test_pairs_and_lags_in_blocks_equal_one_window(ticks, size):
    d = ticks.groupBy("ts").agg(F.max(F.when(F.col("key") == "a", F.col("v"))).alias("A"), F.min(F.when(F.col("key") == "b", F.col("v") + F.col("n") % 5)).alias("B"))
    d = d.withColumn("event_ts", F.col("ts")).withColumnRenamed("ts", "available_ts")
    w = Window.orderBy("available_ts").rowsBetween(-4, 0)
    y, x = F.col("A"), F.col("B")
    full = (F.count(F.lit(1)).over(w) == 5) & (F.sum((x.isNull() | y.isNull()).cast("int")).over(w) == 0)
    flat_x, flat_y = F.max(x).over(w) == F.min(x).over(w), F.max(y).over(w) == F.min(y).over(w)
    cov, vx, vy = F.covar_samp(y, x).over(w), F.var_samp(x).over(w), F.var_samp(y).over(w)
    want = d.withColumn("beta_residual", F.when(full & ~flat_x, y - F.try_divide(cov, vx) * x)).withColumn("correlation", F.when(full & ~flat_x & ~flat_y, F.try_divide(cov, F.sqrt(vx * vy))))
    got = Q.rolling_pair(d, "A", "B", 5, size=size, chunk_seconds=7200)
    same(got, want)
    assert "SinglePartition" not in plan(got)

    one = Window.orderBy("event_ts")
    lagged = d.select(F.lag("A", 3).over(one).alias("x"), F.col("B").alias("y"), (F.col("event_ts").cast("double") - F.lag(F.col("event_ts").cast("double"), 3).over(one)).alias("since")).filter("x is not null and y is not null")
    want = lagged.agg(F.count("*").alias("n"), F.avg("since").alias("mean_lag_seconds"), D.pearson("x", "y").alias("correlation"))
    got = D.lead_lag(d, ["A", "B"], [1, 3], size=size, chunk_seconds=7200)
    same(got.filter("leader = 'A' and lag = 3").select("n", "mean_lag_seconds", "correlation"), want)
    assert "SinglePartition" not in plan(got)


# --- permutations


@pytest.fixture(scope="module")
def permutations(spark):
    """Every place of groups of 1 to 500 rows under three seeds, and of one larger group."""
    sizes = spark.createDataFrame([(n, s) for n in [*range(1, 501), 4099] for s in (1, 2, 30)], "n long, seed long")
    d = P.with_keys(sizes, ["n"]).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    d = P.moved_places(P.permuted(d, "place", "n", "there"), "place", "n", "other")
    return P.permuted(d, "there", "n", "back", inverse=True).select("n", "seed", "place", "there", "back", "other").toPandas()


def test_permutations_are_bijective_and_moves_have_no_fixed_point(permutations):
    for (n, _), g in permutations.groupby(["n", "seed"]):
        assert sorted(g["there"]) == sorted(g["other"]) == list(range(n))
        assert (g["back"] == g["place"]).all()
        assert n == 1 or (g["other"] != g["place"]).all()


def test_permutations_look_drawn(permutations):
    large = permutations[permutations["n"] == 4099]
    seeds = [g.sort_values("place")["other"].to_numpy() for _, g in large.groupby("seed")]
    for a, b in itertools.combinations(seeds, 2):
        assert (a == b).sum() < 12  # about one place in 4099 agrees
    for a in seeds:
        assert abs(((a[1:] - a[:-1]) % 4099 == 1).sum()) < 12
        places = range(4099)
        mean = 2049.0
        corr = sum((x - mean) * (y - mean) for x, y in zip(places, a, strict=True)) / sum((x - mean) ** 2 for x in places)
        assert abs(corr) < 0.08
    small = {tuple(g.sort_values("place")["other"]) for _, g in permutations[permutations["n"] == 5].groupby("seed")}
    assert len(small) > 1


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(g, d, t, float(100 * d + t)) for g, days in (("a", 9), ("b", 1), (None, 4)) for d in range(days) for t in range(3 + (d % 3 == 2))]
    return spark.createDataFrame(rows, "g string, day int, t long, y double").withColumn("at", F.col("day") * 10 + F.col("t"))


def groups(df, *keys):
    found = {}
    for r in df.collect():
        found.setdefault(tuple(r[k] for k in keys), []).append(r)
    return found


def test_label_shuffles_move_every_label_once(panel):
    got = S.label_shuffle(panel, ["g"], ["at"], 3, 4)
    assert sorted({r.seed for r in got.collect()}) == [3, 4, 5, 6]
    for rows in groups(got, "g", "seed").values():
        assert sorted(r.y for r in rows) == sorted(r.y_shuffled for r in rows)
        assert all(r.y != r.y_shuffled for r in rows)
    # one numbering and joins, however many seeds: nothing is sorted by seed
    assert "md5" not in "".join(x for x in plan(got).splitlines() if "Window" in x or "Sort" in x)


@pytest.mark.parametrize("draw", [S.block_shuffle, S.block_bootstrap])
def test_block_surrogates_move_whole_blocks_of_one_length(panel, draw):
    got = draw(panel, ["g"], "day", "t", 7, 6)
    assert got.count() == 6 * panel.count()
    for (g, day, _), rows in groups(got, "g", "day", "seed").items():
        rows.sort(key=lambda r: r.t)
        source = {int(r.y_shuffled // 100) for r in rows}
        assert len(source) == 1 and [r.y_shuffled % 100 for r in rows] == [r.t for r in rows]
        source = source.pop()
        assert (source % 3 == 2) == (day % 3 == 2) and all(r.moved == (source != day) for r in rows)
        if draw is S.block_shuffle:
            alone = sum(d % 3 == 2 for d in range({"a": 9, "b": 1, None: 4}[g])) == 1 if day % 3 == 2 else g == "b"
            assert alone or source != day
    if draw is S.block_shuffle:
        for rows in groups(got, "g", "seed").values():
            assert sorted(r.y for r in rows) == sorted(r.y_shuffled for r in rows)


def test_fixed_blocks_move_whole_with_a_short_last_one(panel):
    got = S.fixed_block_permutation(panel, ["g"], ["at"], 4, 1, 8)
    orders = set()
    for (g, _), rows in groups(got, "g", "seed").items():
        rows.sort(key=lambda r: r.at)
        before = [r.y for r in rows]
        after = [r.y_shuffled for r in rows]
        assert sorted(before) == sorted(after)
        blocks = [tuple(before[k : k + 4]) for k in range(0, len(before), 4)]
        left, order = after, []
        while left:
            block = next(b for b in blocks if tuple(left[: len(b)]) == b)
            order.append(blocks.index(block))
            left = left[len(block) :]
        assert sorted(order) == list(range(len(blocks)))
        if g == "a":
            orders.add(tuple(order))
    assert len(orders) > 4


# --- ranks


@pytest.fixture(scope="module")
def valued(spark):
    """Groups of unlike sizes and scales; one value holds half of the rows, and there are nulls and NaN."""
    rng = random.Random(9)
    rows = []
    for g, number, scale in (("a", 700, 1e-4), ("b", 60, 1e3), ("c", 1, 1.0), (None, 90, 1.0)):
        for n in range(number):
            v = 0.0 if rng.random() < 0.5 else round(rng.gauss(0, 1), 1) * scale
            rows.append((g, None if rng.random() < 0.05 else float("nan") if rng.random() < 0.02 else v, rng.randrange(40), n))
    return spark.createDataFrame(rows, "g string, v double, t long, n long").repartition(6).cache()


@pytest.mark.parametrize("stretches", [1, 5, 64])
def test_distributed_ranks_equal_the_window(valued, stretches):
    w = Window.partitionBy("g")
    want = valued.withColumn("r", F.rank().over(w.orderBy("v")) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2)
    same(R.average_rank(valued, ["g"], "v", "r", one_task=False, stretches=stretches), want)
    want = valued.withColumn("place", (F.row_number().over(w.orderBy("v", "t", "n")) - 1).cast("long")).withColumn("size", F.count("*").over(w))
    same(R.placed(valued, ["g"], ["v", "t", "n"], "place", "size", one_task=False, stretches=stretches, cuts=stretches), want)


def test_ranked_diagnostics_are_the_same_in_both_forms(valued):
    obs = valued.select("g", F.col("v").alias("f"), (F.col("t") - F.col("n") % 3).cast("double").alias("y"), "n").filter("f is not null and not isnan(f)")
    same(D.ranked(obs, ["g"], one_task=False), D.ranked(obs, ["g"], one_task=True))
    same(D.with_bucket(obs, ["g"], "f", 5, ["y", "n"], one_task=False), D.with_bucket(obs, ["g"], "f", 5, ["y", "n"], one_task=True))


def test_one_group_of_many_rows_is_ranked_in_many_tasks(spark):
    d = spark.range(300_000, numPartitions=4).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.xxhash64("id") % 100_000 / 7).alias("v"))
    d = R.average_rank(d, ["g"], "v", "r", one_task=False)
    largest = R.stretch(F.col("v"), R.bounds(d.drop("r"), "v", R.STRETCHES))
    sizes = d.withColumn("s", largest).filter("s % 2 = 0").groupBy("s").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 6_000 and sizes[1] > 60
    low = d.filter("v = 0.0").agg(F.min("r"), F.max("r"), F.count("*")).first()
    below = d.filter("v < 0.0").count()
    assert low[0] == low[1] == below + (low[2] + 1) / 2
    assert spark.range(1).select(F.lit(1)).count() == 1 and T.fits_one_task(spark.range(10))
