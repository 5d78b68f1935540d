"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return (
        both.filter("b > a").join(least, F.col("a") == F.col("n"))
        .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, are linked to the least of those neighbours."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = down.join(least, F.col("a") == F.col("n"))
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        .filter("a <> b").distinct()
    )


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of an edge table (a, b); component is the least node reachable.

    Each round is two joins on node ids; its result is written to the shared
    scratch folder, so the lineage stays short.  The rounds end when the edges
    no longer change, after about log(nodes) rounds.  Self-loops, repeated
    edges and nulls are ignored; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    stars = scratch.save(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        mark = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen, turn = mark, turn + 1
        following = scratch.save(_small_star(_large_star(stars)), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        stars = following
