"""Hard-negative mining by a secondary sort.

Every anchor's scores are sorted as keys (anchor, descending score, kind, id)
by ``repartitionAndSortWithinPartitions``; an iterator then reads each anchor's
rows once, in order: a positive opens a window, and a negative goes to every
open window it lies in.  The iterator holds the open windows only, never an
anchor's rows.

Before the shuffle, blocks of rows meet blocks of anchors, and a block passes
on what the result can hold of it: its first positives, and of the negatives
under each of the anchor's positives the first ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, input_partitions
from barloom.llm.vectors import finite_rows, whole

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least so many hundredths of the positive.
LOW = 80
#: Rows and anchors whose scores a task holds at a time.
ROW_BLOCK = 2048
ANCHOR_BLOCK = 512

_BLOCK = "block long, ids binary, labels binary, anchors binary, x binary"
_CANDIDATE = "anchor long, anchor_id long, score long, kind int, vec_id long, row long"


def row_blocks(rows: DataFrame, size: int = ROW_BLOCK) -> DataFrame:
    """Blocks of up to ``size`` finite rows of (vec_id, label, is_anchor, vector); a row's number is block * size + place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for places, matrix in finite_rows(batch.column(3)):
                x = whole(matrix, SCALE)
                ids, labels, anchors = (batch.column(k).take(pa.array(places)).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
                for at in range(0, len(places), size):
                    own = slice(at, at + size)
                    parts = [ids[own].astype(np.int64), labels[own].astype(np.int64), anchors[own].astype(np.uint8), x[own]]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["block", "ids", "labels", "anchors", "x"])
                    number += 1

    return rows.mapInArrow(run, _BLOCK)


def _unpacked(block: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
    return ids, labels, block["block"] * size + np.arange(len(ids)), np.frombuffer(block["x"], np.int64).reshape(len(ids), -1)


def anchor_rows(blocks: DataFrame, size: int = ROW_BLOCK) -> DataFrame:
    """(anchor, anchor_id, label, x) of distinct anchors; anchor is the number of a row that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                ids, labels, rows, x = _unpacked(block, size)
                at = np.flatnonzero(np.frombuffer(block["anchors"], np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at]), pa.array(labels[at]), pa.array([x[k].tobytes() for k in at], pa.binary())], names=["anchor", "anchor_id", "label", "x"])

    found = blocks.mapInArrow(run, "anchor long, anchor_id long, label long, x binary")
    return found.groupBy("anchor_id", "label", "x").agg(F.min("anchor").alias("anchor")).select("anchor", "anchor_id", "label", "x")


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products: in doubles where these hold them exactly."""
    if a.shape[1] != x.shape[1]:
        raise ValueError("vectors of different lengths")
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * a.shape[1]
    if largest >= 1 << 62:
        raise OverflowError("a score is too large")
    return (a.astype(float) @ x.T.astype(float)).astype(np.int64) if largest < 1 << 53 else a @ x.T


def first_positives(score: np.ndarray, ids: np.ndarray, number: int = POSITIVES) -> np.ndarray:
    """Places of the first ``number`` by falling score, then id."""
    if len(score) > number:
        least = np.partition(score, len(score) - number)[len(score) - number]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:number]


def first_negatives(score: np.ndarray, ids: np.ndarray, positives: Iterable[int], number: int = NEGATIVES, low: int = LOW) -> np.ndarray:
    """Places of those that are among the first ``number`` in the window of a positive."""
    tops = sorted({p for p in positives if p >= 0})
    if not tops:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((score <= tops[-1]) & (100 * score >= low * tops[0]))
    at = at[np.lexsort((ids[at], -score[at]))]
    down = -score[at]
    chosen = []
    for p in tops:
        start = np.searchsorted(down, -p)
        own = at[start : start + number]
        chosen.append(own[100 * score[own] >= low * p])
    return np.unique(np.concatenate(chosen))


def _met(blocks: DataFrame, anchors: DataFrame, extra: list[str], pick, size: int, per_block: int) -> DataFrame:
    """Candidates that ``pick`` takes from each block of rows for each anchor.

    Blocks of rows and of anchors meet in a grid: a block of anchors is copied
    to some parts of the rows, and a block of rows to all blocks of anchors, so
    both sides are read in bounded pieces by any number of tasks.
    """
    spark = blocks.sparkSession
    number = max(1, -(-anchors.count() // per_block))
    parts = max(1, -(-4 * input_partitions(spark) // number))
    packed = anchors.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(number)).cast("int").alias("tile")).agg(F.collect_list(F.struct("anchor", "anchor_id", "label", "x", *extra)).alias("own"))
    left = packed.select("tile", "own", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("tile"))
    meeting = right.join(left, ["tile", "part"]).select("block", "ids", "labels", "x", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = {k: batch.column(k)[at].as_py() for k in ("block", "ids", "labels", "x")}
                ids, labels, rows, x = _unpacked(block, size)
                own = batch.column("own")[at].as_py()
                scores = _scores(np.stack([np.frombuffer(a["x"], np.int64) for a in own]), x)
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for a, score in zip(own, scores, strict=True):
                    kind, places = pick(a, score, ids, labels, rows)
                    for column, value in zip(out, (np.full(len(places), a["anchor"]), np.full(len(places), a["anchor_id"]), score[places], ids[places], rows[places]), strict=True):
                        column.append(value)
                anchor, anchor_id, score, vec_id, row = (pa.array(np.concatenate(c).astype(np.int64)) for c in out)
                yield pa.RecordBatch.from_arrays([anchor, anchor_id, score, pa.array(np.full(len(anchor), kind, np.int32)), vec_id, row], names=["anchor", "anchor_id", "score", "kind", "vec_id", "row"])

    return meeting.mapInArrow(run, _CANDIDATE)


def windows(keys: Iterable[tuple], negatives: int = NEGATIVES, low: int = LOW) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from sorted ((anchor, -score, kind, vec_id, row), anchor_id).

    Kind 0 is a positive, 1 a negative, so at equal scores positives come first.
    """
    anchor, opened = None, []
    for (own, minus, kind, vec_id, _), anchor_id in keys:
        if own != anchor:
            anchor, opened = own, []
        if kind == 0:
            opened.append([vec_id, -minus, 0])
            continue
        opened = [w for w in opened if w[2] < negatives and 100 * -minus >= low * w[1]]
        for w in opened:
            w[2] += 1
            yield anchor_id, w[0], w[2], vec_id, w[1], -minus


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, size: int = ROW_BLOCK, per_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Hard negatives of (vec_id, label, embedding): per anchor and positive, the first negatives in the positive's window.

    Scores are inner products of floor(SCALE * component).  Positives are the
    anchor's first other rows of its label by falling score, then id; the
    window holds rows of other labels that score at most the positive and at
    least ``low`` hundredths of it (none under a negative score).  Rows with a
    null id, label or vector, or with an empty vector, a null or a non-finite
    component take no part.  Equal anchor rows count as one anchor, whose
    copies are other rows; positives that repeat an id are listed as often as
    they stand among the first.  Vectors of different lengths raise.  Without
    anchors, or in an empty table, the result is empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.filter("vec_id is not null and label is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), "embedding")
    blocks = scratch.save(row_blocks(rows, size), "vector-blocks")
    anchors = scratch.save(anchor_rows(blocks, size), "anchors")

    def same(a: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray):
        at = np.flatnonzero((labels == a["label"]) & (numbers != a["anchor"]))
        return 0, at[first_positives(score[at], ids[at], positives)]

    def other(a: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray):
        at = np.flatnonzero(labels != a["label"])
        return 1, at[first_negatives(score[at], ids[at], a["tops"], negatives, low)]

    near = _met(blocks, anchors, [], same, size, per_block)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    first = scratch.save(near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives).drop("r"), "positives")
    tops = first.groupBy("anchor").agg(F.collect_set("score").alias("tops"))
    candidates = first.unionAll(_met(blocks, anchors.join(tops, "anchor"), ["tops"], other, size, per_block))

    keyed = candidates.rdd.map(lambda r: ((r.anchor, -r.score, r.kind, r.vec_id, r.row), r.anchor_id))
    ordered = keyed.repartitionAndSortWithinPartitions(input_partitions(spark), partitionFunc=lambda key: hash(key[0]))
    found = ordered.mapPartitions(lambda keys: windows(keys, negatives, low))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(found, schema, verifySchema=False)
