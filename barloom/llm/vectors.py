"""Vectors in Arrow batches, and merging of a job's partial states in a tree."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

#: Components that a task holds as doubles at a time.
SLICE = 1 << 20
#: Partial states that one task merges.
FAN = 8
#: Largest whole number a component may become, so that sums of a slice fit into 64 bits.
LARGEST = 1 << 42


def finite_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) of the vectors that are not null or empty and whose entries are all finite, in slices.

    Vectors of different lengths in one batch raise.
    """
    for at, length in _slices(column):
        part = column.slice(at, length)
        size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        there = np.flatnonzero(size)
        if not len(there):
            continue
        if len(np.unique(size[there])) > 1:
            raise ValueError("vectors of different lengths")
        flat = pc.list_flatten(part).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(there), -1)
        good = np.isfinite(flat).all(1)
        yield at + there[good], flat[good]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    widest = pc.max(pc.list_value_length(column)).as_py() or 1
    step = max(1, SLICE // widest)
    return ((at, min(step, len(column) - at)) for at in range(0, len(column), step))


def whole(matrix: np.ndarray, scale: int, offset: int = 0) -> np.ndarray:
    """floor(scale * c) + offset as 64-bit numbers."""
    x = np.floor(matrix * scale) + offset
    if x.size and np.abs(x).max() >= LARGEST:
        raise OverflowError("a component is too large")
    return x.astype(np.int64)


def merged(states: DataFrame, merge: Callable, name: str):
    """One state from rows (part, state), pickled, or None; FAN at a time, so no task reads more than FAN states.

    The partitions' states are written to the scratch folder first, so a lost executor costs no second pass over the rows.
    """
    scratch = Scratch(states.sparkSession)
    states = scratch.save(states, name)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        whole_state = pickle.loads(rows["state"].iloc[0])
        for other in rows["state"].iloc[1:]:
            whole_state = merge(whole_state, pickle.loads(other))
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN], "state": [pickle.dumps(whole_state)]})

    last = states.agg(F.max("part")).first()[0]
    if last is None:
        scratch.drop(name)
        return None
    while last > 0:
        states = states.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(join, "part long, state binary")
        last //= FAN
    found = pickle.loads(states.first()["state"])
    scratch.drop(name)
    return found
