"""Keyed permutations of the places 0..n-1 of a group, by arithmetic on the place.

A shuffle of a group for many seeds is then an equi-join on (group, place); no
rows are sorted for a seed.  The places below a * b (a the whole root of n, b
the whole part of n / a) are pairs (l, r), on which two Feistel steps act: l
moves by a keyed function of r, then r by one of l.  Then all places are
rotated by a key.  Three such passes reach every place, so none must be drawn
again, and each step can be undone.  A permutation without fixed points is
"undo, then move on by a keyed number that is not 0 modulo n, then do".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
PASSES = 3
#: Keys of a permutation: three a pass, and one for the move.
KEYS = 3 * PASSES + 1


def key_name(i: int) -> str:
    return f"__k{i}"


def _digest(seed: str, group: Sequence[str], part: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(seed).cast("string"), *[F.col(g).cast("string") for g in group], F.lit(str(part))))


def with_keys(groups: DataFrame, group: Sequence[str], seed: str = "seed") -> DataFrame:
    """The keys of each (group, seed): 28-bit numbers from md5 of the seed and the group."""
    number = lambda i: F.conv(F.substring(_digest(seed, group, i // 4), 1 + 7 * (i % 4), 7), 16, 10).cast("long")
    return groups.select("*", *[number(i).alias(key_name(i)) for i in range(KEYS)])


def _moved(key: int, value: Column) -> Column:
    """A cubic of value + key modulo PRIME."""
    k = F.col(key_name(key))
    x = (value + k) % PRIME
    return (x * x % PRIME * x + k) % PRIME


def permuted(df: DataFrame, place: str, n: str, name: str, inverse: bool = False) -> DataFrame:
    """``name``: where the keyed permutation (columns key_name(0..)) takes ``place``, or what it takes there."""
    steps: list[tuple[str, Column]] = [("__a", F.floor(F.sqrt(F.col(n).cast("double"))).cast("long")), ("__b", F.floor(F.col(n) / F.col("__a")).cast("long")), ("__x", F.col(place).cast("long"))]
    a, b, rows, now = F.col("__a"), F.col("__b"), F.col(n), "__x"

    def then(kind: str, value: Column) -> Column:
        steps.append((f"{kind}{len(steps)}", value))
        return F.col(steps[-1][0])

    for k in range(PASSES)[:: -1 if inverse else 1]:
        x, key = F.col(now), F.col(key_name(3 * k + 2))
        if inverse:
            x = then("__t", (x + F.lit(PRIME) * rows - key) % rows)
            left = then("__l", F.floor(x / b).cast("long"))
            right = then("__r", F.pmod(x % b - _moved(3 * k + 1, left), b))
            then("__x", F.when(x < a * b, F.pmod(left - _moved(3 * k, right), a) * b + right).otherwise(x))
        else:
            left = then("__l", (F.floor(x / b).cast("long") + _moved(3 * k, x % b)) % a)
            then("__x", (F.when(x < a * b, left * b + (x % b + _moved(3 * k + 1, left)) % b).otherwise(x) + key) % rows)
        now = steps[-1][0]
    # one list of columns, each of which may use those before it
    return df.select("*", *[value.alias(step) for step, value in steps]).select(*df.columns, F.col(now).alias(name))


def moved_places(df: DataFrame, place: str, n: str, name: str) -> DataFrame:
    """``name``: another place of the group for every place, each once; in a group of one its own."""
    step = 1 + F.col(key_name(3 * PASSES)) % F.greatest(F.col(n) - 1, F.lit(1))
    d = permuted(df, place, n, "__q").withColumn("__q", (F.col("__q") + step) % F.col(n))
    return permuted(d, "__q", n, name, inverse=True).drop("__q")


def picked_places(df: DataFrame, place: str, n: str, name: str) -> DataFrame:
    """``name``: a keyed draw of a place for every place, with replacement."""
    return df.withColumn(name, _moved(0, F.col(place).cast("long")) % F.col(n))
