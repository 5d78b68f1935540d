"""Similarity join of documents by the Jaccard similarity of their word shingles, by PartEnum signatures.

Set sizes are cut into bands whose largest and smallest size are within the
threshold, so linked sets lie in one band or in two neighbours.  Instance ``i``
joins band ``i`` with itself and with band ``i + 1``; two of its sets that link
differ in at most ``k`` shingles.  The domain of shingles (their 64-bit hashes)
is cut into groups, each of a few parts.  With one group for each two of the
``k + 1`` differences, some group holds at most one difference, so all of its
parts but one are the same in both sets: a signature is a group with one part
left out, and linked sets share one.

A signature of fewer than two shingles says little and many sets share it.
``spare`` groups more than needed give that many more groups with one
difference at most, so a set drops its thin signatures unless more than
``spare`` of its groups have one; such a set keeps them under keys that only
sets of its kind have.  No link is lost.

Sets that share a signature meet first with the one of them that meets most
others, in linear work; then those that are not yet in one component meet in
blocks.  A parity sketch (one bit a cell, flipped by each shingle) differs in
no more bits than the sets in shingles, which drops most pairs and no link; the
rest is verified on all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import Scratch, small_enough
from barloom.llm.components import connected_components

WIDTH = 4
#: Least similarity, in hundredths.
PERCENT = 85
#: Signatures of fewer shingles are thin.
THIN = 2
SKETCH_BITS = 1024
#: Sets of one signature that a task compares with each other, or with as many others.
BLOCK = 512
#: Largest table of ids that is broadcast to find the texts to verify, and what an id takes of it.
ASKED_BYTES, ID_BYTES = 32 << 20, 16
#: Names of sets that a task remembers, so as to sign equal texts of its share once.
REMEMBERED = 1 << 20

_SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on the input (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending 64-bit hashes of a text's distinct shingles; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.asarray([xxh64_intdigest(b" ".join(words))], np.uint64)
    parts = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, parts), np.uint64, len(words) - width + 1))


def set_name(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, signed."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), 1)).view(np.int64))


def sketch(shingles: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    return np.packbits((np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differ_at_most(total, percent: int = PERCENT):
    """Most shingles that two linked sets with ``total`` shingles together have apart."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4)
def band_starts(percent: int = PERCENT, top: int = 1 << 40) -> np.ndarray:
    """The smallest size of each band; the largest is the last that can link to it."""
    starts = [1]
    while starts[-1] < top:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.asarray(starts)


@lru_cache(maxsize=512)
def layout(instance: int, percent: int = PERCENT) -> tuple[int, int, int] | None:
    """(groups, parts of a group, spare groups) of an instance; None where linked sets are equal."""
    largest = int(band_starts(percent)[instance + 1]) - 1
    k = int(differ_at_most(largest + largest * 100 // percent, percent))
    if k <= 0:
        return None
    needed = (k + 2) // 2
    # few differences: more parts, so that small sets leave less out
    parts, spare = (6, 0) if k < 8 else (3, 1 + needed // 24)
    return needed + spare, parts, spare


@lru_cache(maxsize=512)
def _cell_keys(instance: int, groups: int, parts: int) -> np.ndarray:
    cells = np.arange(1, groups * parts + 1, dtype=np.uint64)
    return mix(cells * _SEED + mix(np.asarray([instance + 1], np.uint64))).reshape(groups, parts)


def signatures(shingles: np.ndarray, instance: int, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set in one instance."""
    plan = layout(instance, percent)
    if plan is None:
        return np.zeros(0, np.uint64)
    groups, parts, spare = plan
    cells = groups * parts
    # parts are ranges of the hash domain, so each is a run of the ascending hashes
    cell = ((shingles >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    at = np.searchsorted(cell, np.arange(cells + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles))])
    part = (sums[at[1:]] - sums[at[:-1]]).reshape(groups, parts)
    number = np.diff(at).reshape(groups, parts)
    thin = number.sum(1, keepdims=True) - number < THIN
    keys = mix((part.sum(1, keepdims=True) - part) ^ _cell_keys(instance, groups, parts))
    if np.count_nonzero(thin.any(1)) > spare:
        return np.where(thin, mix(keys + _SEED), keys).ravel()
    return keys[~thin]


def set_signatures(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A set's signatures in its band's instance and in that of the band below."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(band_starts(percent), len(shingles), side="right")) - 1
    return np.concatenate([signatures(shingles, i, percent) for i in (band, band - 1) if i >= 0])


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, name, sketch) of (doc_id, text); name and sketch are null for an empty set."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("n_shingles", "long").add("name", "long").add("sketch", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                size, name, bits = [], [], []
                for text in part.column(1):
                    own = shingle_set(text.as_py(), width)
                    size.append(len(own))
                    name.append(set_name(own) if len(own) else None)
                    bits.append(sketch(own) if len(own) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "name", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def signature_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(sig, name) for each signature of each text's set; a task signs equal sets once while it remembers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, names = [], []
                for text in batch.slice(at, 256).column(0):
                    own = shingle_set(text.as_py(), width)
                    if not len(own) or (name := set_name(own)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    keys.append(set_signatures(own, percent))
                    names.append(np.full(len(keys[-1]), name, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names))], names=["sig", "name"])

    return docs.select("text").mapInArrow(run, "sig long, name long")


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, name) in order, each distinct one whose signature another name has, in a stream."""
    last, passed = np.zeros((2, 0), np.int64), False
    for batch in batches:
        rows = np.hstack([last, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])])
        if not rows.shape[1]:
            continue
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        rows = rows[:, fresh]
        same = rows[0, 1:] == rows[0, :-1]
        shared = np.zeros(rows.shape[1], bool)
        shared[1:] |= same
        shared[:-1] |= same
        now = shared.copy()
        now[0] &= not passed
        passed = bool(shared[-1]) or (passed and rows.shape[1] == 1)
        last = rows[:, -1:]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0, now]), pa.array(rows[1, now])], names=["sig", "name"])


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, name) of signatures that several sets have: one shuffle, then a stream over sorted rows."""
    return rows.repartition("sig").sortWithinPartitions("sig", "name").mapInArrow(repeated, "sig long, name long")


def _near(n_a: np.ndarray, s_a: np.ndarray, n_b: np.ndarray, s_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes and sketches allow a link, over broadcast arrays."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    apart = np.bitwise_count(s_a ^ s_b).sum(-1, dtype=np.int64)
    return (100 * low >= percent * high) & (apart <= differ_at_most(n_a + n_b, percent))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def hub_pairs(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of each signature's hub, the set that meets most others, with the rest; linear in the members.

    members: (sig, name, n_shingles, sketch, met).
    """
    hubs = members.groupBy("sig").agg(F.max(F.struct("met", "name")).alias("h")).select("sig", F.col("h.name").alias("hub"))
    pairs = members.select("sig", "name").join(hubs, "sig").filter("name <> hub").select(F.least("hub", "name").alias("a"), F.greatest("hub", "name").alias("b")).distinct()
    return _tested(pairs, members.select("name", "n_shingles", "sketch").distinct(), percent)


def _tested(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    a, b = (info.select(F.col("name").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
                yield batch.select([0, 1]).filter(pa.array(_near(n_a, _sketches(batch.column(3)), n_b, _sketches(batch.column(5)), percent)))

    sized = pairs.join(a, "a").join(b, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


def block_pairs(members: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of sets that share a signature and have different roots, if their sketches allow a link.

    members: (sig, name, n_shingles, sketch, root).  Signatures all of whose
    sets have one root are left out; the others' sets meet in blocks.
    """
    mixed = members.groupBy("sig").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sig", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    placed = members.join(mixed, "sig").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("lo"), F.greatest(o, "own").alias("hi")))
    dealt = placed.select("sig", F.explode(meets).alias("m"), F.struct("name", "n_shingles", "root", "sketch", "own").alias("v"))
    blocks = dealt.groupBy("sig", "m.lo", "m.hi").agg(F.collect_list("v").alias("v")).select("lo", "hi", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(batch.num_rows):
                v = batch.column(2)[at].values
                name, n, root, own = (v.field(k).to_numpy(zero_copy_only=False) for k in ("name", "n_shingles", "root", "own"))
                bits, lo, hi = _sketches(v.field("sketch")), batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                right = np.flatnonzero(own == hi)
                for x in np.flatnonzero(own == lo):
                    y = right[right > x] if lo == hi else right
                    y = y[root[y] != root[x]]
                    y = y[_near(n[x], bits[x], n[y], bits[y], percent)]
                    found.update((min(int(name[x]), int(o)), max(int(name[x]), int(o))) for o in name[y])
                if len(found) > 100_000 or at == batch.num_rows - 1:
                    pairs = np.asarray(sorted(found), np.int64).reshape(-1, 2)
                    found.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, scratch: Scratch, step: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of names that link, by all shingles of one text of each.

    named: (name, least), least being the id of a row that has this set.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    wanted = scratch.save(asked.join(named, "name").select("name", F.col("least").alias("at")), f"asked-{step}")
    asked, ids = wanted.select("name"), wanted.select("at").distinct()
    # few ids go to the texts; many ids and the texts meet by a shuffle
    ids = F.broadcast(ids) if small_enough(ids, ID_BYTES, ASKED_BYTES) else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("at")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [s for t in batch.slice(at, 256).column(0) if len(s := shingle_set(t.as_py(), width))]
                yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["name", "shingles"])

    found = texts.select("text").mapInArrow(sets, "name long, shingles binary").join(asked, "name", "left_semi").groupBy("name").agg(F.min("shingles").alias("shingles"))
    found = scratch.save(found, f"sets-{step}")
    scratch.drop(f"asked-{step}")
    scratch.release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[at].as_py(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = found.select(F.col("name").alias("a"), F.col("shingles").alias("x"))
    y = found.select(F.col("name").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links of at least ``percent`` hundredths.

    Null, empty and blank texts have no shingles and link with nothing: their
    component is their own id.  Texts with equal sets are one set, however
    often they repeat; rows with a null or a repeated id take part like others,
    and a component without any id has a null one.  Other columns are not read.
    An empty table gives an empty one.  Sets are named, and shingles compared,
    by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = scratch.save(digests(docs, width), "shingle-digests")
    shared = scratch.save(shared_signatures(signature_rows(docs, width, percent)), "shared-signatures")
    scratch.release()
    # signatures that the same sets share say the same
    lists = shared.groupBy("sig").agg(F.bit_xor(F.xxhash64("name")).alias("h"), F.count("*").alias("size"))
    kept = lists.groupBy("h", "size").agg(F.min("sig").alias("sig")).select("sig", "size")
    info = own.filter("name is not null").groupBy("name").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"))
    members = shared.join(kept, "sig")
    met = members.groupBy("name").agg(F.sum("size").alias("met")).join(info, "name")
    members = scratch.save(members.select("sig", "name").join(met.select("name", "n_shingles", "sketch", "met"), "name"), "members")
    named = scratch.save(info.join(members.select("name").distinct(), "name", "left_semi").select("name", "least"), "named-sets")
    scratch.drop("shared-signatures")

    first = scratch.save(hub_pairs(members, percent), "hub-pairs")
    scratch.release()
    links = scratch.save(verified(first, docs, named, scratch, "hubs", width, percent), "hub-links")
    parts = scratch.save(connected_components(links, "jaccard-hubs"), "hub-components")
    rooted = members.join(parts, members["name"] == parts["node"], "left").select("sig", "name", "n_shingles", "sketch", F.coalesce("component", "name").alias("root"))
    rest = scratch.save(block_pairs(rooted, percent, block).join(first, ["a", "b"], "left_anti"), "block-pairs")
    scratch.release()
    more = scratch.save(verified(rest, docs, named, scratch, "blocks", width, percent), "block-links")
    final = scratch.save(connected_components(links.unionAll(more), "jaccard"), "set-components")
    scratch.drop("members", "named-sets", "hub-pairs", "hub-links", "hub-components", "block-pairs", "block-links", "sets-hubs", "sets-blocks")

    least = own.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("least"))
    placed = least.join(final, least["name"] == final["node"], "left").select("name", "least", F.coalesce("component", "name").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    component = placed.join(ids, "root").select("name", "component_id")
    empty = own.filter("name is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.filter("name is not null").join(component, "name").select("doc_id", "n_shingles", "component_id").unionAll(empty)
