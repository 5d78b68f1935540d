"""Whitening, the Jaccard join and hard negatives beside brute force, with nulls, empties, ties and repeats."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, score int, x int, anchor int, name string, block int"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls in every column, empty vectors, non-finite entries, repeats, ties, and columns whose names operators use themselves."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in np.round(rng.normal(size=6), 1)], int(k % 3), 0, 0, 0, "n", 0) for k in range(400)]
    rows += [rows[100], rows[200], rows[7], rows[7]]
    rows += [(500, None, 1), (600, [], 1), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (701, [float("nan")] * 6, 1), (702, [float("inf")] * 6, 1), (800, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    rows = [r + (None,) * (8 - len(r)) for r in rows]
    return spark.createDataFrame(rows, VECTORS).repartition(7)


def finite(frame):
    return [r for r in frame.collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]


# --- op11


def covariance(vectors):
    x = np.floor(1024 * np.asarray(vectors, dtype=float)) + 100000
    n, s = len(x), [int(t) for t in x.sum(0)]
    away = x - np.asarray([t / n for t in s])
    return x.astype(np.int64), n, s, away, away.T @ away / n


@pytest.mark.parametrize("case", ["odd", "table"])
def test_whitening_is_that_of_the_whole_covariance(spark, odd_vectors, case):
    from barloom.llm.whitening import whitened_components

    frame = odd_vectors if case == "odd" else spark.read.parquet(f"{SF}/embeddings.parquet").repartition(9)
    there = finite(frame)
    x, n, s, away, v = covariance([r.embedding for r in there])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitened_components(frame).collect()
    assert len(got) == len(there) * min(8, x.shape[1])
    deviation = {}
    for r, row in zip(there, x, strict=True):
        deviation.setdefault(r.vec_id, []).append(sum((n * int(e) - t) ** 2 for e, t in zip(row, s, strict=True)))
    projected = {}
    for r, row in zip(there, away, strict=True):
        projected.setdefault(r.vec_id, row @ vectors / np.sqrt(values))
    signs = {}
    for r in got:
        k = r.component - 1
        assert r.n == n and r.deviation in deviation[r.vec_id]
        assert abs(r.explained * np.trace(v) / values[k] - 1) < 1e-9 and r.identity_error < 1e-9
        want = projected[r.vec_id][k]
        if abs(want) > 1e-3:
            signs.setdefault(k, np.sign(want * r.whitened))
        assert abs(r.whitened - signs.get(k, 1) * want) < 1e-6


def test_rank_one_update_deflates_and_stays_orthogonal():
    from barloom.llm.whitening import rank_one

    rng = np.random.default_rng(1)
    for trial in range(60):
        m = int(rng.integers(1, 12))
        values = np.sort(rng.choice([0, 0, 1, 1, 1 + 1e-14, 2, 1e-9, 1e6], m) * 1.0)
        q, _ = np.linalg.qr(rng.normal(size=(m, m)))
        v = q @ np.where(rng.random(m) < 0.4, 0, rng.normal(size=m)) * (1e-7 if trial % 5 == 0 else 1)
        a = q @ np.diag(values) @ q.T + np.outer(v, v)
        new, vectors = rank_one(values, q, v)
        size = max(1.0, np.abs(a).max())
        assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-12
        assert np.abs(vectors @ np.diag(new) @ vectors.T - a).max() < 1e-12 * size
        assert (np.diff(new) >= 0).all() and np.abs(new - np.linalg.eigvalsh(a)).max() < 1e-12 * size


def test_combined_spectra_are_the_spectrum_of_all_rows():
    from barloom.llm.whitening import Spectrum

    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(90, 7)) @ np.diag([100, 50, 50, 1, 0, 3, 3]) + 5)
    sides = []
    for part in (rows[:3], rows[3:40], rows[40:41], rows[41:]):
        own = Spectrum.empty(7)
        for r in part:
            own.add(r)
        sides.append(own)
    whole = sides[0].join(sides[1]).join(sides[2].join(sides[3]))
    want = np.linalg.eigvalsh((rows - rows.mean(0)).T @ (rows - rows.mean(0)))
    assert whole.n == 90 and np.allclose(whole.mean, rows.mean(0)) and np.abs(whole.values - want).max() < 1e-9 * want[-1]


def test_whitening_without_rows_or_variance(spark):
    from barloom.llm.whitening import whitened_components

    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitened_components(frame).count() == 0
    assert whitened_components(spark.createDataFrame([(1, None), (2, [None]), (3, [])], frame.schema)).count() == 0
    same = whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], frame.schema)).collect()
    assert len(same) == 6 and all(r.deviation == 0 and r.n == 3 and r.whitened is None and r.explained is None and r.identity_error is None for r in same)
    flat = whitened_components(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], frame.schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in flat)
    large = whitened_components(spark.createDataFrame([(1, [30000.0]), (2, [-30000.0])], frame.schema)).collect()
    assert [r.deviation for r in large] == [(2 * 1024 * 30000) ** 2] * 2


# --- op12


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    return {" ".join(words)} if 0 < len(words) < 4 else {" ".join(words[k : k + 4]) for k in range(len(words) - 3)}


def linked(x, y):
    return bool(x) and 100 * len(x & y) >= 85 * len(x | y)


def closure(sets):
    """Smallest id reachable, by all pairs of (id, set); a null id names nothing."""
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a][1], sets[b][1]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, own) in enumerate(sets):
        if own and i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) if own else i for k, (i, own) in enumerate(sets)]


def edits(rng, words, number):
    words = list(words)
    for _ in range(number):
        words[int(rng.integers(len(words)))] = f"new{rng.integers(10**6)}"
    return words


def families(rng, sizes, length, most):
    found = []
    for size in sizes:
        base = [f"w{rng.integers(10**5)}" for _ in range(length)]
        found += [" ".join(edits(rng, base, int(rng.integers(0, most + 1)))) for _ in range(size)]
    return found


def test_signatures_are_shared_by_all_linked_sets():
    from barloom.llm.jaccard_join import PERCENT, set_signatures

    rng = np.random.default_rng(3)
    for _ in range(1500):
        size = int(rng.choice([1, 2, 5, 6, 7, 8, 10, 13, 20, 40, 70, 120, 300, 1000]))
        x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        out = int(rng.integers(0, 1 + size // 6))
        more = int(rng.integers(0, 1 + size // 6))
        y = np.unique(np.concatenate([x[out:], rng.integers(0, 2**64, more, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(x) and len(y) and 100 * both >= PERCENT * (len(x) + len(y) - both) and len(x) + len(y) > 2 * both:
            assert len(np.intersect1d(set_signatures(x), set_signatures(y))), (len(x), len(y), both)


@pytest.mark.parametrize("block", [512, 8])
def test_components_equal_brute_force(spark, block):
    from barloom.llm.jaccard_join import jaccard_components

    rng = np.random.default_rng(4)
    passage = " ".join(f"shared{k}" for k in range(60))
    texts = families(rng, [60, 30], 120, 5) + families(rng, [20, 3, 2], 30, 1) + families(rng, [8], 12, 1)
    texts += [f"{passage} {' '.join(f'own{k}x{j}' for j in range(25))}" for k in range(40)]
    texts += [" ".join(f"chain{j}" for j in range(3 * k, 3 * k + 60)) for k in range(25)]
    rows = [(k, t, 0) for k, t in enumerate(texts)]
    rows += [(900, None, 0), (901, "", 0), (902, " \t\n", 0), (903, "one two three", 0), (904, "One  two\nthree", 0), (905, "one two", 0), (None, texts[0], 0), (None, "no id at all here", 0), (7, texts[100], 0), (7, texts[7], 0)]
    rows += [(1000 + k, "the very same text again and again", 0) for k in range(30)] + [(950, "word " * 20000, 0), (951, "Émile école ÀÉ ß " * 3, 0), (952, "émile école àé ß " * 3, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, name int").withColumns({c: F.lit(1) for c in ("sig", "root", "n_shingles", "component_id", "node")}).repartition(5)
    got = sorted(map(tuple, jaccard_components(frame, block=block).collect()), key=str)
    sets = [(i, shingles(t)) for i, t, _ in rows]
    want = sorted(((i, len(s), c) for (i, s), c in zip(sets, closure(sets), strict=True)), key=str)
    assert got == want


def test_components_of_the_table_equal_sql(spark):
    import duckdb

    from barloom.llm.oracles import OP12
    from barloom.llm.queries import op12_jaccard_join

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = op12_jaccard_join(spark, SF)
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "n_shingles:bigint", "component_id:bigint"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(OP12).fetchall())


def test_jaccard_join_of_an_empty_table(spark):
    from barloom.llm.jaccard_join import jaccard_components

    assert jaccard_components(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    named = jaccard_components(spark.createDataFrame([("b", "x y z w"), ("a", "X y z w")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in named) == [("a", "a"), ("b", "a")]


def test_stream_of_repeated_signatures_over_batch_edges():
    import pyarrow as pa

    from barloom.llm.jaccard_join import repeated

    rows = [(1, 5), (2, 5), (2, 5), (2, 6), (3, 1), (3, 1), (3, 1), (4, 1), (4, 2), (4, 2), (4, 3), (5, 9)]
    want = [(2, 5), (2, 6), (4, 1), (4, 2), (4, 3)]
    for step in range(1, 13):
        batches = [pa.RecordBatch.from_pylist([{"sig": s, "name": n} for s, n in rows[k : k + step]]) for k in range(0, len(rows), step)]
        assert [(r["sig"], r["name"]) for b in repeated(iter(batches)) for r in b.to_pylist()] == want


# --- op13


def mined(rows, is_anchor, positives=5, negatives=5, low=80):
    """All pairs; rows are (vec_id, label, vector), equal anchors count once."""
    x = [tuple(math.floor(256 * c) for c in r[2]) for r in rows]
    found, done = [], set()
    for k, (anchor, label, _) in enumerate(rows):
        if not is_anchor(anchor) or (anchor, label, x[k]) in done:
            continue
        done.add((anchor, label, x[k]))
        scored = [(-sum(p * q for p, q in zip(x[k], y, strict=True)), rows[j][0], rows[j][1]) for j, y in enumerate(x) if j != k]
        scored.sort()
        for minus, vec_id, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and low * -minus <= 100 * -s[0] <= 100 * -minus]
            found += [(anchor, vec_id, rank, s[1], -minus, -s[0]) for rank, s in enumerate(inside[:negatives], 1)]
    return sorted(found)


@pytest.mark.parametrize(("size", "per_block"), [(2048, 512), (16, 3)])
def test_hard_negatives_equal_all_pairs(spark, odd_vectors, size, per_block):
    from barloom.llm.hard_negatives import mine

    rows = [(r.vec_id, r.label, r.embedding) for r in finite(odd_vectors) if r.vec_id is not None and r.label is not None]
    got = mine(odd_vectors, F.col("vec_id") % 20 == 0, size=size, per_block=per_block)
    assert [f.simpleString() for f in got.schema] == ["anchor_id:bigint", "positive_id:bigint", "rank:int", "negative_id:bigint", "positive_score:bigint", "negative_score:bigint"]
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 20 == 0)


def test_hard_negatives_with_ties_few_rows_and_none(spark):
    from barloom.llm.hard_negatives import mine

    schema = "vec_id long, label int, embedding array<float>"
    tied = [(k, k % 2, [1.0, 0.5]) for k in range(30)] + [(100, 0, [-1.0, -0.5])]
    got = sorted(map(tuple, mine(spark.createDataFrame(tied, schema), F.col("vec_id") % 10 == 0, size=4).collect()))
    assert got == mined(tied, lambda i: i % 10 == 0)
    assert not any(r[0] == 100 for r in got)
    assert mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).collect() == []
    assert mine(spark.createDataFrame(tied, schema), F.col("vec_id") < 0).collect() == []
    assert mine(spark.createDataFrame(tied[:1], schema), F.lit(True)).collect() == []


def test_streaming_windows_hold_only_what_is_open():
    from barloom.llm.hard_negatives import windows

    def keys():
        yield (1, -100, 0, 7, 0), 1
        for k in range(3):
            yield (1, -100, 1, k, 0), 1
        yield (1, -90, 0, 8, 0), 1
        yield from (((1, -80, 1, k, 0), 1) for k in range(10, 16))
        yield (1, -75, 1, 20, 0), 1
        yield (1, -71, 1, 21, 0), 1
        yield (2, -5, 1, 3, 0), 2

    got = list(windows(keys()))
    assert [g[3] for g in got if g[1] == 7] == [0, 1, 2, 10, 11]
    assert [g[3] for g in got if g[1] == 8] == [10, 11, 12, 13, 14]
    assert all(g[0] == 1 for g in got)
