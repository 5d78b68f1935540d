"""Lines of one template that stay apart: few pairs become rows, and no near pair is lost by the parity sketches."""

from itertools import combinations

from pyspark.sql import functions as F
from test_line_groups import groups, sets


def frame_of(spark, lines):
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")


def test_lines_that_stay_apart_make_few_pairs(spark, monkeypatch):
    from barloom.llm import line_dedup

    lines = groups(7, 1, 300, changed=5)
    met, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *more: (met.append(pairs.count()), verified(pairs, *more))[1])
    kept = line_dedup.components(frame_of(spark, lines)).filter("keeper").count()
    # the search in bands meets up to nine lines for each line and band; what it leaves over must not grow with all pairs
    assert kept > 250 and sum(met[1:]) <= len(lines), (kept, met)


def test_parity_sketches_lose_no_near_pair(spark):
    from barloom.llm import line_dedup

    lines = [x for changed in (1, 2, 3, 6) for x in groups(changed, 1, 20, changed=changed)] + ["tiny", "tinys", "ünïcödé " * 3]
    frame = frame_of(spark, lines)
    table = line_dedup.line_table(frame)
    keys = {r.k1: lines[r.doc_id] for r in table.select("k1", "doc_id").collect()}
    own = table.select(F.col("k1").alias("a"), F.col("k1").alias("b"))
    texts = line_dedup.line_texts(own, table, frame).select("k1", F.struct("n", "q").alias("s")).localCheckpoint()
    x, y = (texts.select(F.col("k1").alias(k), F.col("s").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    got = {(r.a, r.b) for r in x.crossJoin(y).filter("a < b").filter(line_dedup._near(F.col("x"), F.col("y"), 0.8)).select("a", "b").collect()}
    like = {(a, b): len(sets(keys[a]) & sets(keys[b])) / max(1, len(sets(keys[a]) | sets(keys[b]))) for a, b in combinations(sorted(keys), 2)}
    assert {p for p, j in like.items() if j >= 0.8} <= got
    assert len([p for p in got if like[p] < 0.6]) <= len(lines) and len(got) < len(like) / 2
