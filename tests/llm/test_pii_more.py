"""Families, account numbers, and what the scratch folder holds afterwards."""

import re

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def folder(monkeypatch, tmp_path):
    from barloom.llm import common

    monkeypatch.setattr(common, "scratch_root", lambda _: f"file://{tmp_path}/ck")
    return tmp_path / "ck"


def held(spark, folder):
    """All values in the tables that are left."""
    found = []
    for path in folder.glob("*"):
        found += [str(v) for r in spark.read.parquet(f"file://{path}").collect() for v in r]
    return " ".join(found)


def test_family_names_and_account_numbers(spark, folder):
    from barloom.llm.pii import replace_entities

    text = "Mr John Smith met Mrs Smith and Mrs Anna Smith. Pay to DE89370400440532013000 or GB82 WEST 1234 5698 7654 32, not DE00370400440532013000."
    new = replace_entities(spark.createDataFrame([(1, text)], "doc_id int, text string"), "k").first().text
    he, she, full = re.search(r"Mr \S+ (\S+) met Mrs (\S+) and Mrs \S+ (\S+?)\.", new).groups()
    assert he == she == full != "Smith"
    accounts = re.search(r"to (\S+) or (GB[0-9A-Z ]+), not (DE\d+)", new).groups()
    sound = [int("".join(str(int(c, 36)) for c in (a.replace(" ", "")[4:] + a[:4]))) % 97 == 1 for a in accounts]
    assert sound[:2] == [True, True] and [len(a) for a in accounts] == [22, 27, 22] and accounts[0] != "DE89370400440532013000"
    left = held(spark, folder)
    assert not any(x in left for x in ("John", "Smith", "DE89", "WEST"))


def test_nothing_real_is_left_in_the_scratch_folder(spark, folder, monkeypatch):
    from barloom.llm import pii

    monkeypatch.setattr(pii, "REDRAWS", 1)
    mails = [f"{c}@corp.example.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    frame = spark.createDataFrame([(k, f"at {e} end") for k, e in enumerate(mails)], "doc_id long, text string")
    got = pii.replace_entities(frame, "k").collect()
    assert len({r.text for r in got}) == 26 and not {r.text[3:-4] for r in got} & set(mails)
    assert "example" not in held(spark, folder)
    monkeypatch.setattr(pii, "MOST_DRAWS", 0)
    with pytest.raises(RuntimeError):
        pii.replace_entities(frame, "k")
    assert "example" not in held(spark, folder)


def test_replacement_equals_one_by_one(spark):
    """Every text of the smallest table with its entities replaced by hand, each by the form that is its own everywhere."""
    from barloom.llm import pii

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r for r in pii.replace_entities(docs, "key").collect()}
    each = docs.select("doc_id", "text", pii.find_entities(F.col("text")).alias("found")).collect()
    entities = spark.createDataFrame(sorted({(e.kind, e.canon) for r in each for e in r.found}), "kind string, canon string")
    attempts = pii.collisions(entities, "key")
    formed = entities.join(attempts, ["kind", "canon"], "left").na.fill(0, ["attempt"]).withColumn("form", pii.surrogate_form(F.col("kind"), F.col("canon"), "key", F.col("attempt")))
    forms = {(r.kind, r.canon): r.form for r in formed.collect()}
    plain = {k: v for k, v in forms.items() if k[0] not in ("male", "female")}
    assert len({(k[0], v) for k, v in plain.items()}) == len(plain) and not {(k[0], v) for k, v in plain.items()} & set(plain)
    ways = spark.createDataFrame(sorted({(e.kind, e.canon, e.entity) for r in each for e in r.found}), "kind string, canon string, entity string")
    laid = formed.join(ways, ["kind", "canon"]).select("kind", "entity", pii.written(F.col("kind"), F.col("entity"), F.col("canon"), F.col("form")).alias("out"))
    written = {(r.kind, r.entity): r.out for r in laid.collect()}
    replaced = 0
    for r in each:
        out, at = "", 0
        for e in r.found:
            place = r.text.index(e.entity, at)
            out += r.text[at:place] + written[e.kind, e.entity]
            at = place + len(e.entity)
            replaced += 1
        assert new[r.doc_id].text == (None if r.text is None else out + r.text[at:]) and new[r.doc_id].n_entities == len(r.found)
    assert replaced > 20
