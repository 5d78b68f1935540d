"""The registered queries of the corpus operators: name -> f(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.llm.oracles import ORACLE_SQL  # noqa: F401


#: The registered query's key; a deployment passes its own secret to replace_entities.
PII_KEY = "barloom-registered-query"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


#: Measures of op2 in the order of its contract.
_OP2 = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *_OP2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.decontaminate import items_digest, scan_documents

    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.language_id import predict, text_crc, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(text_crc("doc_id"), F.lit(3)) == 1
    model = train(docs.filter(~held_out))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.language_id import text_crc
    from barloom.llm.quality_crf import THRESHOLD, score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(text_crc("doc_id"), F.lit(5)) == 0
    field = train(docs, labels.filter(~held_out))
    return score(docs, field).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.warc import archive_digest

    return archive_digest(table(spark, sf_dir, "pages"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.html_extract import extract_pages

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.pii import replace_entities

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, PII_KEY)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.whitening import whitened_components

    return whitened_components(table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack, op2_quality_rules, op3_decontaminate, op4_language_id, op5_simhash,
        op6_quality, op7_warc, op8_html_extract, op9_pii, op10_line_dedup, op11_whitening, op12_jaccard_join, op13_hard_negatives,
    )
}

