"""The registered queries of this package, each an operator over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, html_template, mixing, pii, quality, search, simhash, sketch, urls, warc
from kinweave.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.hamming_classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("times")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, good: a page's URL has the number of the document it shows; that document's quality label is its outcome."""
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/?#]*/[a-z]+/([0-9]+)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", number.alias("_number")).where("_number <> ''")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("_number"), F.col("quality").alias("good"))
    return pages.join(labels, "_number").select("page_id", "good")


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict", "bound")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_search": op5_search,
    "op6_warc": op6_warc,
    "op7_html": op7_html,
    "op8_mixing": op8_mixing,
    "op9_fingerprints": op9_fingerprints,
    "op10_url_reputation": op10_url_reputation,
}
ORACLE_SQL = {"op5_search": search.ORACLE, "op6_warc": warc.ORACLE, "op8_mixing": mixing.ORACLE, "op10_url_reputation": urls.ORACLE}
