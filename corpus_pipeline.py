"""The corpus pipeline: documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, mixing, pii, quality, simhash
from kinweave.llm.common import bounded, fresh, shared_dir, table, written
from kinweave.llm.queries import tokenizer_path

#: No SQL has the classifier, the fingerprints or the tokenizer; tests hold near_dedup, mixing and bpe of run() against plain versions, quality against its operator, pii by what it must keep.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies: a Jaccard of 0.8 or more of their five-word shingles."""
    return simhash.one_of_each(docs, words=5, similarity=0.8).select(*docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities replaced by surrogates; n_chars is the new text's."""
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return pii.replace(docs).withColumn("n_chars", n).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    row, times = fresh(docs, "_row"), fresh(docs, "_times")
    columns = docs.columns
    docs = docs.withColumn(row, F.monotonically_increasing_id())
    taken = written(mixing.mix(docs, keep=(row,)).where("times > 0").select(row, F.col("times").cast("int").alias(times)), "taken")
    if bounded(taken, 16 << 20, 16):
        taken = F.broadcast(taken)
    return docs.join(taken, row).select(*columns, F.explode(F.array_repeat(F.lit(1), F.col(times))).alias(times)).select(*columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the ids of every document of the mix."""
    return bpe.encode(docs, tokenizer_path(), with_ids=True).drop("decoded")


STAGES = [("quality", keep_good), ("near_dedup", drop_copies), ("pii", replace_private), ("mixing", mix_sources), ("bpe", to_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
