"""The corpus pipeline: five stages over ``documents``, each written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tightknit.llm import bpe, decontamination, jaccard_join, language_id, paragraph_dedup
from tightknit.llm.batches import crc_of_id
from tightknit.plans.stable import stable


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network knows; learned from three quarters of them."""
    net = language_id.train_on(docs, crc_of_id() % 4 != 2)
    return language_id.of_known_language(docs, net)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def without_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and passages that an earlier one has; ``n_chars`` follows the text."""
    cut = paragraph_dedup.without_repeated_text(docs)
    n_chars = F.when(F.size("removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they are decoded to: ``doc_id, n_tokens, ids, decoded``."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(docs, vocabulary).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
    return bpe.decode(ids, vocabulary)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", distinct_documents),
    ("substring_dedup", without_repeated_paragraphs),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
