"""The corpus pipeline: five stages over `documents`, each written and read again as the next one's input.

All stages but the last return the columns of `documents`: documents the classifier rejects go; of equal texts the row with
the largest doc_id stays; of near copies the document with the smallest doc_id stays; sources are mixed to
their target weights by repeating or leaving out whole documents. The last returns the ids of every document
of the mix and the digest of the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursequarry.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from coursequarry.llm.queries import vocabulary
from coursequarry.sources.scratch import cut_lineage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_with_check(docs, vocabulary())


STAGES = [
    ("quality_classifier", keep_good), ("exact_dedup", drop_copies), ("jaccard_join", drop_similar),
    ("mixing", mix_sources), ("bpe", encode),
]

# The classifier and the encoder have no SQL form; tests hold each stage against a plain one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
