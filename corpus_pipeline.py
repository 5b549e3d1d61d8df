"""Corpus pipeline over ``documents``: each stage is written and read again as the next one's docs.

Every stage but the last returns the columns of ``documents``; what a stage
rejects is gone for those after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tareline.llm import bpe, decontaminate, jaccard, quality, toxicity
from tareline.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; learned from the labels of ``docs``."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is 0.7 or more; learned from the labels of ``docs``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, the one of the smallest id."""
    return jaccard.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and the text that the ids decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_and_decode(docs, path, keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("bpe encoding", bpe_encoding),
]
#: Two stages score with trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
