"""A training corpus from raw documents: each stage calls one operator of ``talkweave.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.decontamination import drop_contaminated
from talkweave.llm.language import drop_unknown_language
from talkweave.llm.mixing import mixed_documents
from talkweave.llm.ngram_join import drop_near_copies
from talkweave.llm.sharding import shard_by_tree
from talkweave.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return drop_unknown_language(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return drop_near_copies(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources come again in a second epoch, as far as their budget goes."""
    return mixed_documents(docs, repetition_limit=2.0)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mixture is stored."""
    return shard_by_tree(docs, shards=40)


STAGES = [
    ("language id", language_id),
    ("n-gram jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
