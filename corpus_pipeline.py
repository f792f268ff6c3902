"""Corpus preparation: stages applied to ``documents`` one after the other.

Every stage but the last returns the columns of its input. No stage but that of near-duplicates
joins anything with the texts; they are filtered in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrylake.llm import decontaminate, langid, minhash, packing, quality
from sentrylake.llm.columns import fold_of
from sentrylake.llm.queries import tokenizer_path
from sentrylake.llm.scratch import materialise, release


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the pairwise quality ranking places below its threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.training_labels(labels))


def filter_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language stays in doubt."""
    return langid.keep_identified(docs, langid.train(docs.where(fold_of("doc_id", 4) != 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id."""
    return minhash.keep_first(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 tokens, each with the corpus' mixture of sources."""
    return packing.pack(docs, tokenizer_path())


STAGES: list = [
    ("quality", filter_quality),
    ("language", filter_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("packing", pack),
]

#: The stages learn models and count tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; each one's result is written as Parquet, read by the next and deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
