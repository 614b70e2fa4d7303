"""The stages of the corpus pipeline, from raw documents to packed sequences. Each reads what the one before wrote.

All but the last return the columns of their documents, whatever else these are called; clashing names are carried in one
struct. Null texts count as empty and rows without doc_id are judged by their texts. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, near_dedup, packing, quality, shared, substring_dedup


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact or near copies stays."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that occur anywhere else go from every text."""
    return substring_dedup.remove(docs, window=35)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token pieces packed into sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", sequences),
]

ORACLE_SQL = None  # a fitted classifier, signatures and a genetic algorithm are not SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has read or written on its way goes as soon as its own result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done: list[str] = []
    for name, stage in STAGES:
        with shared.scope() as made:
            kept = shared.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        shared.discard(spark, [*done, *made[:-1]])
        docs, done = kept, made[-1:]
    return docs
