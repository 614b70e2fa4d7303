"""The registered queries of this folder. Each reads its whole table and applies one operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, fill_in_middle, graph_search, id_files, importance, language_id, maxent, near_dedup, packing, quality, shared, stages, substring_dedup, token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_read(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat_format.digest(_read(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"), window=35)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(_read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.digest(_read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(_read(spark, sf_dir, "documents"))


def _owned(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query; tables that it has written on its way go when its result is written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shared.finished(spark, f.__name__, lambda: f(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": stages.run} | {f.__name__: _owned(f) for f in (op1_token_counts, op2_id_files, op3_language_id, op4_chat_format, op5_substring_dedup, op6_best_fit_packing, op7_quality_classifier, op8_near_dedup, op9_decontaminate, op10_graph_search, op11_importance_resampling, op12_maxent_scores, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    made = {"pipeline": stages.ORACLE_SQL} if stages.ORACLE_SQL else {}
    return made | {"op4_chat_format": chat_format.ORACLE_SQL, "op5_substring_dedup": substring_dedup.ORACLE_SQL, "op8_near_dedup": near_dedup.ORACLE_SQL, "op9_decontaminate": decontaminate.ORACLE_SQL, "op11_importance_resampling": importance.ORACLE_SQL, "op13_fill_in_middle": fill_in_middle.ORACLE_SQL}
