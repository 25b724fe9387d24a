"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroid_clustering import cluster_sql, cluster_vectors
from .chat_format import format_preferences, format_sql
from .common import table
from .decontamination import decontaminate
from .html_extraction import html_extraction
from .line_dedup import dedup_lines
from .mixing import mix, mix_sql
from .near_dedup import near_duplicates
from .pii import personal_data
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .substring_dedup import dedup_substrings, substring_sql
from .token_alignment import align_tokenizers
from .toxicity import toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("_lines_gone", "n_lines_dropped")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(table(spark, sf_dir, "conversations"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_line_dedup, op3_html_extraction, op4_mixing, op5_chat_format, op6_pii]
    found += [op7_decontamination, op8_near_dedup, op9_quality_classifier, op10_toxicity, op11_token_alignment]
    found += [op12_centroid_clustering, op13_substring_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mix_sql(),
        "op5_chat_format": format_sql(),
        "op12_centroid_clustering": cluster_sql(),
        "op13_substring_dedup": substring_sql(),
    }
