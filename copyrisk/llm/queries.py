"""The queries of this subpackage: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boosting, chat_format, decontaminate, filter_audit, html_text, isolation, near_dup, packing, pii, sharding, spelling, suffix_dedup, url_filter
from .oracle import oracle_sql

__all__ = ["oracle_sql", "queries"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1_decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2_sharding(_table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.op4_quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op9_url_filter(_table(spark, sf_dir, "pages"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op11_chat_format(_table(spark, sf_dir, "conversations"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op13_filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": _op1,
        "op2_sharding": _op2,
        "op3_packing": _op3,
        "op4_quality_rules": _op4,
        "op5_suffix_array_dedup": _op5,
        "op6_minhash_near_dedup": _op6,
        "op7_html_extraction": _op7,
        "op8_quality_classifier": _op8,
        "op9_url_filter": _op9,
        "op10_personal_data": _op10,
        "op11_chat_format": _op11,
        "op12_spelling_variants": _op12,
        "op13_filter_audit": _op13,
    }
