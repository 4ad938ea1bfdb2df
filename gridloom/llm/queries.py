"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, line_rules, lm_trie, mixing, near_dedup, oracle, pii, quality_crf, sharding, toxicity_mil
from ._store import documents, table, tidied


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: mixing.query(documents(spark, sf_dir)))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: html_extract.query(table(spark, sf_dir, "pages")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: sharding.query(documents(spark, sf_dir)))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: decontaminate.query(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: quality_crf.query(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: line_rules.query(documents(spark, sf_dir)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: pii.query(documents(spark, sf_dir)))


def op8_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: toxicity_mil.query(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: near_dedup.query(documents(spark, sf_dir)))


def op10_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(spark, lambda: lm_trie.query(documents(spark, sf_dir)), ["trie"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_html_extract": op2_html_extract,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_crf": op5_quality_crf,
    "op6_line_rules": op6_line_rules,
    "op7_pii": op7_pii,
    "op8_toxicity_mil": op8_toxicity_mil,
    "op9_near_dedup": op9_near_dedup,
    "op10_lm_trie": op10_lm_trie,
}

ORACLE: dict[str, str] = {
    "op3_sharding": oracle.SHARDING,
    "op4_decontaminate": oracle.DECONTAMINATE,
    "op1_mixing": oracle.MIXING,
    "op6_line_rules": oracle.LINE_RULES,
    "op9_near_dedup": oracle.NEAR_DEDUP,
}
