"""Queries of the operators on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import contamination, mixing, sentences
from tramline.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix that meets every target that can be met, to the operator's tolerance."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets")).rows


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What p7_mix reaches."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets")).shares


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached with a budget of nine tenths of the archive's tokens, for which the targets must give way to the limits."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"), budget_share=0.9).shares


def p7_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by token shares that are tempered to the entropy of the targets."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"), entropy_of_targets=True).shares


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_found, p7_mix, p7_shares, p7_tempered, p7_entropy, p8_found)}
#: None of these is an SQL expression: tests/llm holds them against brute force and round trips.
ORACLES: dict[str, str] = {}
