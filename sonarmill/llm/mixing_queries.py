"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonarmill.llm import mixing
from sonarmill.session import read_table


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sizes(read_table(spark, d, "documents"))
    return sized, mixing.supply(sized, read_table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_sized(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, supplied = _sized(spark, d)
    return mixing.shares(mixing.mix(sized, supplied), supplied)


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
