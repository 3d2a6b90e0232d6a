"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.llm import language
from sonarmill.session import read_table

#: A second language counts from so many words in a row on.
RUN = 12


def _segments(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents")
    return language.identify(documents, language.train(documents, "text", "lang"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch in one language."""
    return _segments(spark, d).where("lang IS NOT NULL").select("doc_id", "first_word", "end_word", "lang", "confidence")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language, what its label names, and whether they differ."""
    rows = _segments(spark, d).select("doc_id", F.col("doc_lang").alias("lang"), F.col("doc_confidence").alias("confidence"), "label").distinct()
    return rows.withColumn("verdict", F.when(F.col("label").isNull(), "missing").when(F.col("label") == F.col("lang"), "right").otherwise("wrong"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label is missing or wrong or that hold a second language, with each language they hold."""
    seen = _segments(spark, d).where("lang IS NOT NULL")
    second = (F.col("lang") != F.col("doc_lang")) & (F.col("end_word") - F.col("first_word") >= RUN)
    judged = seen.select("doc_id", "label", "doc_lang", F.when(second, F.col("lang")).alias("second"))
    held = judged.groupBy("doc_id").agg(F.first("label").alias("label"), F.first("doc_lang").alias("main"), F.collect_set("second").alias("others"))  # at most one entry for each known language
    cases = held.where("label IS NULL OR label <> main OR size(others) > 0")
    return cases.select("doc_id", F.explode(F.array_union(F.array("main"), "others")).alias("lang"))


QUERIES = {"p9_found": p9_found, "p9_documents": p9_documents, "p9_segments": p9_segments}
ORACLE: dict[str, str] = {}
