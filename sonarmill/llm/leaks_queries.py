"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarmill.llm import leaks
from sonarmill.session import read_table

EDITS = 1


def _met(spark: SparkSession, d: str) -> DataFrame:
    """Every place where a document's words are within one word edit, be it a word replaced, inserted or dropped, of an item's passage."""
    return leaks.found_passages(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), edits=EDITS, free_end=True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 12 words in a row of an item: the meetings without an edit, which happen in every table."""
    return _met(spark, d).where("edits = 0").select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages within one word edit, and how many of each item's words they cover."""
    passages = _met(spark, d).groupBy("doc_id", "item_id", "item_start").agg(F.min("edits").alias("edits"))
    following = F.lead("item_start").over(Window.partitionBy("doc_id", "item_id").orderBy("item_start"))  # no more rows than an item has words
    covered = passages.withColumn("words", F.least(F.lit(leaks.WINDOW), F.coalesce(following - F.col("item_start"), F.lit(leaks.WINDOW))))
    out = covered.groupBy("doc_id", "item_id").agg(F.sum("words").alias("item_words"), F.min("edits").alias("least_edits"))
    items = read_table(spark, d, "eval_items").select("item_id", "test_set")
    return out.join(items, "item_id", "left").select("doc_id", "item_id", "test_set", "item_words", "least_edits")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
ORACLE: dict[str, str] = {}
