"""Every query of the subpackage on empty tables, and on tables with null rows, repeated rows and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sonarmill.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("combined_manifest", "train_shard_manifest", "documents", "eval_items", "mix_targets")
CLASHES = ("sides", "hi", "lo", "recording", "index", "train", "words", "vertex", "component", "label", "key", "order", "position", "pass", "n_tokens", "before", "doc_lang", "first_word", "item", "digest", "group", "spelling")


def write(spark, home, change):
    for name in TABLES:
        change(spark.read.parquet(f"{FOLDER}/{name}.parquet")).write.parquet(f"{home}/{name}.parquet")
    return str(home)


def with_odd_rows(df):
    nulls = df.limit(2).select(*[F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes])
    blanks = df.limit(1).select(*[F.lit("  ").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
    return df.unionByName(nulls).unionByName(blanks).withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), lambda df: df.where("false"))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), with_odd_rows)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", queries.QUERIES)
def test_odd_rows_are_no_error(spark, odd, name):
    df = queries.QUERIES[name](spark, odd)
    assert df.columns == queries.QUERIES[name](spark, FOLDER).columns and df.count() > 0
