"""Every query of the general data problems on empty tables, and on tables with null rows, repeated rows and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sonarmill.plans import data_problems

FOLDER = "/root/testdata/sf0.001"
TABLES = ("combined_manifest", "train_segments", "train_feature_manifest", "train_shard_manifest", "stored_files", "background_annotations", "background_manifest_summary", "uavirbase_labels")
#: Names that the operators use inside.
CLASHES = ("key_value", "n_rows", "file", "slot", "record", "node", "parent", "label_", "ordinal", "since", "until", "row_key", "k0", "at", "source_", "path", "twice", "group", "vertex", "component", "side")


def write(spark, home, change, tables=TABLES):
    for name in tables:
        change(spark.read.parquet(f"{FOLDER}/{name}.parquet")).write.parquet(f"{home}/{name}.parquet")
    return str(home)


def with_odd_rows(df):
    nulls = df.limit(2).select(*[F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes])
    blanks = df.limit(1).select(*[F.lit("  ").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
    out = df.unionByName(nulls).unionByName(blanks)
    return out.unionByName(df).withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), lambda df: df.where("false"))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), with_odd_rows)


@pytest.mark.parametrize("name", data_problems.QUERIES)
def test_empty_tables_give_empty_results(spark, empty, name):
    assert data_problems.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", data_problems.QUERIES)
def test_odd_rows_are_no_error(spark, odd, name):
    df = data_problems.QUERIES[name](spark, odd)
    assert df.columns == data_problems.QUERIES[name](spark, FOLDER).columns and df.count() > 0
    if name in ("p1_found", "p4_found"):  # repeated rows and rows of nulls add nothing to these
        own = lambda d: {tuple(r) for r in d.where("kind <> 'repeated_file'" if name == "p4_found" else "true").collect()}
        assert own(df) == own(data_problems.QUERIES[name](spark, FOLDER))
