"""Tables of manifests: explicit schemas, checked reads, and sinks whose output appears only when it is complete."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.operators.manifests import require_columns

CANONICAL = "split string, dataset string, relative_path string, file_name string, binary_label int, label_origin string, source_category string, source_fold string, recording_group_id string, size_bytes bigint, sha256 string"
SEGMENTS = "split string, segment_id string, processed_relative_path string, source_dataset string, source_relative_path string, source_sha256 string, recording_group_id string, binary_label int, source_category string, source_fold string, segment_index int, start_sample bigint, end_sample bigint, start_seconds double, end_seconds double, source_duration_seconds double, is_padded boolean, sample_rate int, segment_samples int"
SHARDS = "split string, segment_id string, binary_label int, source_sha256 string, recording_group_id string, source_dataset string, source_relative_path string, shard_path string, shard_index int"
PREDICTIONS = "segment_id string, true_label int, drone_probability double, background_probability double, sample_loss double"
HISTORY = "epoch int, learning_rate double, train_loss double, train_accuracy double, train_precision double, train_recall double, train_f1 double, validation_loss double, validation_accuracy double, validation_precision double, validation_recall double, validation_f1 double, validation_threshold double"
SCHEMAS = {"source": CANONICAL, "segment": SEGMENTS, "shard": SHARDS, "predictions": PREDICTIONS, "history": HISTORY}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header. With a schema a value that doesn't fit fails the read; without, all columns are strings.

    Blank values are null.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    if schema is None:
        df = reader.csv(path)
    else:
        known = {x.split()[0] for x in schema.split(", ")}
        head = reader.csv(path).columns
        if missing := sorted(known - set(head)):
            raise ValueError(f"missing columns: {', '.join(missing)}")
        order = {x.split()[0]: x for x in schema.split(", ")}
        df = reader.schema(", ".join(order.get(c, f"`{c}` string") for c in head)).option("mode", "FAILFAST").csv(path)
    return require_columns(df, required)


def read_manifest(spark: SparkSession, path: str, kind: str, split: str | None = None) -> DataFrame:
    """A manifest of a known kind that isn't empty, with labels 0 or 1, a group for every row and, if named, one split."""
    df = read_csv(spark, path, SCHEMAS[kind])
    bad = F.count_if(~F.coalesce(F.col("binary_label").isin(0, 1), F.lit(False)))
    nameless = F.count_if(F.coalesce(F.trim("recording_group_id"), F.lit("")) == "")
    other = F.count_if(~F.coalesce(F.col("split") == split, F.lit(False))) if split else F.lit(0)
    n, labels, groups, splits = df.agg(F.count("*"), bad, nameless, other).first()
    for wrong, text in ((n == 0, "is empty"), (labels, f"has {labels} labels outside of 0 and 1"), (groups, f"has {groups} rows without a recording group"), (splits, f"has {splits} rows of another split than {split}")):
        if wrong:
            raise ValueError(f"{path} {text}")
    return df


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), rows_per_file: int | None = None) -> None:
    """Parquet, visible once the job has committed."""
    writer = df.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """CSV in a fixed order of columns, for reports."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a log; what is there stays."""
    df.write.mode("append").parquet(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard_no", split: str = "split") -> None:
    """One folder for each split and shard number; its rows are brought together before the write."""
    df.repartition(split, shard).sortWithinPartitions(split, shard, "slot").write.mode("overwrite").partitionBy(split, shard).parquet(path)


def versioned_path(base: str, now: dt.datetime | None = None) -> str:
    """A new output folder for each run, so that nothing has to be cleared before a rebuild."""
    return f"{base.rstrip('/')}/run={(now or dt.datetime.now(dt.timezone.utc)):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


def package_listing(spark: SparkSession, folder: str, globs: tuple[str, ...]) -> DataFrame:
    """Files that match any of the patterns, each once, with their sizes."""
    out = None
    for glob in globs:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


MODEL = "name string, version int, epoch int, best_f1 double, threshold double, feature_version string, path string, saved_at timestamp"


def save_model_entry(spark: SparkSession, path: str, name: str, version: int, epoch: int, best_f1: float, threshold: float, weights: str, feature_version: str = "v1") -> None:
    """One row in the model registry; the weights themselves stay where they are."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    spark.createDataFrame([(name, version, epoch, best_f1, threshold, feature_version, weights, dt.datetime.now())], MODEL).write.mode("append").parquet(path)


def latest_model(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The newest entry; entries of old versions that lack a threshold get 0.5."""
    rows = spark.read.schema(MODEL).parquet(path).where(F.col("name") == name)
    return rows.orderBy(F.desc("version"), F.desc("epoch"), F.desc("saved_at")).limit(1).withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def decision_threshold(stored: float | None, override: float | None = None, default: float = 0.5) -> float:
    out = override if override is not None else stored if stored is not None else default
    if not 0 < out < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return out
