"""The dataset pipeline as jobs: files to manifests, splits, segments, features, shards, with a gate after every layer.

A job takes and gives DataFrames; only the layers that others read again are written. A gate raises if its layer breaks a
rule, so that nothing is built on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import dsp, parsing, signals
from sonarmill.operators import manifests, segmentation
from sonarmill.sources import adapters, audio, npz, tables


class GateError(RuntimeError):
    """A layer that breaks its rules."""


@dataclass(frozen=True)
class Options:
    seed: int = 42
    shard_size: int = 256
    rate: int = dsp.RATE
    least_seconds: float = 0.25
    windows: segmentation.Windows = segmentation.Windows()


def raw_files(spark: SparkSession, root: str, rule: adapters.Rule) -> DataFrame:
    """``relative_path, size_bytes, sha256`` of a dataset's audio files; the content is hashed where it is read."""
    home = f"{root.rstrip('/')}/{rule.directory}"
    listed = audio.audio_files(spark, home, content=True)
    relative = F.regexp_extract("path", f"^.*?/{rule.directory}/(.*)$", 1)
    return listed.select(relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def _label_texts(spark: SparkSession, root: str, rule: adapters.Rule) -> DataFrame:
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", rule.annotation_file or "label.json")
    return read.text(f"{root.rstrip('/')}/{rule.directory}", wholetext=True).select(F.regexp_extract("_metadata.file_path", f"^.*?/{rule.directory}/(.*)$", 1).alias("relative_path"), F.col("value").alias("text"))


def _annotations(spark: SparkSession, root: str, rule: adapters.Rule) -> DataFrame:
    df = tables.read_csv(spark, f"{root.rstrip('/')}/{rule.directory}/{rule.annotation_file}")
    names = {"file_name": ("filename", "slice_file_name"), "source_id": ("src_file", "fsID"), "category": ("category", "class"), "fold": ("fold",)}
    found = {k: manifests.resolve_column(df, v) for k, v in names.items()}
    if missing := sorted(k for k, v in found.items() if v is None):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(v).alias(k) for k, v in found.items()])


def dataset_rows(spark: SparkSession, root: str, registry: adapters.Registry) -> DataFrame:
    """Labelled rows of all enabled datasets that are there, both labels; rows of one label are picked by ``adapters.with_label``."""
    out = None
    for rule in registry.enabled():
        try:
            files = raw_files(spark, root, rule)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        inputs = {"json": lambda r=rule: [_label_texts(spark, root, r)], "csv": lambda r=rule: [_annotations(spark, root, r)]}.get(rule.label_source, list)()
        rows = adapters.rows_of(rule, files, *inputs)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no enabled dataset is there")
    return out


def prepared_splits(rows: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """``(canonical rows with their split, quarantined rows)``. The first row of equal contents is the first by path."""
    named = rows.withColumn("order", F.concat_ws("|", (1 - F.col("binary_label")).cast("string"), "dataset", "relative_path"))
    kept = manifests.deduplicate(named, "sha256", "binary_label", "order")
    groups = manifests.group_split(kept, "recording_group_id", "binary_label", seed=options.seed).select(F.col("group").alias("recording_group_id"), "split")
    return kept.join(groups, "recording_group_id").select("split", *adapters.MANIFEST), manifests.conflicts(named, "sha256", "binary_label", "order").drop("order")


def check_sources(canonical: DataFrame) -> None:
    """Contents once, splits disjoint in content and group, one label in a group."""
    for name, bad in (("content listed twice", manifests.duplicate_keys(canonical, "sha256")), ("content in several splits", manifests.memberships(canonical, "sha256", "split")), ("group in several splits", manifests.memberships(canonical, "recording_group_id", "split")), ("group with both labels", manifests.mixed_groups(canonical, "recording_group_id", "binary_label"))):
        if example := bad.head(1):
            raise GateError(f"{name}: {example[0].asDict()}")


def waveforms(files: DataFrame, options: Options = Options()) -> DataFrame:
    """``path, status, error, wave``: decoded, without offset, scaled; too short or broken recordings are rows with their error."""
    clean = signals.peak_normalised(signals.without_offset(F.col("wave")))
    out = audio.decoded(files, options.rate).withColumn("wave", F.when(F.col("status") == "success", clean))
    short = (F.col("status") == "success") & ~signals.long_enough(F.col("wave"), options.least_seconds, options.rate)
    return out.withColumns({"status": F.when(short, "failed").otherwise(F.col("status")), "error": F.when(short, "too short").otherwise(F.col("error")), "wave": F.when(~short, F.col("wave"))})


def segmented(recordings: DataFrame, options: Options = Options()) -> DataFrame:
    """recordings: canonical columns and ``wave``. One row for each window, its samples padded with zeros to the window."""
    w = options.windows
    cut = segmentation.segments(recordings.where("wave IS NOT NULL").withColumn("n_samples", F.size("wave")), "n_samples", w)
    piece = F.slice("wave", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    padded = F.concat(piece, F.array_repeat(F.lit(0.0), (F.lit(w.window) - F.size(piece)).cast("int")))
    lineage = cut.select("split", F.concat_ws(":", "sha256", F.col("index").cast("string")).alias("segment_id"), F.col("dataset").alias("source_dataset"), F.col("relative_path").alias("source_relative_path"), F.col("sha256").alias("source_sha256"), "recording_group_id", "binary_label", "source_category", "source_fold", F.col("index").alias("segment_index"), F.col("start").alias("start_sample"), F.col("end").alias("end_sample"), (F.col("start") / options.rate).alias("start_seconds"), (F.col("end") / options.rate).alias("end_seconds"), (F.col("n_samples") / options.rate).alias("source_duration_seconds"), "is_padded", F.lit(options.rate).alias("sample_rate"), F.lit(w.window).alias("segment_samples"), padded.alias("wave"))
    return lineage


def preprocess_report(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    counts = segments.groupBy(F.col("source_sha256").alias("sha256")).agg(F.count("*").cast("int").alias("segment_count"))
    return recordings.select("split", "dataset", "relative_path", "sha256", "recording_group_id", "binary_label", "status", "error").join(counts, "sha256", "left").withColumn("segment_count", F.coalesce("segment_count", F.lit(0)))


def check_segments(segments: DataFrame, canonical: DataFrame) -> None:
    """Every segment comes from a recording of its split and inherits group and label; ids once and made of content and index."""
    one = canonical.select(F.col("sha256").alias("source_sha256"), F.col("split").alias("s"), F.col("recording_group_id").alias("g"), F.col("binary_label").alias("y"))
    joined = segments.select("segment_id", "source_sha256", "segment_index", "split", "recording_group_id", "binary_label").join(one, "source_sha256", "left")
    wrong = joined.where(~(F.col("s").eqNullSafe(F.col("split")) & F.col("g").eqNullSafe(F.col("recording_group_id")) & F.col("y").eqNullSafe(F.col("binary_label")) & (F.col("segment_id") == F.concat_ws(":", "source_sha256", F.col("segment_index").cast("string")))))
    for name, bad in (("segment without its recording", wrong), ("segment id twice", manifests.duplicate_keys(segments, "segment_id"))):
        if example := bad.head(1):
            raise GateError(f"{name}: {example[0].asDict()}")


def featured(segments: DataFrame, done: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Feature matrices of the segments that ``done`` lacks, with lineage, status and error."""
    todo = segments if done is None else manifests.not_yet_built(segments, done, "segment_id")
    built = dsp.features(todo.select("segment_id", "wave"), "segment_id", "wave", options.rate)
    return todo.drop("wave").join(built, "segment_id")


def packed(features: DataFrame, options: Options = Options()) -> DataFrame:
    """Finished features with ``shard_no, slot``, in the order of a digest of the segment id within each split."""
    rows = features.where("status = 'success'").withColumn("place", F.xxhash64("segment_id"))
    return manifests.shard_numbers(rows, ["split"], "place", options.shard_size, stretch_bits=52).drop("place")


def check_shards(shards: DataFrame, features: DataFrame) -> None:
    """Shards hold just the finished features, with their lineage."""
    columns = ["split", "segment_id", "binary_label", "source_sha256", "recording_group_id"]
    if example := manifests.differing_rows(shards.select(*columns), features.where("status = 'success'").select(*columns)).head(1):
        raise GateError(f"shards and features differ: {example[0].asDict()}")


def preflight(canonical: DataFrame) -> DataFrame:
    check_sources(canonical)
    return canonical.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("recording_group_id").alias("n_groups"), F.count_if(F.col("binary_label") == 1).alias("drone"), F.count_if(F.col("binary_label") == 0).alias("background"))


def rebuild(spark: SparkSession, root: str, output: str, registry: adapters.Registry, options: Options = Options()) -> str:
    """Everything, into a new folder for this run; returns it. What earlier runs wrote stays as it is."""
    home = tables.versioned_path(output)
    canonical, quarantined = prepared_splits(dataset_rows(spark, root, registry), options)
    tables.write_table(canonical, f"{home}/manifest", ("split",)), tables.write_table(quarantined, f"{home}/conflicts")
    canonical = spark.read.parquet(f"{home}/manifest")
    check_sources(canonical)
    homes = spark.createDataFrame([(r.name, r.directory) for r in registry.enabled()], "dataset string, home string")
    files = audio.audio_files(spark, root, content=True).withColumn("sha256", F.sha2("content", 256))
    decoded = waveforms(files, options).select(F.col("path").alias("file"), "status", "error", "wave")
    keyed = canonical.join(F.broadcast(homes), "dataset").withColumn("ending", F.concat(F.lit("/"), "home", F.lit("/"), "relative_path"))  # one row for each dataset
    relative = F.regexp_extract("file", f"({'|'.join('/' + r.directory + '/' for r in registry.enabled())}).*$", 0)
    recordings = keyed.join(decoded.withColumn("ending", relative), "ending").drop("ending", "home", "file")
    tables.write_table(recordings.drop("wave"), f"{home}/recordings")
    tables.write_table(segmented(recordings, options), f"{home}/segments", ("split",))
    segments = spark.read.parquet(f"{home}/segments")
    check_segments(segments, canonical)
    tables.write_table(preprocess_report(spark.read.parquet(f"{home}/recordings"), segments), f"{home}/report")
    tables.write_table(featured(segments, options=options), f"{home}/features")
    features = spark.read.parquet(f"{home}/features")
    tables.write_shards(packed(features, options), f"{home}/shards")
    check_shards(spark.read.parquet(f"{home}/shards"), features)
    return home


def export_npz(shards: DataFrame, folder: str) -> DataFrame:
    """Shards as NPZ files for programs that read those, and their manifest."""
    rows = shards.select("split", "shard_no", "slot", "segment_id", F.col("binary_label").alias("label"), "source_sha256", "recording_group_id", *[F.col(f"{k}.values").alias(k) for k in npz.FAMILIES])
    return npz.write_npz(rows, folder)


def validated(files: DataFrame) -> DataFrame:
    """Header metadata with issues: corrupted, without duration, under 1 s, over 30 s; PASS if there are none. A container that isn't read has no issue."""
    seconds = F.col("duration_sec")
    issues = F.concat_ws(", ", F.when(F.col("status") == "CORRUPTED", "corrupted"), F.when(seconds.isNull() & (F.col("status") != "UNSUPPORTED"), "missing duration"), F.when(seconds < 1.0, "too short").when(seconds > 30.0, "too long"))
    return audio.wav_metadata(files).withColumn("issues", F.when(issues == "", "PASS").otherwise(issues)).withColumn("file_name", parsing.base_name(F.col("path")))
