"""Streaming queries, run over all files that are there, and the scan queries that need no manifest."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import keys, parsing, signals
from sonarmill.plans import oracle_keys as sql
from sonarmill.sources import adapters
from sonarmill.streaming import windows

# fixed values: the datasets in their order, how their labels are found and the labels of their directories
RULES = adapters.Registry([
    adapters.Rule("drone_audio", "drone_audio", "directory", labels=(("yes_drone", 1),)),
    adapters.Rule("al_emadi", "al_emadi", "directory", labels=(("Binary_Drone_Audio/yes_drone", 1), ("Binary_Drone_Audio/unknown", 0))),
    adapters.Rule("kaist", "kaist", "filename"),
    adapters.Rule("ddl", "ddl", "filename"),
    adapters.Rule("uavirbase", "uavirbase", "json", annotation_file="label.json"),
    adapters.Rule("esc50", "esc50", "csv", annotation_file="esc50_labels.csv", enabled=False),
    adapters.Rule("urbansound8k", "urbansound8k", "csv", annotation_file="UrbanSound8K.csv", enabled=False),
])
#: The background-only datasets give no supervised rows, but background rows and the whole pipeline need them.
ALL_RULES = adapters.Registry([dataclasses.replace(r, enabled=True) for r in RULES.rules])


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.drained(windows.event_windows(windows.stream_of(spark, f"{d}/events.parquet")), "complete")
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sample_windows(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of one label read as one stream of samples, in windows of 96 samples, 48 apart."""
    blocks = windows.stream_of(spark, f"{d}/embeddings.parquet").select(F.col("label").alias("stream"), F.col("vec_id").alias("seq"), signals.as_double(F.col("embedding")).alias("samples"))
    out = windows.drained(windows.sample_windows(blocks, 96, 48))
    return out.withColumns({c: F.round(c, 6) for c in ("rms", "peak", "zcr")})


def dataset_registry(spark: SparkSession, d: str) -> DataFrame:
    return RULES.frame(spark).where("enabled").select("place", "name", "label_source", F.size("labels").alias("n_labels"))


def directory_labels(spark: SparkSession, d: str) -> DataFrame:
    """Manifest paths labelled by the directory they lie in."""
    files = spark.read.parquet(f"{d}/combined_manifest.parquet").where("dataset = 'drone_audio'").select("relative_path", "size_bytes", "sha256")
    return adapters.rows_of(RULES["drone_audio"], files).groupBy("dataset", "binary_label", "label_origin").agg(F.count("*").alias("n_rows"), F.countDistinct("recording_group_id").alias("n_groups"))


def annotated_files(spark: SparkSession, d: str) -> DataFrame:
    """Annotated background files of the datasets with CSV annotations that the inventory has ever held, however their paths are spelt."""
    held = spark.read.parquet(f"{d}/stored_files.parquet").select(keys.path_key("file_path").alias("path"), "size_bytes")
    listed = spark.read.parquet(f"{d}/background_annotations.parquet").select(F.lower(keys.strip("dataset")).alias("dataset"), keys.strip("file_name").alias("file_name"), keys.strip("fold").alias("fold"), "category", "source_id")
    out = None
    for rule in (r for r in RULES.rules if r.label_source == "csv"):
        home = f"raw/{rule.directory}/"
        stored = held.where(F.startswith("path", F.lit(home))).select(F.substring("path", len(home) + 1, 1 << 30).alias("relative_path"), "size_bytes").groupBy("relative_path").agg(F.max("size_bytes").alias("size_bytes")).withColumn("sha256", F.lit(None).cast("string"))
        rows = adapters.rows_of(rule, stored, listed.where(F.col("dataset") == rule.name)).select("relative_path", "source_category", "source_fold", "recording_group_id", "size_bytes")
        out = rows if out is None else out.unionByName(rows)
    return out


#: The datasets whose labels stand in their directories or names.
_NAMED = ("drone_audio", "al_emadi", "kaist", "ddl")


def _files(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/combined_manifest.parquet").where(F.col("dataset") == name).select("relative_path", "size_bytes", "sha256")


def supervised_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the adapters make of the listed paths, with all that the names say."""
    out = None
    for name in _NAMED:
        rows = adapters.rows_of(RULES[name], _files(spark, d, name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("dataset", "relative_path", "file_name", "extension", "binary_label", "label_origin", "recording_group_id", "drone_type", "movement", "rotation", "distance_m", "height_m", "azimuth_deg", "recording_start", F.round("temperature_c", 6).alias("temperature_c"))


def skipped_files(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset, how many of the listed audio files its adapter makes rows of and how many it leaves out."""
    out = None
    for name in _NAMED:
        files = _files(spark, d, name)
        one = adapters.skipped(RULES[name], files, adapters.rows_of(RULES[name], files))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_sample_windows, dataset_registry, directory_labels, annotated_files, supervised_manifest, skipped_files)}
_BASE = "regexp_replace(relative_path, '^.*/', '')"
_STEM = f"regexp_replace({_BASE}, '(.)\\.[^.]*$', '\\1')"
_HOME = "CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '.' END"
# the patterns in DuckDB's dialect
_DDL = parsing.DDL_NAME
_KAIST = parsing.KAIST_NAME
_SUPERVISED = f"""m AS (SELECT dataset, relative_path, {_BASE} AS file_name, {_STEM} AS t, {_HOME} AS home, lower(regexp_extract({_BASE}, '.(\\.[^.]*)$', 1)) AS extension, regexp_replace({_STEM}, '(?i)[_-](?:mic[12]|ch[12])$', '') AS k FROM combined_manifest),
u AS (SELECT *, CASE WHEN dataset = 'drone_audio' THEN CASE WHEN starts_with(relative_path, 'yes_drone/') THEN 1 END WHEN dataset = 'al_emadi' THEN CASE WHEN starts_with(relative_path, 'Binary_Drone_Audio/yes_drone/') THEN 1 WHEN starts_with(relative_path, 'Binary_Drone_Audio/unknown/') THEN 0 END
WHEN dataset = 'ddl' THEN CASE WHEN regexp_matches(t, '{_DDL}') THEN CASE upper(regexp_extract(t, '{_DDL}', 2)) WHEN 'XXXX' THEN 0 ELSE 1 END END WHEN dataset = 'kaist' THEN CASE WHEN regexp_matches(k, '{_KAIST}') THEN 1 END END AS binary_label FROM m WHERE dataset IN ('drone_audio', 'al_emadi', 'ddl', 'kaist')),
v AS (SELECT * FROM u WHERE binary_label IS NOT NULL AND (dataset IN ('ddl', 'kaist') OR extension IN ('.wav', '.mp3', '.flac', '.ogg', '.m4a')))"""
ORACLE = {
    "supervised_manifest": f"""WITH {_SUPERVISED} SELECT dataset, relative_path, file_name, extension, binary_label,
CASE dataset WHEN 'kaist' THEN 'kaist:filename_metadata' WHEN 'ddl' THEN 'ddl:filename_metadata:sample_type=' || upper(regexp_extract(t, '{_DDL}', 7)) || ':flight=' || regexp_extract(t, '{_DDL}', 8) || ':recording=' || regexp_extract(t, '{_DDL}', 9) || ':sequence=' || right(t, 6) ELSE 'directory:' || split_part(relative_path, '/', 1) END AS label_origin,
dataset || ':' || CASE dataset WHEN 'al_emadi' THEN relative_path WHEN 'ddl' THEN CASE WHEN home = '.' THEN t ELSE home END WHEN 'kaist' THEN regexp_replace(t, '_\\d+_?$', '') ELSE regexp_replace(t, '(.)_\\d+_?$', '\\1') END AS recording_group_id,
CASE dataset WHEN 'ddl' THEN CASE upper(regexp_extract(t, '{_DDL}', 2)) WHEN 'MINI' THEN 'DJI Mini 2' WHEN 'PRO4' THEN 'DJI Phantom 4 Pro' ELSE 'unknown' END WHEN 'kaist' THEN upper(regexp_extract(k, '{_KAIST}', 1)) END AS drone_type,
CASE dataset WHEN 'kaist' THEN upper(regexp_extract(k, '{_KAIST}', 2)) END AS movement, CASE dataset WHEN 'kaist' THEN CASE WHEN upper(regexp_extract(k, '{_KAIST}', 2)) IN ('C', 'CC') THEN upper(regexp_extract(k, '{_KAIST}', 2)) ELSE '' END END AS rotation,
CASE dataset WHEN 'ddl' THEN CAST(regexp_extract(t, '{_DDL}', 4) AS DOUBLE) END AS distance_m, CASE dataset WHEN 'ddl' THEN CAST(regexp_extract(t, '{_DDL}', 5) AS DOUBLE) END AS height_m, CASE dataset WHEN 'ddl' THEN CAST(regexp_extract(t, '{_DDL}', 3) AS DOUBLE) END AS azimuth_deg,
CASE dataset WHEN 'ddl' THEN strftime(try_strptime(regexp_extract(t, '{_DDL}', 1), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%S') END AS recording_start, CASE dataset WHEN 'ddl' THEN round(CAST(regexp_extract(t, '{_DDL}', 6) AS DOUBLE) / 10 - 273.15, 6) END AS temperature_c FROM v""",
    "skipped_files": f"""WITH {_SUPERVISED}, n AS (SELECT dataset, count(*) FILTER (extension IN ('.wav', '.mp3', '.flac', '.ogg', '.m4a')) AS n_files FROM m GROUP BY 1), r AS (SELECT dataset, count(*) AS n_rows FROM v GROUP BY 1)
SELECT d.dataset, coalesce(n_files, 0) AS n_files, coalesce(n_rows, 0) AS n_rows, coalesce(n_files, 0) - coalesce(n_rows, 0) AS n_skipped FROM (VALUES ('drone_audio'), ('al_emadi'), ('kaist'), ('ddl')) d(dataset) LEFT JOIN n ON n.dataset = d.dataset LEFT JOIN r ON r.dataset = d.dataset""",
    "stream_event_windows": "WITH b AS (SELECT *, time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') AS k FROM events), s AS (SELECT event_type, value, k AS started FROM b UNION ALL SELECT event_type, value, k - INTERVAL '2 hours' FROM b) SELECT started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2",
    "stream_sample_windows": """WITH e AS (SELECT label::VARCHAR AS stream, flatten(list(list_transform(embedding, lambda x: x::DOUBLE) ORDER BY vec_id)) AS w FROM embeddings GROUP BY 1), i AS (SELECT stream, w, unnest(range(0, (len(w) - 96) // 48 + 1)) AS index FROM e WHERE len(w) >= 96), c AS (SELECT stream, index, w[index * 48 + 1 : index * 48 + 96] AS w FROM i)
SELECT stream, index, index * 48 AS start, index * 48 + 96 AS "end", round(sqrt(list_sum(list_transform(w, lambda x: x * x)) / 96), 6) AS rms, round(list_max(list_transform(w, lambda x: abs(x))), 6) AS peak, round(list_sum(list_transform(range(1, 96), lambda j: CASE WHEN (w[j] < 0) <> (w[j + 1] < 0) THEN 1 ELSE 0 END)) / 96, 6) AS zcr FROM c""",
    "dataset_registry": "SELECT * FROM (VALUES (0, 'drone_audio', 'directory', 1), (1, 'al_emadi', 'directory', 2), (2, 'kaist', 'filename', 0), (3, 'ddl', 'filename', 0), (4, 'uavirbase', 'json', 0)) t(place, name, label_source, n_labels)",
    "directory_labels": "SELECT 'drone_audio' AS dataset, 1 AS binary_label, 'directory:' || split_part(relative_path, '/', 1) AS label_origin, count(*) AS n_rows, count(DISTINCT regexp_replace(regexp_replace(regexp_replace(relative_path, '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '(.)_\\d+_?$', '\\1')) AS n_groups FROM combined_manifest WHERE dataset = 'drone_audio' AND starts_with(relative_path, 'yes_drone/') AND regexp_matches(lower(relative_path), '\\.(wav|mp3|flac|ogg|m4a)$') GROUP BY 1, 2, 3",
    "annotated_files": f"""WITH f AS (SELECT {sql.path_key('file_path')} AS p, max(size_bytes) AS z FROM stored_files GROUP BY 1),
a AS (SELECT lower({sql.strip('dataset')}) AS dataset, {sql.strip('file_name')} AS file_name, {sql.strip('fold')} AS fold, category, source_id FROM background_annotations),
l AS (SELECT *, CASE dataset WHEN 'esc50' THEN 'wav_files/' || file_name WHEN 'urbansound8k' THEN 'fold' || fold || '/' || file_name END AS r FROM a)
SELECT r AS relative_path, category AS source_category, fold AS source_fold, dataset || ':' || trim(source_id) AS recording_group_id, z AS size_bytes FROM l JOIN f ON f.p = 'raw/' || dataset || '/' || r""",
}
