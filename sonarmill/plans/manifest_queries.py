"""Manifest queries: identity, splits, lineage, audits, shards and parsed names, over the manifest tables as given.

Keys are compared by the rules of ``functions.keys``; a row's place in input order is its row_seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import keys, parsing
from sonarmill.operators import manifests, segmentation
from sonarmill.plans import oracle_keys as sql
from sonarmill.session import read_table

SPLITS = manifests.SPLITS


def combined(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "combined_manifest").select("row_seq", keys.split_name("split").alias("split"), "dataset", "relative_path", "file_name", "binary_label", "source_category", "source_fold", keys.group_key("recording_group_id").alias("recording_group"), "size_bytes", keys.sha_key("sha256").alias("sha"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "train_segments").select("row_seq", keys.split_name("split").alias("split"), keys.segment_key("segment_id").alias("segment"), keys.sha_key("source_sha256").alias("sha"), "segment_index", keys.group_key("recording_group_id").alias("recording_group"), "binary_label", "source_dataset", "source_duration_seconds", "start_sample", "end_sample", "is_padded")


def shards(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "train_shard_manifest").select("row_seq", keys.split_name("split").alias("split"), keys.segment_key("segment_id").alias("segment"), keys.sha_key("source_sha256").alias("sha"), keys.group_key("recording_group_id").alias("recording_group"), "binary_label", "source_dataset", keys.path_key("shard_path").alias("shard"), "shard_index")


def features(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "train_feature_manifest")


_C = f"c AS (SELECT row_seq, {sql.split_name('split')} AS split, dataset, relative_path, file_name, binary_label, source_category, source_fold, {sql.group_key('recording_group_id')} AS recording_group, size_bytes, {sql.sha_key('sha256')} AS sha FROM combined_manifest)"
_S = f"s AS (SELECT row_seq, {sql.split_name('split')} AS split, {sql.segment_key('segment_id')} AS segment, {sql.sha_key('source_sha256')} AS sha, segment_index, {sql.group_key('recording_group_id')} AS recording_group, binary_label, source_dataset, source_duration_seconds, start_sample, end_sample, is_padded FROM train_segments)"
_H = f"h AS (SELECT row_seq, {sql.split_name('split')} AS split, {sql.segment_key('segment_id')} AS segment, {sql.sha_key('source_sha256')} AS sha, {sql.group_key('recording_group_id')} AS recording_group, binary_label, source_dataset, {sql.path_key('shard_path')} AS shard, shard_index FROM train_shard_manifest)"
_K = "k AS (SELECT sha, count(*) AS n_rows, min(row_seq) AS first_row, min(binary_label) < max(binary_label) AS conflict FROM c WHERE sha IS NOT NULL GROUP BY 1)"

# identity


def dedup_retained(spark: SparkSession, d: str) -> DataFrame:
    return manifests.deduplicate(combined(spark, d), "sha", "binary_label", "row_seq").select("row_seq", "sha", "binary_label", "dataset")


def dedup_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return manifests.conflicts(combined(spark, d), "sha", "binary_label", "row_seq").select("row_seq", "sha", "binary_label", "conflict_reason")


def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifests.dedup_summary(combined(spark, d), "sha", "binary_label", "row_seq")


def group_split(spark: SparkSession, d: str) -> DataFrame:
    return manifests.group_split(combined(spark, d), "recording_group", "binary_label")


def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every row of a pure group with its split."""
    rows = combined(spark, d)
    new = manifests.group_split(rows, "recording_group", "binary_label").select(F.col("group").alias("recording_group"), F.col("split").alias("new_split"))
    return rows.join(new, "recording_group").select("row_seq", "recording_group", "new_split")


_SPLIT_SQL = f"""WITH RECURSIVE {_C}, g AS (SELECT recording_group AS grp, min(binary_label) AS label, count(*) AS n FROM c WHERE recording_group IS NOT NULL GROUP BY 1 HAVING min(binary_label) = max(binary_label)),
o AS MATERIALIZED (SELECT grp, label, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, sha256(grp || '|42')) AS i, sum(n) OVER (PARTITION BY label) AS t FROM g),
w AS (SELECT label, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS grp, CAST(0 AS BIGINT) AS n, CAST(0 AS HUGEINT) AS a, CAST(0 AS HUGEINT) AS b, CAST(0 AS HUGEINT) AS e, CAST(NULL AS VARCHAR) AS split FROM (SELECT DISTINCT label FROM o)
UNION ALL SELECT x.label, x.i, x.grp, x.n, w.a + CASE WHEN x.p = 'train' THEN x.n ELSE 0 END, w.b + CASE WHEN x.p = 'validation' THEN x.n ELSE 0 END, w.e + CASE WHEN x.p = 'test' THEN x.n ELSE 0 END, x.p FROM w JOIN LATERAL (SELECT o.label, o.i, o.grp, o.n,
CASE WHEN o.i = 1 THEN 'train' WHEN o.i = 2 THEN 'validation' WHEN o.i = 3 THEN 'test'
WHEN (o.t * 0.7::DOUBLE - w.a > o.t * 0.15::DOUBLE - w.b OR (o.t * 0.7::DOUBLE - w.a = o.t * 0.15::DOUBLE - w.b AND w.a <= w.b)) AND (o.t * 0.7::DOUBLE - w.a > o.t * 0.15::DOUBLE - w.e OR (o.t * 0.7::DOUBLE - w.a = o.t * 0.15::DOUBLE - w.e AND w.a <= w.e)) THEN 'train'
WHEN w.b <= w.e THEN 'validation' ELSE 'test' END AS p FROM o WHERE o.label = w.label AND o.i = w.i + 1) x ON true)"""

# integrity


def split_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return manifests.split_overlaps(combined(spark, d), ["sha", "recording_group"], "split")


def segment_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return manifests.split_overlaps(shards(spark, d), ["segment", "sha", "recording_group"], "split")


def cross_split_keys(spark: SparkSession, d: str) -> DataFrame:
    """Recordings in several splits, with the splits."""
    return manifests.memberships(combined(spark, d), "recording_group", "split").select("key", "n_rows", F.array_join("splits", ",").alias("splits"))


def source_partition_diff(spark: SparkSession, d: str) -> DataFrame:
    """Contents of the combined manifest that no segment comes from, and the other way round."""
    a, b = combined(spark, d), segments(spark, d)
    return manifests.missing_from(a, b, "sha").withColumn("missing_in", F.lit("segments")).unionByName(manifests.missing_from(b, a, "sha").withColumn("missing_in", F.lit("combined")))


def segment_lineage_check(spark: SparkSession, d: str) -> DataFrame:
    """Per check, how many segments break it: content in the manifest, group and label inherited, id of content and index, id once."""
    first = combined(spark, d).where("sha IS NOT NULL").groupBy("sha").agg(F.min_by(F.struct("recording_group", "binary_label"), "row_seq").alias("origin"))
    rows = segments(spark, d)
    joined = rows.join(first, "sha", "left")
    twice = F.count("*") - F.countDistinct("segment")
    one = joined.agg(
        F.count_if(F.col("origin").isNull()).alias("source_missing"), F.count_if(F.col("origin").isNotNull() & ~F.col("recording_group").eqNullSafe(F.col("origin.recording_group"))).alias("group_differs"),
        F.count_if(F.col("origin").isNotNull() & ~F.col("binary_label").eqNullSafe(F.col("origin.binary_label"))).alias("label_differs"), F.count_if(~F.col("segment").eqNullSafe(F.concat("sha", F.lit(":"), F.col("segment_index").cast("string")))).alias("id_differs"), twice.alias("repeated_ids"),
    )
    return one.unpivot([], ["source_missing", "group_differs", "label_differs", "id_differs", "repeated_ids"], "check", "n_bad")


def shard_lineage_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows that shard and segment manifests don't share, as whole rows of their lineage columns."""
    columns = ["split", "segment", "binary_label", "sha", "recording_group"]
    return manifests.differing_rows(shards(spark, d).select(*columns).distinct(), segments(spark, d).select(*columns).distinct())


def mixed_label_groups(spark: SparkSession, d: str) -> DataFrame:
    return manifests.mixed_groups(combined(spark, d), "recording_group", "binary_label")


def duplicate_segment_ids(spark: SparkSession, d: str) -> DataFrame:
    return manifests.duplicate_keys(segments(spark, d), "segment")


def manifest_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row per check: keys in several splits, groups with both labels, values outside their domain, empty keys."""
    rows = combined(spark, d)
    each = lambda name, df: df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    out = each("sha_in_several_splits", manifests.memberships(rows, "sha", "split"))
    for name, df in (("group_in_several_splits", manifests.memberships(rows, "recording_group", "split")), ("group_with_both_labels", manifests.mixed_groups(rows, "recording_group", "binary_label")), ("label_outside_domain", rows.where("binary_label IS NULL OR binary_label NOT IN (0, 1)")), ("split_missing", rows.where("split IS NULL")), ("sha_missing", rows.where("sha IS NULL")), ("group_missing", rows.where("recording_group IS NULL"))):
        out = out.unionByName(each(name, df))
    return out


def preflight_report(spark: SparkSession, d: str) -> DataFrame:
    return combined(spark, d).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("sha").alias("n_sha"), F.countDistinct("recording_group").alias("n_groups"), F.count_if(F.col("binary_label") == 0).alias("background"), F.count_if(F.col("binary_label") == 1).alias("drone"))


# counts


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per split and in all."""
    return combined(spark, d).rollup("split").agg(F.count("*").alias("n_rows"), F.grouping("split").cast("int").alias("is_total"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return combined(spark, d).groupBy("binary_label", "dataset").agg(F.count("*").alias("n_rows"))


def crosstab_status(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).groupBy("binary_label").pivot("status", ["success", "skipped", "failed"]).count().fillna(0)


def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d)
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "failed")], F.count_if((F.col("status") == "success") & F.col("mfcc_path").isNull()).alias("success_without_path"))


def dataset_presence(spark: SparkSession, d: str) -> DataFrame:
    """Which dataset is in which split."""
    return combined(spark, d).where("split IS NOT NULL").groupBy("dataset").pivot("split", list(SPLITS)).agg(F.lit(1)).fillna(0)


def label_domain(spark: SparkSession, d: str) -> DataFrame:
    """Rows per label of the fixed domain, 0 where there are none."""
    domain = spark.createDataFrame([(i,) for i in (0, 1, 2)], "binary_label int")
    return domain.join(combined(spark, d).groupBy("binary_label").agg(F.count("*").alias("n")), "binary_label", "left").select("binary_label", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_rows"))


# segments


def segments_sliding(spark: SparkSession, d: str) -> DataFrame:
    """The windows that the text length of each document, read as samples, gives."""
    return segmentation.segments(read_table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", segmentation.Windows(400, 200, 50)).select("doc_id", "index", "start", "end", "is_padded")


def segments_nonoverlap(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.segments(read_table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", segmentation.Windows(300, 300, 300)).select("doc_id", "index", "start", "end", "is_padded")


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.chunks(read_table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 400, 200, 100).select("doc_id", "index", "start", "end")


def segment_bounds_check(spark: SparkSession, d: str) -> DataFrame:
    """Recordings whose segments as listed are not those that their length gives, by count."""
    listed = segments(spark, d).where("sha IS NOT NULL AND source_duration_seconds IS NOT NULL")
    known = listed.groupBy("sha").agg(F.max("source_duration_seconds").alias("seconds"), F.countDistinct("segment_index").alias("listed"))
    due = known.withColumn("due", F.size(segmentation.bounds(F.round(F.col("seconds") * 16_000), segmentation.Windows())))
    return due.where("listed <> due").select("sha", "listed", F.col("due").cast("bigint").alias("due"))


_FULL = "CASE WHEN n >= {w} THEN (n - {w}) // {h} + 1 ELSE 0 END"


def _segments_sql(w: int, h: int, m: int) -> str:
    full = _FULL.format(w=w, h=h)
    return f"""WITH n AS (SELECT doc_id, n_chars AS n, {full} AS f FROM documents), b AS (SELECT *, CASE WHEN f > 0 THEN (f - 1) * {h} + {w} ELSE 0 END AS covered FROM n)
SELECT doc_id, CAST(i AS INT) AS index, i * {h} AS start, i * {h} + {w} AS "end", false AS is_padded FROM (SELECT doc_id, unnest(range(0, f)) AS i FROM b)
UNION ALL SELECT doc_id, CAST(f AS INT), f * {h}, n, true FROM b WHERE f * {h} < n AND n > covered AND n - f * {h} >= {m}"""


# validation


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Issues of each segment row's source, joined by commas, or PASS."""
    seconds = F.col("source_duration_seconds")
    issues = F.concat_ws(", ", F.when(seconds.isNull(), "missing duration"), F.when(seconds < 1.0, "too short").when(seconds > 30.0, "too long"), F.when(F.col("sha").isNull(), "missing hash"))
    return segments(spark, d).select("row_seq", "source_dataset", F.coalesce(keys.filled(issues), F.lit("PASS")).alias("issues"))


def validation_totals(spark: SparkSession, d: str) -> DataFrame:
    return validation_report(spark, d).agg(F.count("*").alias("n"), *[F.count_if(F.col("issues") == v).alias(k) for k, v in (("passed", "PASS"), ("too_short", "too short"), ("too_long", "too long"))], F.count_if(F.contains("issues", F.lit("missing"))).alias("missing"), F.round(100 * F.avg((F.col("issues") == "PASS").cast("int")), 6).alias("pass_percent"))


def pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return validation_report(spark, d).groupBy("source_dataset").agg(F.round(100 * F.avg((F.col("issues") == "PASS").cast("int")), 6).alias("pass_percent"))


def mean_duration(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("source_dataset").agg(F.round(F.avg("source_duration_seconds"), 2).alias("mean_seconds"))


_V = f"{_S}, v AS (SELECT row_seq, source_dataset, coalesce(nullif(concat_ws(', ', CASE WHEN source_duration_seconds IS NULL THEN 'missing duration' END, CASE WHEN source_duration_seconds < 1.0 THEN 'too short' WHEN source_duration_seconds > 30.0 THEN 'too long' END, CASE WHEN sha IS NULL THEN 'missing hash' END), ''), 'PASS') AS issues FROM s)"

# shards


def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Segments packed in order of their row, 256 to a shard, for each split."""
    rows = segments(spark, d).where("split IS NOT NULL").select("row_seq", "split")
    return manifests.shard_numbers(rows, ["split"], "row_seq")


def shard_verification(spark: SparkSession, d: str) -> DataFrame:
    """Per shard: samples, labels outside the domain, ids missing or repeated, slots missing or outside."""
    rows = shards(spark, d).where("shard IS NOT NULL")
    return rows.groupBy("shard").agg(F.count("*").alias("samples"), F.count_if(F.col("binary_label") == 1).alias("drone"), F.count_if(~F.coalesce(F.col("binary_label").isin(0, 1), F.lit(False))).alias("bad_labels"), F.count_if(F.col("segment").isNull()).alias("missing_ids"), (F.count("segment") - F.countDistinct("segment")).alias("repeated_ids"), F.count_if(F.col("shard_index").isNull()).alias("missing_slots"), F.count_if((F.col("shard_index") < 0) | (F.col("shard_index") > 255)).alias("slots_outside"))


def shard_id_differences(spark: SparkSession, d: str) -> DataFrame:
    """Segment ids that only the shards or only the segment manifest have."""
    a, b = shards(spark, d), segments(spark, d)
    return manifests.missing_from(a, b, "segment").withColumn("only_in", F.lit("shards")).unionByName(manifests.missing_from(b, a, "segment").withColumn("only_in", F.lit("segments")))


def feature_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Shard rows against the feature manifest: which of label, content and group differ."""
    first = features(spark, d).select(keys.segment_key("segment_id").alias("segment"), "binary_label", keys.sha_key("source_sha256").alias("sha"), keys.group_key("recording_group_id").alias("recording_group"), "row_seq").where("segment IS NOT NULL").groupBy("segment").agg(F.min_by(F.struct("binary_label", "sha", "recording_group"), "row_seq").alias("f"))
    joined = shards(spark, d).where("segment IS NOT NULL").join(first, "segment", "left")
    differ = lambda c: F.count_if(F.col("f").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"f.{c}")))
    return joined.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(F.col("f").isNull()).alias("unknown"), differ("binary_label").alias("label_differs"), differ("sha").alias("sha_differs"), differ("recording_group").alias("group_differs"))


def features_to_build(spark: SparkSession, d: str) -> DataFrame:
    """Segments without a finished feature row: what an incremental build still has to do."""
    done = features(spark, d).where("status IN ('success', 'skipped')").select(keys.segment_key("segment_id").alias("segment"))
    return manifests.not_yet_built(segments(spark, d).where("segment IS NOT NULL").select("segment").distinct(), done, "segment")


# names


def group_id_derive(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "combined_manifest")
    return rows.select("row_seq", manifests.recording_group(F.col("dataset"), F.col("relative_path"), F.col("file_name")).alias("derived_group"))


def filename_parse_ddl(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "combined_manifest").where("dataset = 'ddl'")
    return rows.select("row_seq", parsing.ddl(parsing.stem(F.col("file_name"))).alias("m")).where("m IS NOT NULL").select("row_seq", "m.binary_label", "m.drone_type", "m.azimuth_deg", "m.distance_m", "m.height_m", F.round("m.temperature_c", 6).alias("temperature_c"), "m.recording_start", "m.label_origin")


def filename_parse_kaist(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "combined_manifest").where("dataset = 'kaist'")
    name = F.regexp_replace(parsing.stem(F.col("file_name")), "_\\d+$", "")  # chunks carry their number behind the channel
    return rows.select("row_seq", parsing.kaist(name).alias("m")).where("m IS NOT NULL").select("row_seq", "m.*")


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("relative_path")
    return read_table(spark, d, "combined_manifest").select("row_seq", parsing.base_name(path).alias("base"), parsing.stem(path).alias("stem"), parsing.suffix(path).alias("suffix"), parsing.parent(path).alias("parent"), parsing.leaves_root(path).alias("leaves_root"))


def segment_id_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "train_shard_manifest").where("segment_id IS NOT NULL")
    return rows.select("row_seq", parsing.id_parts(F.trim("segment_id")).alias("p"), parsing.inferred_recording(F.col("segment_id")).alias("i"), parsing.safe_name(F.trim("segment_id")).alias("file_name")).select("row_seq", "p.*", F.col("i.recording").alias("inferred"), F.col("i.method").alias("method"), "file_name")


def json_label_parse(spark: SparkSession, d: str) -> DataFrame:
    """Labels and numbers with units out of the nested label texts, by a declared schema; texts that aren't an object give no row."""
    schema = "struct<drone:struct<sound_source:string,distance:string,height:string,azimuth:string>,microphone_array:struct<center_latitude:string>>"
    texts = read_table(spark, d, "uavirbase_labels").select("label_id", "relative_path", parsing.json_text(F.col("label")).alias("text"))
    parsed = texts.where(F.startswith(keys.strip("text"), F.lit("{"))).select("label_id", "relative_path", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("j"))
    rows = parsed.select("label_id", parsing.parent(F.col("relative_path")).alias("recording"), parsing.sound_label(F.col("j.drone.sound_source")).alias("binary_label"), parsing.first_number(F.col("j.drone.distance")).alias("distance_m"), parsing.first_number(F.col("j.drone.height")).alias("height_m"), parsing.first_number(F.col("j.microphone_array.center_latitude")).alias("latitude"))
    return rows.where("binary_label IS NOT NULL")


def background_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Background annotations as canonical manifest rows."""
    rows = read_table(spark, d, "background_annotations")
    name, fold = F.trim("file_name"), F.trim("fold")
    esc = F.col("dataset") == "esc50"
    return rows.select(
        "row_seq", "dataset", F.when(esc, F.concat(F.lit("wav_files/"), name)).otherwise(F.concat(F.lit("fold"), fold, F.lit("/"), name)).alias("relative_path"), name.alias("file_name"), F.lit(0).alias("binary_label"),
        F.lit("official_metadata:no_drone").alias("label_origin"), F.col("category").alias("source_category"), fold.alias("source_fold"), F.concat("dataset", F.lit(":"), F.col("source_id")).alias("recording_group_id"),
    )


def canonical_union(spark: SparkSession, d: str) -> DataFrame:
    """Drone rows, then background rows, in one schema, counted by origin."""
    drone = read_table(spark, d, "combined_manifest").where("binary_label = 1").select("dataset", "relative_path", "binary_label", "label_origin")
    return drone.unionByName(background_manifest(spark, d).select("dataset", "relative_path", "binary_label", "label_origin")).groupBy("dataset", "binary_label", "label_origin").agg(F.count("*").alias("n_rows"))


_STEM = "regexp_replace({c}, '(.)\\.[^.]*$', '\\1')"
_BASE = "regexp_replace(relative_path, '^.*/', '')"
_DDL = "(?i)^(\\d{14})(MINI|PRO4|XXXX)(\\d{3})(\\d{3})(\\d{3})(\\d{4})([RS])(\\d{6})-(T\\d{3})-(\\d{6})$"
_KAIST = "(?i)^([ABC])[_-](CC|F|B|R|L|C)[_-](N|MF[1-4]|PC[1-4])[_-]([^_-]+)[_-](.+?)[_-]([^_-]+)[_-](-?\\d+(?:\\.\\d+)?)(?:dB)?$"


def _part(pattern: str, i: int) -> str:
    return f"regexp_extract(t, '{pattern}', {i})"


_NAMES = [dedup_retained, dedup_conflicts, dedup_summary, group_split, split_assignment, split_overlaps, segment_overlaps, cross_split_keys, source_partition_diff, segment_lineage_check, shard_lineage_diff, mixed_label_groups, duplicate_segment_ids, manifest_audit, preflight_report, split_counts, label_counts, crosstab_status, feature_summary, dataset_presence, label_domain, segments_sliding, segments_nonoverlap, chunk_windows, segment_bounds_check, validation_report, validation_totals, pass_rate, mean_duration, shard_assignment, shard_verification, shard_id_differences, feature_reconciliation, features_to_build, group_id_derive, filename_parse_ddl, filename_parse_kaist, path_parts, segment_id_parts, json_label_parse, background_manifest, canonical_union]
QUERIES = {f.__name__: f for f in _NAMES}


def _overlap_sql(cte: str, table: str, names: list[str]) -> str:
    pairs = "(VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(a, b)"
    return f"WITH {cte} " + " UNION ALL ".join(f"SELECT '{k}' AS key_name, a AS left_split, b AS right_split, count(*) AS n, min(x) AS example FROM (SELECT {k} AS x, list(DISTINCT split) AS l FROM {table} WHERE {k} IS NOT NULL AND split IS NOT NULL GROUP BY 1), {pairs} WHERE list_contains(l, a) AND list_contains(l, b) GROUP BY 1, 2, 3" for k in names)


ORACLE = {
    "dedup_retained": f"WITH {_C}, {_K} SELECT c.row_seq, c.sha, c.binary_label, c.dataset FROM c JOIN k ON c.sha = k.sha AND c.row_seq = k.first_row WHERE NOT coalesce(conflict, false)",
    "dedup_conflicts": f"WITH {_C}, {_K} SELECT c.row_seq, c.sha, c.binary_label, 'conflicting_binary_labels_for_identical_content' AS conflict_reason FROM c JOIN k ON c.sha = k.sha WHERE conflict",
    "dedup_summary": f"WITH {_C}, {_K} SELECT count(*) FILTER (NOT coalesce(conflict, false)) AS retained, CAST(sum(CASE WHEN coalesce(conflict, false) THEN 0 ELSE n_rows - 1 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN conflict THEN n_rows ELSE 0 END) AS BIGINT) AS quarantined, count(*) FILTER (conflict) AS conflicting_contents FROM k",
    "group_split": _SPLIT_SQL + ' SELECT grp AS "group", label, n, split FROM w WHERE i > 0',
    "split_assignment": _SPLIT_SQL + " SELECT c.row_seq, c.recording_group, w.split AS new_split FROM c JOIN w ON w.grp = c.recording_group",
    "split_overlaps": _overlap_sql(_C, "c", ["sha", "recording_group"]),
    "segment_overlaps": _overlap_sql(_H, "h", ["segment", "sha", "recording_group"]),
    "cross_split_keys": f"WITH {_C} SELECT recording_group AS key, count(*) AS n_rows, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM c WHERE recording_group IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "source_partition_diff": f"WITH {_C}, {_S} SELECT DISTINCT sha, 'segments' AS missing_in FROM c WHERE sha IS NOT NULL AND sha NOT IN (SELECT sha FROM s WHERE sha IS NOT NULL) UNION ALL SELECT DISTINCT sha, 'combined' FROM s WHERE sha IS NOT NULL AND sha NOT IN (SELECT sha FROM c WHERE sha IS NOT NULL)",
    "segment_lineage_check": f"""WITH {_C}, {_S}, o AS (SELECT DISTINCT ON (sha) sha, recording_group AS g, binary_label AS b FROM c WHERE sha IS NOT NULL ORDER BY sha, row_seq), j AS (SELECT s.*, o.sha AS o, g, b FROM s LEFT JOIN o ON s.sha = o.sha)
SELECT 'source_missing' AS "check", count(*) FILTER (o IS NULL) AS n_bad FROM j UNION ALL SELECT 'group_differs', count(*) FILTER (o IS NOT NULL AND recording_group IS DISTINCT FROM g) FROM j UNION ALL SELECT 'label_differs', count(*) FILTER (o IS NOT NULL AND binary_label IS DISTINCT FROM b) FROM j
UNION ALL SELECT 'id_differs', count(*) FILTER (segment IS DISTINCT FROM sha || ':' || segment_index) FROM j UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT segment) FROM j""",
    "shard_lineage_diff": f"WITH {_S}, {_H}, a AS (SELECT DISTINCT split, segment, binary_label, sha, recording_group FROM h), b AS (SELECT DISTINCT split, segment, binary_label, sha, recording_group FROM s) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "mixed_label_groups": f'WITH {_C} SELECT recording_group AS "group", count(*) AS n FROM c WHERE recording_group IS NOT NULL GROUP BY 1 HAVING min(binary_label) < max(binary_label)',
    "duplicate_segment_ids": f"WITH {_S} SELECT segment, count(*) AS n FROM s WHERE segment IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "manifest_audit": f"""WITH {_C} SELECT 'sha_in_several_splits' AS "check", count(*) AS n_bad FROM (SELECT sha FROM c WHERE sha IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'group_in_several_splits', count(*) FROM (SELECT recording_group FROM c WHERE recording_group IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'group_with_both_labels', count(*) FROM (SELECT recording_group FROM c WHERE recording_group IS NOT NULL GROUP BY 1 HAVING count(DISTINCT binary_label) > 1)
UNION ALL SELECT 'label_outside_domain', count(*) FROM c WHERE binary_label IS NULL OR binary_label NOT IN (0, 1) UNION ALL SELECT 'split_missing', count(*) FROM c WHERE split IS NULL UNION ALL SELECT 'sha_missing', count(*) FROM c WHERE sha IS NULL UNION ALL SELECT 'group_missing', count(*) FROM c WHERE recording_group IS NULL""",
    "preflight_report": f"WITH {_C} SELECT split, count(*) AS n_rows, count(DISTINCT sha) AS n_sha, count(DISTINCT recording_group) AS n_groups, count(*) FILTER (binary_label = 0) AS background, count(*) FILTER (binary_label = 1) AS drone FROM c GROUP BY 1",
    "split_counts": f"WITH {_C} SELECT split, count(*) AS n_rows, CAST(grouping(split) AS INT) AS is_total FROM c GROUP BY ROLLUP (split)",
    "label_counts": f"WITH {_C} SELECT binary_label, dataset, count(*) AS n_rows FROM c GROUP BY 1, 2",
    "crosstab_status": "SELECT binary_label, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM train_feature_manifest GROUP BY 1",
    "feature_summary": "SELECT count(*) AS n_rows, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'success' AND mfcc_path IS NULL) AS success_without_path FROM train_feature_manifest",
    "dataset_presence": f"WITH {_C} SELECT dataset, max(CAST(split = 'train' AS INT)) AS train, max(CAST(split = 'validation' AS INT)) AS validation, max(CAST(split = 'test' AS INT)) AS test FROM c WHERE split IS NOT NULL GROUP BY 1",
    "label_domain": "SELECT CAST(l AS INT) AS binary_label, (SELECT count(*) FROM combined_manifest WHERE binary_label = l) AS n_rows FROM range(3) t(l)",
    "segments_sliding": _segments_sql(400, 200, 50),
    "segments_nonoverlap": _segments_sql(300, 300, 300),
    "chunk_windows": 'SELECT doc_id, CAST(i AS INT) AS index, i * 200 AS start, least(i * 200 + 400, n) AS "end" FROM (SELECT doc_id, n_chars AS n, unnest(range(0, n_chars)) AS i FROM documents WHERE n_chars >= 100) WHERE i * 200 < n AND (i = 0 OR (i - 1) * 200 + 400 < n) AND least(i * 200 + 400, n) - i * 200 >= 100',
    "segment_bounds_check": f"WITH {_S}, k AS (SELECT sha, CAST(round(max(source_duration_seconds) * 16000) AS BIGINT) AS n, count(DISTINCT segment_index) AS listed FROM s WHERE sha IS NOT NULL AND source_duration_seconds IS NOT NULL GROUP BY 1), f AS (SELECT *, {_FULL.format(w=64000, h=32000)} AS f FROM k), d AS (SELECT *, f + CASE WHEN f * 32000 < n AND n > (CASE WHEN f > 0 THEN (f - 1) * 32000 + 64000 ELSE 0 END) AND n - f * 32000 >= 4000 THEN 1 ELSE 0 END AS due FROM f) SELECT sha, listed, due FROM d WHERE listed <> due",
    "validation_report": f"WITH {_V} SELECT * FROM v",
    "validation_totals": f"WITH {_V} SELECT count(*) AS n, count(*) FILTER (issues = 'PASS') AS passed, count(*) FILTER (issues = 'too short') AS too_short, count(*) FILTER (issues = 'too long') AS too_long, count(*) FILTER (issues LIKE '%missing%') AS missing, round(100 * avg(CAST(issues = 'PASS' AS INT)), 6) AS pass_percent FROM v",
    "pass_rate": f"WITH {_V} SELECT source_dataset, round(100 * avg(CAST(issues = 'PASS' AS INT)), 6) AS pass_percent FROM v GROUP BY 1",
    "mean_duration": "SELECT source_dataset, round(avg(source_duration_seconds), 2) AS mean_seconds FROM train_segments GROUP BY 1",
    "shard_assignment": f"WITH {_S}, n AS (SELECT row_seq, split, row_number() OVER (PARTITION BY split ORDER BY row_seq) - 1 AS p FROM s WHERE split IS NOT NULL) SELECT row_seq, split, CAST(p // 256 AS INT) AS shard_no, CAST(p % 256 AS INT) AS slot FROM n",
    "shard_verification": f"WITH {_H} SELECT shard, count(*) AS samples, count(*) FILTER (binary_label = 1) AS drone, count(*) FILTER (binary_label IS NULL OR binary_label NOT IN (0, 1)) AS bad_labels, count(*) FILTER (segment IS NULL) AS missing_ids, count(segment) - count(DISTINCT segment) AS repeated_ids, count(*) FILTER (shard_index IS NULL) AS missing_slots, count(*) FILTER (shard_index < 0 OR shard_index > 255) AS slots_outside FROM h WHERE shard IS NOT NULL GROUP BY 1",
    "shard_id_differences": f"WITH {_S}, {_H} SELECT segment, 'shards' AS only_in FROM (SELECT segment FROM h WHERE segment IS NOT NULL EXCEPT SELECT segment FROM s) UNION ALL SELECT segment, 'segments' FROM (SELECT segment FROM s WHERE segment IS NOT NULL EXCEPT SELECT segment FROM h)",
    "feature_reconciliation": f"WITH {_H}, f AS (SELECT DISTINCT ON (k) {sql.segment_key('segment_id')} AS k, binary_label AS b, {sql.sha_key('source_sha256')} AS x, {sql.group_key('recording_group_id')} AS g FROM train_feature_manifest WHERE {sql.segment_key('segment_id')} IS NOT NULL ORDER BY k, row_seq) SELECT split, count(*) AS n_rows, count(*) FILTER (k IS NULL) AS unknown, count(*) FILTER (k IS NOT NULL AND binary_label IS DISTINCT FROM b) AS label_differs, count(*) FILTER (k IS NOT NULL AND sha IS DISTINCT FROM x) AS sha_differs, count(*) FILTER (k IS NOT NULL AND recording_group IS DISTINCT FROM g) AS group_differs FROM h LEFT JOIN f ON h.segment = f.k WHERE segment IS NOT NULL GROUP BY 1",
    "features_to_build": f"WITH {_S} SELECT segment FROM s WHERE segment IS NOT NULL EXCEPT SELECT {sql.segment_key('segment_id')} FROM train_feature_manifest WHERE status IN ('success', 'skipped')",
    "group_id_derive": f"""SELECT row_seq, dataset || ':' || CASE dataset WHEN 'al_emadi' THEN relative_path WHEN 'uavirbase' THEN {{p}} WHEN 'ddl' THEN CASE WHEN {{p}} IN ('', '.') THEN {{s}} ELSE {{p}} END ELSE coalesce(nullif(regexp_replace({{s}}, '_\\d+_?$', ''), ''), {{s}}) END AS derived_group FROM combined_manifest""".format(p="CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '.' END", s=_STEM.format(c="file_name")),
    "filename_parse_ddl": f"""WITH n AS (SELECT row_seq, {_STEM.format(c=_BASE.replace('relative_path', 'file_name'))} AS t FROM combined_manifest WHERE dataset = 'ddl') SELECT row_seq, CASE upper({_part(_DDL, 2)}) WHEN 'XXXX' THEN 0 ELSE 1 END AS binary_label, CASE upper({_part(_DDL, 2)}) WHEN 'MINI' THEN 'DJI Mini 2' WHEN 'PRO4' THEN 'DJI Phantom 4 Pro' ELSE 'unknown' END AS drone_type, CAST({_part(_DDL, 3)} AS DOUBLE) AS azimuth_deg, CAST({_part(_DDL, 4)} AS DOUBLE) AS distance_m, CAST({_part(_DDL, 5)} AS DOUBLE) AS height_m, round(CAST({_part(_DDL, 6)} AS DOUBLE) / 10 - 273.15, 6) AS temperature_c, try_strptime({_part(_DDL, 1)}, '%Y%m%d%H%M%S') AS recording_start,
'ddl:filename_metadata:sample_type=' || upper({_part(_DDL, 7)}) || ':flight=' || {_part(_DDL, 8)} || ':recording=' || {_part(_DDL, 9)} || ':sequence=' || right(t, 6) AS label_origin FROM n WHERE regexp_matches(t, '{_DDL}')""",
    "filename_parse_kaist": f"""WITH n AS (SELECT row_seq, regexp_replace(regexp_replace({_STEM.format(c='file_name')}, '_\\d+$', ''), '(?i)[_-](?:mic[12]|ch[12])$', '') AS t FROM combined_manifest WHERE dataset = 'kaist') SELECT row_seq, 1 AS binary_label, upper({_part(_KAIST, 1)}) AS drone_type, upper({_part(_KAIST, 2)}) AS movement, CASE WHEN upper({_part(_KAIST, 2)}) IN ('C', 'CC') THEN upper({_part(_KAIST, 2)}) ELSE '' END AS rotation, upper({_part(_KAIST, 3)}) AS fault, {_part(_KAIST, 4)} AS drone_index, {_part(_KAIST, 5)} AS background, {_part(_KAIST, 6)} AS background_index, CAST({_part(_KAIST, 7)} AS DOUBLE) AS snr_db FROM n WHERE regexp_matches(t, '{_KAIST}')""",
    "path_parts": f"SELECT row_seq, {_BASE} AS base, {_STEM.format(c=_BASE)} AS stem, lower(regexp_extract({_BASE}, '.(\\.[^.]*)$', 1)) AS suffix, CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '.' END AS parent, regexp_matches(relative_path, '(^|/)\\.\\.(/|$)') OR starts_with(relative_path, '/') AS leaves_root FROM combined_manifest",
    "segment_id_parts": """WITH t AS (SELECT row_seq, trim(segment_id) AS x FROM train_shard_manifest WHERE segment_id IS NOT NULL) SELECT row_seq, CASE WHEN contains(x, ':') THEN regexp_extract(x, '(?s)^(.*):([^:]*)$', 1) ELSE x END AS recording, CASE WHEN contains(x, ':') THEN regexp_extract(x, '(?s)^(.*):([^:]*)$', 2) ELSE '' END AS number, CASE WHEN regexp_matches(x, '^(.*\\S.*):(\\d+)$') THEN regexp_extract(x, '^(.*):(\\d+)$', 1) ELSE x END AS inferred, CASE WHEN x = '' THEN 'empty_segment_id' WHEN regexp_matches(x, '^(.*\\S.*):(\\d+)$') THEN 'segment_id_hash_without_index' ELSE 'full_segment_id_fallback' END AS method, replace(x, ':', '_') AS file_name FROM t""",
    "json_label_parse": """WITH a AS MATERIALIZED (SELECT label_id, relative_path, ltrim(label, chr(65279)) AS x FROM uavirbase_labels WHERE label <> ''), b AS MATERIALIZED (SELECT label_id, relative_path, CASE WHEN json_type(x) = 'VARCHAR' THEN ltrim(json_extract_string(x, '$'), chr(65279)) ELSE x END AS x FROM a WHERE json_valid(x)),
j AS MATERIALIZED (SELECT * FROM b WHERE json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x END) = 'OBJECT'), r AS (SELECT label_id, CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '.' END AS recording, CASE WHEN lower(trim(json_extract_string(x, '$.drone.sound_source'))) = 'drone' THEN 1 WHEN lower(trim(json_extract_string(x, '$.drone.sound_source'))) IN ('ambient noise', 'ambient', 'background') THEN 0 END AS binary_label,
try_cast(nullif(regexp_extract(json_extract_string(x, '$.drone.distance'), '[0-9.-]+'), '') AS DOUBLE) AS distance_m, try_cast(nullif(regexp_extract(json_extract_string(x, '$.drone.height'), '[0-9.-]+'), '') AS DOUBLE) AS height_m, try_cast(nullif(regexp_extract(json_extract_string(x, '$.microphone_array.center_latitude'), '[0-9.-]+'), '') AS DOUBLE) AS latitude FROM j) SELECT * FROM r WHERE binary_label IS NOT NULL""",
    "background_manifest": "SELECT row_seq, dataset, CASE WHEN dataset = 'esc50' THEN 'wav_files/' || trim(file_name) ELSE 'fold' || trim(fold) || '/' || trim(file_name) END AS relative_path, trim(file_name) AS file_name, 0 AS binary_label, 'official_metadata:no_drone' AS label_origin, category AS source_category, trim(fold) AS source_fold, dataset || ':' || source_id AS recording_group_id FROM background_annotations",
    "canonical_union": "SELECT dataset, binary_label, label_origin, count(*) AS n_rows FROM (SELECT dataset, binary_label, label_origin FROM combined_manifest WHERE binary_label = 1 UNION ALL SELECT dataset, 0, 'official_metadata:no_drone' FROM background_annotations) GROUP BY 1, 2, 3",
}
