"""Queries of the general data problems 1, 2, 4 and 5 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import keys
from sonarmill.operators import compaction, eager, references, shredding
from sonarmill.plans import oracle_keys as sql
from sonarmill.session import read_table, written

HEAVY_SHARE = 0.02


# problem 1: nested labels

def _shredded(spark: SparkSession, d: str) -> DataFrame:
    """The node table, written once below the checkpoint folder: each join reads only the names and kinds that it needs."""
    return written(shredding.shred(read_table(spark, d, "uavirbase_labels"), "label_id", "label"))


def _label_objects(nodes: DataFrame) -> dict[str, DataFrame]:
    top = shredding.roots(nodes)
    microphones = shredding.children(nodes, shredding.children(nodes, top, "microphone_array"), "microphones")
    return {
        "weather_measurement": shredding.children(nodes, shredding.children(nodes, top, "weather_data"), "measurements"),
        "label_measurement": shredding.children(nodes, top, "measurements"),
        "microphone": microphones,
        "calibration": shredding.children(nodes, microphones, "calibrations"),
    }


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for child, objects in _label_objects(_shredded(spark, d)).items():
        above = F.col("parent_pos") if child == "calibration" else F.lit(-1)
        rows = objects.select(F.col("id").alias("label_id"), F.lit(child).alias("child"), above.cast("int").alias("parent_pos"), F.col("pos").cast("int").alias("pos"))
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates()


_WEATHER = {"air_temperature": ("air_temperature",), "air_humidity": ("air_humidity",), "wind_speed": ("wind_speed",), "wind_direction": ("wind_direction",), "sensor_model": ("sensor", "model"), "sensor_mast_m": ("sensor", "position", "mast_m"), "sensor_side": ("sensor", "position", "side")}
_MICROPHONE = {"channel": ("channel",), "model": ("model",), "offset_x": ("offset", "x"), "offset_y": ("offset", "y")}
_LABEL = {"sound_source": ("drone", "sound_source"), "drone_type": ("drone", "type"), "movement": ("drone", "movement"), "rotation": ("drone", "rotation"), "distance": ("drone", "distance"), "height": ("drone", "height"), "azimuth": ("drone", "azimuth"), "started": ("start_recording_time",), "ended": ("end_recording_time",), "latitude": ("microphone_array", "center_latitude"), "longitude": ("microphone_array", "center_longitude"), "station": ("weather_data", "station", "code")}


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    nodes = _shredded(spark, d)
    return shredding.entity(nodes, shredding.roots(nodes), _LABEL).withColumnRenamed("id", "label_id").drop("node", "pos")


def p1_weather(spark: SparkSession, d: str) -> DataFrame:
    nodes = _shredded(spark, d)
    objects = _label_objects(nodes)
    both = objects["weather_measurement"].withColumn("child", F.lit("weather_measurement")).unionByName(objects["label_measurement"].withColumn("child", F.lit("label_measurement")))
    return shredding.entity(nodes, both, _WEATHER).withColumnRenamed("id", "label_id").drop("parent_pos")


def p1_microphones(spark: SparkSession, d: str) -> DataFrame:
    nodes = _shredded(spark, d)
    return shredding.entity(nodes, _label_objects(nodes)["microphone"], _MICROPHONE).withColumnRenamed("id", "label_id").drop("parent_pos")


def p1_calibrations(spark: SparkSession, d: str) -> DataFrame:
    nodes = _shredded(spark, d)
    return shredding.entity(nodes, _label_objects(nodes)["calibration"], {"at": ("at",), "gain_db": ("gain_db",)}).withColumnRenamed("id", "label_id")


# problem 2: keys that hold most rows

def _joined_states(spark: SparkSession, d: str, table: str) -> tuple[DataFrame, DataFrame]:
    """The table itself and its key states joined with those of the table that shares the key."""
    if table == "combined_manifest":
        own, other = read_table(spark, d, table), read_table(spark, d, "train_shard_manifest")
        left = eager.key_states(own, keys.group_key("recording_group_id"), F.col("dataset"), F.col("listed_at"), {"bytes": F.col("size_bytes")})
        right = eager.key_states(other, keys.group_key("recording_group_id"), F.col("source_dataset"), F.col("packed_at"))
    else:
        own, other = read_table(spark, d, table), read_table(spark, d, "train_segments")
        left = eager.key_states(own, keys.segment_key("segment_id"), F.col("source_dataset"), F.col("packed_at"))
        right = eager.key_states(other, keys.segment_key("segment_id"), F.col("source_dataset"), F.col("written_at"), {"samples": F.col("end_sample") - F.col("start_sample")})
    return own, eager.join_states(left, right)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = []
    for table in ("combined_manifest", "train_shard_manifest"):
        own, joined = _joined_states(spark, d, table)
        found.append(eager.heavy_keys(joined, own, HEAVY_SHARE).select(F.lit(table).alias("table_name"), "key_value"))
    return found[0].unionByName(found[1])


_STATE = ["key_value", "n_rows", "n_sources", "first_at", "last_at", "other_n_rows"]


def p2_group_results(spark: SparkSession, d: str) -> DataFrame:
    joined = _joined_states(spark, d, "combined_manifest")[1]
    return joined.select(*_STATE, F.col("joined_rows").cast("bigint").alias("joined_rows"), eager.joined_sum("bytes").cast("double").alias("joined_bytes"))


def p2_segment_results(spark: SparkSession, d: str) -> DataFrame:
    joined = _joined_states(spark, d, "train_shard_manifest")[1]
    return joined.select(*_STATE, F.col("joined_rows").cast("bigint").alias("joined_rows"), eager.joined_sum("samples", of_left=False).cast("double").alias("joined_samples"))


def p2_dataset_rollup(spark: SparkSession, d: str) -> DataFrame:
    joined = _joined_states(spark, d, "combined_manifest")[1]
    return eager.roll_up(joined, F.substring_index("key_value", ":", 1))


# problem 4: far too many small files

def _shard_records(spark: SparkSession, d: str) -> DataFrame:
    return compaction.records(read_table(spark, d, "train_shard_manifest"), keys.path_key("shard_path"), F.col("shard_index"), keys.segment_key("segment_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the files, out of the inventory that the plan is made from."""
    wrong = compaction.audit(compaction.slots(_shard_records(spark, d)))
    item = F.concat_ws("#", "file", F.col("slot").cast("string"))
    repeated = compaction.repeated_files(read_table(spark, d, "train_feature_manifest"), keys.path_key("mfcc_path"))
    return wrong.select("kind", item.alias("item")).unionByName(repeated.select(F.lit("repeated_file").alias("kind"), F.col("file").alias("item")))


def _feature_records(spark: SparkSession, d: str) -> DataFrame:
    """The tiny feature files, each the one record it holds, however many rows name it."""
    files = read_table(spark, d, "train_feature_manifest").select(keys.path_key("mfcc_path").alias("path")).distinct()
    return compaction.records(files, F.col("path"), F.lit(0), F.col("path"))


#: The tables that name small files, with the records in them.
_SMALL_FILES = {"train_feature_manifest": _feature_records, "train_shard_manifest": _shard_records}


def _file_plan(rows: DataFrame) -> DataFrame:
    files = compaction.file_sizes(compaction.inventory(compaction.slots(rows)))
    return compaction.plan(files.withColumn("part", F.regexp_extract("file", "^(.*)/", 1)), part="part")


def p4_journal(spark: SparkSession, d: str) -> DataFrame:
    """The transactions that merge the feature files and those that merge the shards."""
    parts = [compaction.journal(_file_plan(records(spark, d))).select(F.lit(table).alias("table_name"), "*") for table, records in _SMALL_FILES.items()]
    return parts[0].unionByName(parts[1])


def p4_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Each record's place after compaction; the record is the path of a feature file and the segment of a shard's slot."""
    parts = []
    for table, records in _SMALL_FILES.items():
        rows = records(spark, d)
        parts.append(compaction.relocate(rows, _file_plan(rows)).select(F.lit(table).alias("table_name"), "*"))
    return parts[0].unionByName(parts[1])


def p4_unplaced(spark: SparkSession, d: str) -> DataFrame:
    """Of each table, how many rows name no file or slot and so have no place in the compacted result."""
    features = compaction.records(read_table(spark, d, "train_feature_manifest"), keys.path_key("mfcc_path"), F.lit(0), keys.segment_key("segment_id"))
    parts = [compaction.unplaced(rows).where("n_rows > 0").select(F.lit(table).alias("table_name"), "n_rows") for table, rows in (("train_feature_manifest", features), ("train_shard_manifest", _shard_records(spark, d)))]
    return parts[0].unionByName(parts[1])


# problem 5: references to files that are not there

_FOLD = "^raw/urbansound8k/fold([^/]*)/"


def _audio_parts(path) -> list:
    """A background file's path as a composite key (dataset, fold, rest); esc50 has no fold."""
    return [F.regexp_extract(path, "^raw/(esc50|urbansound8k)/", 1), F.when(path.rlike(_FOLD), F.regexp_extract(path, _FOLD, 1)), F.regexp_extract(path, "^raw/(?:esc50/wav_files|urbansound8k/fold[^/]*)/(.+)$", 1)]


def _orphans(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    stored = read_table(spark, d, "stored_files").select(keys.path_key("file_path").alias("path"), "stored_at", "deleted_at")
    files = references.targets(stored, [F.col("path")], F.col("stored_at"), F.col("deleted_at"))
    out = {}
    for table, path, at in (("train_segments", "processed_relative_path", "written_at"), ("train_shard_manifest", "shard_path", "packed_at")):
        rows = references.references(read_table(spark, d, table), F.col("row_seq"), [keys.path_key(path)], F.col(at))
        out[table] = references.orphans(rows, files)
    audio = references.targets(stored.where(F.col("path").startswith("raw/")), _audio_parts(F.col("path")), F.col("stored_at"), F.col("deleted_at"))
    home = F.lower(keys.strip("dataset"))
    named = F.when(home == "esc50", F.concat(F.lit("raw/esc50/wav_files/"), keys.filled(keys.strip("file_name")))).when(home == "urbansound8k", F.concat(F.lit("raw/urbansound8k/fold"), keys.filled(keys.strip("fold")), F.lit("/"), keys.filled(keys.strip("file_name"))))
    listed = read_table(spark, d, "background_annotations").select("row_seq", "run_id", "listed_at", keys.path_key(named).alias("path"))
    rows = references.references(listed, F.struct("row_seq", "run_id"), _audio_parts(F.col("path")), F.col("listed_at"))
    # an esc50 file has no fold: its mask must match on what is there
    out["background_annotations"] = references.orphans(rows, audio, rules={(False, True, False): "partial"})
    return out


def _wrong_summaries(spark: SparkSession, d: str, audio: DataFrame) -> DataFrame:
    """Runs that state another number of missing files than there are; audio: ``run_id`` of each orphan annotation."""
    stated = read_table(spark, d, "background_manifest_summary").select("run_id", "created_at_utc", "missing_audio_files").where("missing_audio_files IS NOT NULL")
    counted = audio.groupBy("run_id").agg(F.count("*").alias("n"))
    return stated.join(counted, "run_id", "left").where(F.col("missing_audio_files") != F.coalesce("n", F.lit(0)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = _orphans(spark, d)
    audio = found["background_annotations"].select("row_key.row_seq", "row_key.run_id")
    out = audio.select(F.lit("background_annotations").alias("table_name"), F.col("row_seq").alias("row_key"))
    for table in ("train_segments", "train_shard_manifest"):
        out = out.unionByName(found[table].select(F.lit(table).alias("table_name"), "row_key"))
    return out.unionByName(_wrong_summaries(spark, d, audio).select(F.lit("background_manifest_summary").alias("table_name"), F.col("run_id").alias("row_key")))


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    found = _orphans(spark, d)
    parts = [references.by_period(rows.select("at"), table) for table, rows in found.items()]
    wrong = _wrong_summaries(spark, d, found["background_annotations"].select("row_key.run_id"))
    parts.append(references.by_period(wrong.select(F.col("created_at_utc").alias("at")), "background_manifest_summary"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("table_name", F.date_format("period", "yyyy-MM").alias("month"), "orphans")


QUERIES = {f.__name__: f for f in (p1_found, p1_labels, p1_weather, p1_microphones, p1_calibrations, p2_found, p2_group_results, p2_segment_results, p2_dataset_rollup, p4_found, p4_journal, p4_compacted, p4_unplaced, p5_found, p5_by_month)}

# oracle SQL


def _states_sql(name: str, table: str, key: str, source: str, at: str, more: str = "") -> str:
    return f"{name} AS (SELECT {key} AS key_value, count(*) AS n_rows, count(DISTINCT {source}) AS n_sources, min({at}) AS first_at, max({at}) AS last_at{more} FROM {table} WHERE {key} IS NOT NULL GROUP BY 1)"


_GROUP, _SEGMENT = sql.group_key("recording_group_id"), sql.segment_key("segment_id")
_GROUP_STATES = "WITH " + _states_sql("l", "combined_manifest", _GROUP, "dataset", "listed_at", ", sum(size_bytes) AS bytes") + ", " + _states_sql("r", "train_shard_manifest", _GROUP, "source_dataset", "packed_at") + ", j AS (SELECT coalesce(l.key_value, r.key_value) AS key_value, coalesce(l.n_rows, 0) AS n_rows, l.n_sources, l.first_at, l.last_at, coalesce(r.n_rows, 0) AS other_n_rows, l.bytes FROM l FULL JOIN r ON l.key_value = r.key_value) "
_SEGMENT_STATES = "WITH " + _states_sql("l", "train_shard_manifest", _SEGMENT, "source_dataset", "packed_at") + ", " + _states_sql("r", "train_segments", _SEGMENT, "source_dataset", "written_at", ", sum(end_sample - start_sample) AS samples") + ", j AS (SELECT coalesce(l.key_value, r.key_value) AS key_value, coalesce(l.n_rows, 0) AS n_rows, l.n_sources, l.first_at, l.last_at, coalesce(r.n_rows, 0) AS other_n_rows, r.samples FROM l FULL JOIN r ON l.key_value = r.key_value) "
_PATH_SHARD = f"shards AS (SELECT {sql.path_key('shard_path')} AS p, shard_index AS i, {_SEGMENT} AS s FROM train_shard_manifest), held AS (SELECT * FROM shards WHERE p IS NOT NULL AND i IS NOT NULL)"
_THERE = "NOT EXISTS (SELECT 1 FROM st WHERE st.p = x.p AND st.stored_at <= x.t AND (st.deleted_at IS NULL OR st.deleted_at > x.t))"
_ORPHANS_SQL = f"""WITH st AS (SELECT {sql.path_key('file_path')} AS p, stored_at, deleted_at FROM stored_files),
ann AS (SELECT row_seq, run_id, listed_at AS t, CASE {'lower(' + sql.strip('dataset') + ')'} WHEN 'esc50' THEN 'raw/esc50/wav_files/' || {sql.strip('file_name')} WHEN 'urbansound8k' THEN 'raw/urbansound8k/fold' || {sql.strip('fold')} || '/' || {sql.strip('file_name')} END AS p FROM background_annotations),
x AS (SELECT 'train_segments' AS table_name, row_seq AS row_key, {sql.path_key('processed_relative_path')} AS p, written_at AS t, NULL AS run_id FROM train_segments
UNION ALL SELECT 'train_shard_manifest', row_seq, {sql.path_key('shard_path')}, packed_at, NULL FROM train_shard_manifest
UNION ALL SELECT 'background_annotations', row_seq, p, t, run_id FROM ann),
o AS (SELECT * FROM x WHERE p IS NOT NULL AND t IS NOT NULL AND {_THERE})"""

_NAME = "replace(replace(lower({0}), ' ', '_'), '-', '_')".format(sql.strip("m.key"))


def _children_sql(parents: str, name: str, above: str = "-1") -> str:
    return f"""SELECT s.label_id, {above} AS parent_pos, 0 AS pos, m.value AS v FROM {parents} s, json_each(s.v) m WHERE {_NAME} = '{name}' AND m.type = 'OBJECT'
UNION ALL SELECT s.label_id, {above}, CAST(e.key AS INT), e.value FROM {parents} s, json_each(s.v) m, json_each(m.value) e WHERE {_NAME} = '{name}' AND m.type = 'ARRAY' AND e.type = 'OBJECT'"""


_LABEL_TEXTS = """a AS MATERIALIZED (SELECT label_id, ltrim(label, chr(65279)) AS x FROM uavirbase_labels WHERE label IS NOT NULL AND label <> ''),
b AS MATERIALIZED (SELECT label_id, CASE WHEN json_type(x) = 'VARCHAR' THEN ltrim(json_extract_string(x, '$'), chr(65279)) ELSE x END AS x FROM a WHERE json_valid(x)),
t AS MATERIALIZED (SELECT label_id, x::JSON AS v, -1 AS pos FROM b WHERE json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x END) = 'OBJECT')"""

_PLAN_SQL = f"""WITH RECURSIVE features AS (SELECT DISTINCT {sql.path_key('mfcc_path')} AS p FROM train_feature_manifest),
rec AS MATERIALIZED (SELECT 'train_feature_manifest' AS tab, p AS file, 0 AS slot, p AS record FROM features WHERE p IS NOT NULL
UNION ALL SELECT DISTINCT 'train_shard_manifest', {sql.path_key('shard_path')}, shard_index, {_SEGMENT} FROM train_shard_manifest WHERE {sql.path_key('shard_path')} IS NOT NULL AND shard_index IS NOT NULL),
files AS (SELECT tab, file, count(*) AS n, regexp_extract(file, '^(.*)/', 1) AS part FROM rec GROUP BY 1, 2),
small AS (SELECT *, CAST(floor(log2(n)) AS INT) AS tier FROM files WHERE n * 2 < 256),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tab, part, tier ORDER BY md5(file), file) - 1 AS r, 256 // max(n) OVER (PARTITION BY tab, tier) AS due FROM small),
packs AS (SELECT *, count(*) OVER (PARTITION BY tab, part, tier, r // due) AS inputs FROM ranked),
lone AS MATERIALIZED (SELECT tab, part, file, n, row_number() OVER (PARTITION BY tab, part ORDER BY n, file) AS i FROM packs WHERE inputs < due),
fit AS (SELECT tab, part, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS file, CAST(0 AS BIGINT) AS n, 0 AS pack, CAST(0 AS BIGINT) AS fill FROM (SELECT DISTINCT tab, part FROM lone)
UNION ALL SELECT l.tab, l.part, l.i, l.file, l.n, CASE WHEN f.fill + l.n > 256 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.fill + l.n > 256 THEN l.n ELSE f.fill + l.n END FROM fit f JOIN lone l ON l.tab = f.tab AND l.part = f.part AND l.i = f.i + 1),
grouped AS (SELECT tab, part, file, n, tier AS level, 't' || tier || '.' || (r // due) AS pack FROM packs WHERE inputs = due
UNION ALL SELECT tab, part, file, n, 8, 'r' || pack FROM fit WHERE i > 0),
merged AS (SELECT tab, part, file, n, level, count(*) OVER p AS inputs, sum(n) OVER p AS total, min(file) OVER p AS first, sum(n) OVER (PARTITION BY tab, part, level, pack ORDER BY file) - n AS start FROM grouped WINDOW p AS (PARTITION BY tab, part, level, pack)),
txn AS MATERIALIZED (SELECT *, sha256(level || '|' || part || '|' || first || '|' || CAST(total AS BIGINT) || '|' || inputs) AS id FROM merged WHERE inputs > 1)"""

ORACLE = {
    "p1_found": f"""WITH {_LABEL_TEXTS}, w AS ({_children_sql('t', 'weather_data')}), wm AS ({_children_sql('w', 'measurements')}), lm AS ({_children_sql('t', 'measurements')}),
ma AS ({_children_sql('t', 'microphone_array')}), mi AS ({_children_sql('ma', 'microphones')}), ca AS ({_children_sql('mi', 'calibrations', 's.pos')})
SELECT DISTINCT label_id, child, CAST(parent_pos AS INT) AS parent_pos, CAST(pos AS INT) AS pos FROM (SELECT label_id, 'weather_measurement' AS child, parent_pos, pos FROM wm UNION ALL SELECT label_id, 'label_measurement', parent_pos, pos FROM lm UNION ALL SELECT label_id, 'microphone', parent_pos, pos FROM mi UNION ALL SELECT label_id, 'calibration', parent_pos, pos FROM ca)""",
    "p2_found": f"""SELECT 'combined_manifest' AS table_name, {_GROUP} AS key_value FROM combined_manifest WHERE {_GROUP} IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM combined_manifest)
UNION ALL SELECT 'train_shard_manifest', {_SEGMENT} FROM train_shard_manifest WHERE {_SEGMENT} IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM train_shard_manifest)""",
    "p2_group_results": _GROUP_STATES + "SELECT key_value, n_rows, n_sources, first_at, last_at, other_n_rows, n_rows * other_n_rows AS joined_rows, CAST(bytes * other_n_rows AS DOUBLE) AS joined_bytes FROM j",
    "p2_segment_results": _SEGMENT_STATES + "SELECT key_value, n_rows, n_sources, first_at, last_at, other_n_rows, n_rows * other_n_rows AS joined_rows, CAST(samples * n_rows AS DOUBLE) AS joined_samples FROM j",
    "p2_dataset_rollup": _GROUP_STATES + "SELECT split_part(key_value, ':', 1) AS part, count(*) AS keys, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(other_n_rows) AS BIGINT) AS other_rows, CAST(sum(n_rows * other_n_rows) AS DOUBLE) AS joined_rows, max(n_rows) AS largest_key_rows FROM j GROUP BY 1",
    "p4_found": f"""WITH {_PATH_SHARD}, ends AS (SELECT p, max(i) AS top, count(DISTINCT i) AS n FROM held GROUP BY p),
mf AS (SELECT {sql.path_key('mfcc_path')} AS p FROM train_feature_manifest)
SELECT 'small_shard' AS kind, p AS item FROM ends WHERE n < 64
UNION ALL SELECT 'lost_index', e.p || '#' || e.i FROM (SELECT p, unnest(range(0, top + 1)) AS i FROM ends) e ANTI JOIN held h ON h.p = e.p AND h.i = e.i
UNION ALL SELECT 'taken_twice', p || '#' || i FROM held GROUP BY p, i HAVING count(DISTINCT s) > 1
UNION ALL SELECT 'repeated_file', p FROM mf WHERE p IS NOT NULL GROUP BY p HAVING count(*) > 1""",
    "p4_journal": _PLAN_SQL + """ SELECT tab AS table_name, id AS txn_id, CAST(any_value(level) AS INT) AS level, any_value(part) AS part, count(*) AS n_inputs, CAST(sum(n) AS BIGINT) AS n_records, sha256(string_agg(file, '|' ORDER BY file)) AS inputs_digest FROM txn GROUP BY 1, 2""",
    "p4_compacted": _PLAN_SQL + """ SELECT rec.tab AS table_name, record, rec.file, slot, coalesce(id, rec.file) AS new_file, CAST(coalesce(start, 0) + row_number() OVER (PARTITION BY rec.tab, rec.file ORDER BY slot, record NULLS FIRST) - 1 AS BIGINT) AS new_slot FROM rec LEFT JOIN txn ON txn.tab = rec.tab AND txn.file = rec.file""",
    "p4_unplaced": f"""SELECT 'train_feature_manifest' AS table_name, count(*) AS n_rows FROM train_feature_manifest WHERE {sql.path_key('mfcc_path')} IS NULL HAVING count(*) > 0
UNION ALL SELECT 'train_shard_manifest', count(*) FROM train_shard_manifest WHERE {sql.path_key('shard_path')} IS NULL OR shard_index IS NULL HAVING count(*) > 0""",
    "p5_found": _ORPHANS_SQL + """ SELECT table_name, row_key FROM o
UNION ALL SELECT 'background_manifest_summary', s.run_id FROM background_manifest_summary s WHERE missing_audio_files IS NOT NULL AND missing_audio_files <> (SELECT count(*) FROM o WHERE o.table_name = 'background_annotations' AND o.run_id = s.run_id)""",
    "p5_by_month": _ORPHANS_SQL + """ SELECT table_name, strftime(t, '%Y-%m') AS month, count(*) AS orphans FROM o GROUP BY 1, 2
UNION ALL SELECT 'background_manifest_summary', strftime(created_at_utc, '%Y-%m'), count(*) FROM background_manifest_summary s WHERE missing_audio_files IS NOT NULL AND missing_audio_files <> (SELECT count(*) FROM o WHERE o.table_name = 'background_annotations' AND o.run_id = s.run_id) GROUP BY 2""",
}
