"""Diagnostics over scored segments: the score of a segment is drawn from the digest of its id, a detection is 0.5 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import keys, parsing
from sonarmill.operators import diagnostics as dg
from sonarmill.operators import sampling
from sonarmill.plans import oracle_keys as sql
from sonarmill.session import read_table

TARGETS = 5


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "train_segments").select("row_seq", keys.split_name("split").alias("split"), keys.segment_key("segment_id").alias("segment"), "binary_label", "source_dataset")
    score = F.conv(F.substring(F.sha2("segment", 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    parts = parsing.inferred_recording(F.col("segment"))
    number = F.coalesce(F.regexp_extract("segment", ":(\\d+)$", 1).try_cast("int"), F.lit(-1))
    return rows.where("segment IS NOT NULL").select("*", score.alias("score"), parts["recording"].alias("recording"), parts["method"].alias("method"), number.alias("number"))


def errors(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("score") >= 0.5
    kind = F.when(hit & (F.col("binary_label") == 0), "FP").when(~hit & (F.col("binary_label") == 1), "FN")
    return scored(spark, d).withColumn("kind", kind).where("kind IS NOT NULL")


_A = f"a AS (SELECT row_seq, {sql.split_name('split')} AS split, {sql.segment_key('segment_id')} AS segment, binary_label, source_dataset FROM train_segments WHERE {sql.segment_key('segment_id')} IS NOT NULL), s AS (SELECT *, ('0x' || left(sha256(segment), 8))::BIGINT / 4294967296.0::DOUBLE AS score, CASE WHEN regexp_matches(segment, ':\\d+$') THEN regexp_extract(segment, '^(.*):(\\d+)$', 1) ELSE segment END AS recording, CASE WHEN regexp_matches(segment, ':\\d+$') THEN 'segment_id_hash_without_index' ELSE 'full_segment_id_fallback' END AS method, coalesce(try_cast(nullif(regexp_extract(segment, ':(\\d+)$', 1), '') AS INT), -1) AS number FROM a)"
_E = _A + ", e AS (SELECT *, CASE WHEN score >= 0.5 AND binary_label = 0 THEN 'FP' WHEN score < 0.5 AND binary_label = 1 THEN 'FN' END AS kind FROM s WHERE (score >= 0.5 AND binary_label = 0) OR (score < 0.5 AND binary_label = 1))"


def error_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Each error with its place in the shards, the first one listed."""
    shards = dg.first_match(read_table(spark, d, "train_shard_manifest").select(keys.segment_key("segment_id").alias("segment"), keys.path_key("shard_path").alias("shard"), "shard_index", F.col("row_seq").alias("manifest_row")), "segment", "manifest_row")
    return errors(spark, d).join(shards, "segment", "left").select("row_seq", "segment", "kind", "shard", "shard_index", "manifest_row")


def error_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return dg.error_counts(errors(spark, d), ["recording"])


def error_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return dg.error_counts(errors(spark, d), ["source_dataset"])


def error_recording_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Errors per recording; the smallest and largest segment number also as text, in the order of text."""
    text = F.col("number").cast("string")
    return errors(spark, d).groupBy("recording", "kind").agg(F.count("*").alias("n"), F.min(text).alias("first_text"), F.max(text).alias("last_text"), F.min("number").alias("first_number"), F.max("number").alias("last_number"))


def error_union_tagged(spark: SparkSession, d: str) -> DataFrame:
    rows = errors(spark, d)
    false = rows.where("kind = 'FP'").select("segment", F.lit("false_positive").alias("error"))
    return false.unionByName(rows.where("kind = 'FN'").select("segment", F.lit("false_negative").alias("error"))).groupBy("error").agg(F.count("*").alias("n"), F.countDistinct("segment").alias("n_segments"))


def error_concentration(spark: SparkSession, d: str) -> DataFrame:
    counts = errors(spark, d).groupBy("kind", "recording").agg(F.count("*").alias("n"))
    return dg.top_shares(counts, ["kind"], "recording", "n").withColumns({f"top_{k}_share": F.round(f"top_{k}_share", 9) for k in (1, 3, 5, 10)})


def error_runs(spark: SparkSession, d: str) -> DataFrame:
    return dg.runs(errors(spark, d), ["recording", "kind"], "number")


def recording_concentration(spark: SparkSession, d: str) -> DataFrame:
    out = dg.concentration(scored(spark, d), ["split", "recording"], "segment", "binary_label", "method")
    return out.withColumns({c: F.round(c, 9) for c in ("label_0_fraction", "label_1_fraction")})


def topk_share(spark: SparkSession, d: str) -> DataFrame:
    counts = scored(spark, d).where("split IS NOT NULL").groupBy("split", "recording").agg(F.count("*").alias("n"))
    return dg.top_shares(counts, ["split"], "recording", "n", (1, 5, 10)).withColumns({f"top_{k}_share": F.round(f"top_{k}_share", 9) for k in (1, 5, 10)})


def label_majority(spark: SparkSession, d: str) -> DataFrame:
    out = dg.label_majority(dg.concentration(scored(spark, d), ["recording"], "segment", "binary_label"))
    return out.select("recording", "label_0", "label_1", "majority_label", F.round("majority_fraction", 9).alias("majority_fraction"), F.round("minority_fraction", 9).alias("minority_fraction"))


def inference_quality(spark: SparkSession, d: str) -> DataFrame:
    """How recordings were inferred, per split: rows, and their part of the split's rows."""
    counts = scored(spark, d).groupBy("split", "method").agg(F.count("*").alias("n"))
    whole = counts.groupBy(F.col("split").alias("s")).agg(F.sum("n").alias("split_total"))
    joined = counts.join(whole, F.col("split").eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("fraction", F.round(F.col("n") / F.col("split_total"), 9))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    counts = errors(spark, d).where("kind = 'FP'").groupBy("recording").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "recording").limit(TARGETS)  # a top-k report


def dominant_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Which part of all false positives the leading recordings have, and whether it makes a pattern (80 % or more)."""
    false = errors(spark, d).where("kind = 'FP'")
    mine = false.join(F.broadcast(_targets(spark, d).select("recording", F.lit(1).alias("t"))), "recording", "left")  # TARGETS rows
    return mine.agg(F.count("t").alias("target_errors"), F.count("*").alias("all_errors")).select("*", F.round(100 * F.col("target_errors") / F.col("all_errors"), 6).alias("percent"), F.when(F.col("target_errors") >= 0.8 * F.col("all_errors"), "recording-specific").otherwise("broad").alias("verdict"))


def target_error_summary(spark: SparkSession, d: str) -> DataFrame:
    mine = errors(spark, d).join(F.broadcast(_targets(spark, d).select("recording")), "recording", "left_semi")
    return mine.groupBy("recording", "kind").agg(F.count("*").alias("n"), F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.round(F.max("score"), 9).alias("max_score"), F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.min("score"), 9).alias("min_score"))


def target_errors_top(spark: SparkSession, d: str) -> DataFrame:
    mine = errors(spark, d).join(F.broadcast(_targets(spark, d).select("recording")), "recording", "left_semi")
    return dg.top_per_group(mine, ["recording"], [F.desc("score"), F.col("row_seq")], 30).select("recording", "row_seq", F.round("score", 9).alias("score"), "place")


def target_paths(spark: SparkSession, d: str) -> DataFrame:
    """Stored files whose path names a leading recording."""
    ids = [r["recording"] for r in _targets(spark, d).select("recording").collect()]  # TARGETS rows
    return dg.texts_with_ids(read_table(spark, d, "stored_files").select("file_seq", "file_path"), "file_seq", "file_path", ids)


def _losses(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("binary_label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    return scored(spark, d).where("binary_label IS NOT NULL").withColumn("loss", -F.log(F.greatest(F.lit(1e-12), p)))


def hard_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 hardest segments overall and of each label."""
    rows = _losses(spark, d).select("row_seq", "segment", "binary_label", "loss")
    overall = dg.top_per_group(rows.withColumn("part", F.lit("overall")), ["part"], [F.desc("loss"), F.col("row_seq")], 20)
    each = dg.top_per_group(rows.withColumn("part", F.when(F.col("binary_label") == 1, "drone").otherwise("background")), ["part"], [F.desc("loss"), F.col("row_seq")], 20)
    return overall.unionByName(each).select("part", "place", "row_seq", "segment", F.round("loss", 9).alias("loss"))


def lineage_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Segment ids of the feature and the segment manifest, and which has them."""
    a = read_table(spark, d, "train_feature_manifest").select(keys.segment_key("segment_id").alias("segment"), "row_seq", "status").where("segment IS NOT NULL").groupBy("segment").agg(F.min_by("status", "row_seq").alias("status"), F.count("*").alias("n_features"))
    b = read_table(spark, d, "train_segments").select(keys.segment_key("segment_id").alias("segment")).where("segment IS NOT NULL").groupBy("segment").agg(F.count("*").alias("n_segments"))
    return a.join(b, "segment", "full_outer")


def feature_health(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings read as 4 channels of 16 frames."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    channels = F.array(*[F.slice(wide, 16 * i + 1, 16) for i in range(4)])
    out = read_table(spark, d, "embeddings").select("vec_id", dg.health(channels).alias("h")).select("vec_id", "h.*")
    return dg.repeated(out, "feature_hash").select("vec_id", F.round("max_abs", 6).alias("max_abs"), F.round("min_channel_std", 6).alias("min_channel_std"), "non_finite", "blow_up", "is_repeated")


def sampler_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = _losses(spark, d).select("row_seq", "binary_label", "loss")
    out = sampling.blended_weights(rows, "binary_label", "loss")
    return out.select("row_seq", F.round(F.col("balanced") * 1e6, 6).alias("balanced"), F.round(F.col("hard") * 1e6, 6).alias("hard"), F.round(F.col("probability") * 1e6, 6).alias("probability"))


def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    """As many draws as there are rows, by their blended probability."""
    rows = _losses(spark, d).select("row_seq", "binary_label", "loss")
    return sampling.draw_with_replacement(sampling.blended_weights(rows, "binary_label", "loss"), "row_seq", "probability", rows.count())


def hardness_update(spark: SparkSession, d: str) -> DataFrame:
    """Rows delivered several times, read as epochs: the hardness after the last one."""
    rows = _losses(spark, d).select("segment", "row_seq", "loss")
    out = sampling.hardness_over_epochs(rows.withColumn("epoch", F.pmod("row_seq", F.lit(7))), "segment", "epoch", "loss")
    return out.select("segment", F.round("hardness", 9).alias("hardness"))


def training_stop(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event days read as a training history: mean value as loss, share of small values as F1."""
    rows = read_table(spark, d, "events").groupBy("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("epoch")).agg(F.avg((F.col("value") < 20).cast("double")).alias("f1"), F.avg("value").alias("loss"))
    out = sampling.stopping(rows, "user_id", "epoch", "f1", "loss")
    return out.withColumn("best_f1", F.round("best_f1", 9))


_NAMES = [error_lineage, error_full_outer, error_by_dataset, error_recording_rollup, error_union_tagged, error_concentration, error_runs, recording_concentration, topk_share, label_majority, inference_quality, dominant_recordings, target_error_summary, target_errors_top, target_paths, hard_topk, lineage_full_outer, feature_health, sampler_weights, weighted_draw, hardness_update, training_stop]
QUERIES = {f.__name__: f for f in _NAMES}


def _shares(group: str, source: str, tops: tuple[int, ...]) -> str:
    each = ", ".join(f"CAST(sum(CASE WHEN place <= {k} THEN n ELSE 0 END) AS BIGINT) AS top_{k}, round(sum(CASE WHEN place <= {k} THEN n ELSE 0 END) / sum(n), 9) AS top_{k}_share" for k in tops)
    return f"r AS (SELECT {group}, recording, count(*) AS n FROM {source} GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, recording) AS place FROM r) SELECT {group}, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_keys, max(recording) FILTER (place = 1) AS largest_key, {each} FROM q GROUP BY 1"


_T = f", t AS (SELECT recording FROM e WHERE kind = 'FP' GROUP BY 1 ORDER BY count(*) DESC, recording LIMIT {TARGETS})"
_L = ", l AS (SELECT *, -ln(greatest(1e-12, CASE WHEN binary_label = 1 THEN score ELSE 1 - score END)) AS loss FROM s WHERE binary_label IS NOT NULL)"
_WEIGHTS = f"WITH {_A}{_L}, b AS (SELECT row_seq, binary_label, greatest(1e-8, loss) AS h, 1 / (count(*) OVER (PARTITION BY binary_label) * 2.0::DOUBLE) AS balanced FROM l), m AS (SELECT median(h) AS m FROM b), w AS (SELECT row_seq, balanced, pow(greatest(0.5, least(2.0, h / m)), 0.25) AS w FROM b, m), n AS (SELECT row_seq, balanced, w / sum(w) OVER () AS hard FROM w), p AS (SELECT *, 0.9::DOUBLE * balanced + (1 - 0.9::DOUBLE) * hard AS p FROM n)"

ORACLE = {
    "error_lineage": f"WITH {_E}, m AS (SELECT DISTINCT ON (segment) {sql.segment_key('segment_id')} AS segment, {sql.path_key('shard_path')} AS shard, shard_index, row_seq AS manifest_row FROM train_shard_manifest WHERE {sql.segment_key('segment_id')} IS NOT NULL ORDER BY segment, row_seq) SELECT e.row_seq, e.segment, kind, shard, shard_index, manifest_row FROM e LEFT JOIN m ON e.segment = m.segment",
    "error_full_outer": f"WITH {_E}, p AS (SELECT recording, count(*) AS n FROM e WHERE kind = 'FP' GROUP BY 1), q AS (SELECT recording, count(*) AS n FROM e WHERE kind = 'FN' GROUP BY 1) SELECT coalesce(p.recording, q.recording) AS recording, coalesce(p.n, 0) AS false_positives, coalesce(q.n, 0) AS false_negatives, coalesce(p.n, 0) + coalesce(q.n, 0) AS total_errors FROM p FULL JOIN q ON p.recording = q.recording",
    "error_by_dataset": f"WITH {_E} SELECT source_dataset, count(*) FILTER (kind = 'FP') AS false_positives, count(*) FILTER (kind = 'FN') AS false_negatives, count(*) AS total_errors FROM e GROUP BY 1",
    "error_recording_rollup": f"WITH {_E} SELECT recording, kind, count(*) AS n, min(number::VARCHAR) AS first_text, max(number::VARCHAR) AS last_text, min(number) AS first_number, max(number) AS last_number FROM e GROUP BY 1, 2",
    "error_union_tagged": f"WITH {_E} SELECT CASE kind WHEN 'FP' THEN 'false_positive' ELSE 'false_negative' END AS error, count(*) AS n, count(DISTINCT segment) AS n_segments FROM e GROUP BY 1",
    "error_concentration": f"WITH {_E}, " + _shares("kind", "e", (1, 3, 5, 10)),
    "error_runs": f"WITH {_E}, d AS (SELECT DISTINCT recording, kind, number FROM e WHERE number >= 0), i AS (SELECT *, number - row_number() OVER (PARTITION BY recording, kind ORDER BY number) AS g FROM d), j AS (SELECT recording, kind, min(number) AS a, max(number) AS b FROM i GROUP BY recording, kind, g) SELECT recording, kind, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges, count(*) AS n_runs, CAST(sum(b - a + 1) AS BIGINT) AS n_segments FROM j GROUP BY 1, 2",
    "recording_concentration": f"WITH {_A} SELECT split, recording, count(*) AS samples, count(DISTINCT segment) AS unique_segments, count(*) FILTER (binary_label = 0) AS label_0, count(*) FILTER (binary_label = 1) AS label_1, round(count(*) FILTER (binary_label = 0) / count(*), 9) AS label_0_fraction, round(count(*) FILTER (binary_label = 1) / count(*), 9) AS label_1_fraction, CASE WHEN count(DISTINCT method) = 1 THEN min(method) ELSE 'mixed:' || string_agg(DISTINCT method, '|' ORDER BY method) END AS inference_method FROM s GROUP BY 1, 2",
    "topk_share": f"WITH {_A}, k AS (SELECT * FROM s WHERE split IS NOT NULL), " + _shares("split", "k", (1, 5, 10)),
    "label_majority": f"WITH {_A}, r AS (SELECT recording, count(*) FILTER (binary_label = 0) AS label_0, count(*) FILTER (binary_label = 1) AS label_1 FROM s GROUP BY 1) SELECT recording, label_0, label_1, CASE WHEN label_0 >= label_1 THEN 0 ELSE 1 END AS majority_label, round(CASE WHEN label_0 + label_1 > 0 THEN greatest(label_0, label_1) / (label_0 + label_1) ELSE 0 END, 9) AS majority_fraction, round(CASE WHEN label_0 + label_1 > 0 THEN least(label_0, label_1) / (label_0 + label_1) ELSE 0 END, 9) AS minority_fraction FROM r",
    "inference_quality": f"WITH {_A} SELECT split, method, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS split_total, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 9) AS fraction FROM s GROUP BY 1, 2",
    "dominant_recordings": f"WITH {_E}{_T}, c AS (SELECT count(*) FILTER (recording IN (SELECT recording FROM t)) AS target_errors, count(*) AS all_errors FROM e WHERE kind = 'FP') SELECT target_errors, all_errors, round(100 * target_errors / all_errors, 6) AS percent, CASE WHEN target_errors >= 0.8 * all_errors THEN 'recording-specific' ELSE 'broad' END AS verdict FROM c",
    "target_error_summary": f"WITH {_E}{_T} SELECT recording, kind, count(*) AS n, min(number) AS first_number, max(number) AS last_number, round(max(score), 9) AS max_score, round(avg(score), 9) AS mean_score, round(min(score), 9) AS min_score FROM e WHERE recording IN (SELECT recording FROM t) GROUP BY 1, 2",
    "target_errors_top": f"WITH {_E}{_T}, r AS (SELECT recording, row_seq, score, row_number() OVER (PARTITION BY recording ORDER BY score DESC, row_seq) AS place FROM e WHERE recording IN (SELECT recording FROM t)) SELECT recording, row_seq, round(score, 9) AS score, place FROM r WHERE place <= 30",
    "target_paths": f"WITH {_E}{_T} SELECT file_seq, recording AS id FROM stored_files JOIN t ON contains(lower(file_path), lower(recording))",
    "hard_topk": f"WITH {_A}{_L}, u AS (SELECT 'overall' AS part, * FROM l UNION ALL SELECT CASE binary_label WHEN 1 THEN 'drone' ELSE 'background' END, * FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY loss DESC, row_seq) AS place FROM u) SELECT part, place, row_seq, segment, round(loss, 9) AS loss FROM r WHERE place <= 20",
    "lineage_full_outer": f"WITH f AS (SELECT {sql.segment_key('segment_id')} AS segment, row_seq, status FROM train_feature_manifest), a AS (SELECT segment, arg_min(status, row_seq) AS status, count(*) AS n_features FROM f WHERE segment IS NOT NULL GROUP BY 1), b AS (SELECT {sql.segment_key('segment_id')} AS segment, count(*) AS n_segments FROM train_segments WHERE {sql.segment_key('segment_id')} IS NOT NULL GROUP BY 1) SELECT coalesce(a.segment, b.segment) AS segment, status, n_features, n_segments FROM a FULL JOIN b ON a.segment = b.segment",
    "feature_health": "WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS f FROM embeddings), r AS (SELECT vec_id, list_max(list_transform(f, lambda v: abs(v))) AS m, list_min([list_stddev_pop(f[1:16]), list_stddev_pop(f[17:32]), list_stddev_pop(f[33:48]), list_stddev_pop(f[49:64])]) AS s, list_transform(f, lambda v: printf('%.2f', v)) AS h FROM x) SELECT vec_id, round(m, 6) AS max_abs, round(s, 6) AS min_channel_std, false AS non_finite, m > 15 AND s < 1e-3 AS blow_up, count(*) OVER (PARTITION BY h) > 1 AS is_repeated FROM r",
    "sampler_weights": f"{_WEIGHTS} SELECT row_seq, round(balanced * 1e6, 6) AS balanced, round(hard * 1e6, 6) AS hard, round(p / sum(p) OVER () * 1e6, 6) AS probability FROM p",
    "weighted_draw": f"""{_WEIGHTS}, units AS (SELECT row_seq, CAST(floor(p / sum(p) OVER () * 281474976710656) AS BIGINT) AS u FROM p), placed AS MATERIALIZED (SELECT row_seq, sum(u) OVER (ORDER BY row_seq) - u AS pos FROM units WHERE u > 0),
x AS (SELECT ('0x' || left(md5('42|' || i), 15))::BIGINT % (SELECT sum(u) FROM units) AS pos FROM range((SELECT count(*) FROM l)) r(i))
SELECT placed.row_seq, count(*) AS times FROM x ASOF JOIN placed ON x.pos >= placed.pos GROUP BY 1""",
    "training_stop": """WITH RECURSIVE h AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS epoch, avg(CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0 END) AS f1, avg(value) AS loss FROM events GROUP BY 1, 2),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS i FROM h),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, -1.0::DOUBLE AS best, CAST(NULL AS INT) AS won, 0 AS idle, 'inf'::DOUBLE AS loss, CAST(NULL AS INT) AS stop FROM o
UNION ALL SELECT user_id, i, CASE WHEN better THEN greatest(best, f1) ELSE best END, CASE WHEN better THEN epoch ELSE won END, CASE WHEN better THEN 0 ELSE idle + 1 END, loss, CASE WHEN NOT better AND idle + 1 >= 15 THEN epoch END
FROM (SELECT s.user_id, o.i, s.best, s.won, s.idle, o.epoch, o.f1, o.loss, o.f1 > s.best + 1e-4 OR (abs(o.f1 - s.best) <= 1e-4 AND o.loss < s.loss) AS better FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1 WHERE s.stop IS NULL))
SELECT user_id, round(arg_max(best, i), 9) AS best_f1, arg_max(won, i) AS best_epoch, arg_max(idle, i) AS idle_epochs, max(stop) AS stopped_at FROM s GROUP BY 1""",
    "hardness_update": f"WITH {_A}{_L}, m AS (SELECT segment, row_seq % 7 AS epoch, avg(loss) AS x FROM l GROUP BY 1, 2), o AS (SELECT segment, x, row_number() OVER (PARTITION BY segment ORDER BY epoch DESC) - 1 AS later, count(*) OVER (PARTITION BY segment) AS k FROM m) SELECT segment, round(pow(0.85::DOUBLE, max(k)) + sum((1 - 0.85::DOUBLE) * pow(0.85::DOUBLE, later) * x), 9) AS hardness FROM o GROUP BY 1",
}
