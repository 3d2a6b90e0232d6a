"""Waveform and scoring queries. Embeddings are read as waveforms of 64 samples, events as analysed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import dsp, parsing, signals
from sonarmill.operators import scoring
from sonarmill.session import read_table


def waves(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", signals.as_double(F.col("embedding")).alias("wave"))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


def wave_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(waves(spark, d).select("vec_id", signals.quality(F.col("wave"), 64).alias("q")).select("vec_id", "q.*"))


def wave_conditioned(spark: SparkSession, d: str) -> DataFrame:
    """Without offset, scaled to a peak of 0.99."""
    clean = waves(spark, d).select("vec_id", signals.without_offset(F.col("wave")).alias("flat"))
    out = clean.select("vec_id", signals.peak_normalised(F.col("flat")).alias("w"))
    return _rounded(out.select("vec_id", (F.round(signals.mean(F.col("w")), 6) + 0.0).alias("mean"), signals.peak(F.col("w")).alias("peak"), signals.rms(F.col("w")).alias("rms")))


def wave_zcr(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(waves(spark, d).select("vec_id", signals.zero_crossings(F.col("wave")).cast("bigint").alias("crossings"), signals.zero_crossing_rate(F.col("wave")).alias("rate")))


def wave_mono(spark: SparkSession, d: str) -> DataFrame:
    """The two halves as channels."""
    halves = F.array(F.slice("wave", 1, 32), F.slice("wave", 33, 32))
    out = waves(spark, d).select("vec_id", signals.mono(halves).alias("m"))
    return _rounded(out.select("vec_id", F.size("m").cast("bigint").alias("samples"), signals.total(F.col("m")).alias("total"), signals.peak(F.col("m")).alias("peak")))


def wave_frames(spark: SparkSession, d: str) -> DataFrame:
    """Level and crossings of frames of 16 samples, 8 apart."""
    both = F.arrays_zip(signals.frame_rms(F.col("wave"), 16, 8).alias("rms"), signals.frame_zcr(F.col("wave"), 16, 8).alias("zcr"))
    out = waves(spark, d).select("vec_id", F.posexplode(both).alias("frame", "f"))
    return out.select("vec_id", "frame", F.round("f.rms", 6).alias("rms"), F.round("f.zcr", 6).alias("zcr"))


def wave_checks(spark: SparkSession, d: str) -> DataFrame:
    return waves(spark, d).agg(F.count("*").alias("n"), F.count_if(signals.finite(F.col("wave"))).alias("finite"), F.count_if(signals.long_enough(F.col("wave"), 1.0, 64)).alias("long_enough"))


def wave_standardised(spark: SparkSession, d: str) -> DataFrame:
    z = signals.standardised(F.col("wave"))
    return _rounded(waves(spark, d).select("vec_id", z.alias("z")).select("vec_id", signals.rms(F.col("z")).alias("spread"), F.array_max("z").alias("largest")))


def feature_families(spark: SparkSession, d: str) -> DataFrame:
    """Shapes and summaries of the six feature families over each embedding, repeated to 4096 samples."""
    tiled = waves(spark, d).select("vec_id", F.flatten(F.array_repeat("wave", 64)).alias("wave"))
    return dsp.feature_summaries(tiled, "vec_id", "wave")


def windows(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value") + F.lit(0.0)
    return read_table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", (value * 25).alias("centroid"), (value / 1500).alias("rms"), F.pmod(value, F.lit(5.0)).alias("onset"), (value / (value + 50)).alias("model_probability"))


def window_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.scored(windows(spark, d)).select("event_id", "heuristic", "category", "size", "movement", "direction", "distance", "speed", "count", "threat", "level"))


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.scored(windows(spark, d), model=F.col("model_probability")).select("event_id", "likelihood", "threat", "level"))


def threat_levels(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored(windows(spark, d)).groupBy("level", "category").agg(F.count("*").alias("n"), F.round(F.avg("threat"), 6).alias("mean_threat"))


def level_counts_domain(spark: SparkSession, d: str) -> DataFrame:
    return scoring.domain_counts(scoring.scored(windows(spark, d)), "level", scoring.LEVELS)


def contact_fanout(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.overview_contacts(scoring.scored(windows(spark, d))).select("event_id", "i", "contact_likelihood", "contact_threat"))


def airspace_contacts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.airspace_contacts(scoring.scored(windows(spark, d))).select("event_id", "contact", "range_m", "bearing", "contact_speed", "score", "contact_level"))


def factor_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.factors(scoring.scored(windows(spark, d))).select("event_id", "factor", "contribution"))


def feature_weights(spark: SparkSession, d: str) -> DataFrame:
    stds = F.transform("wave", lambda x: x * 10)
    out = waves(spark, d).select("vec_id", F.posexplode(scoring.feature_weights(signals.rms(stds), signals.peak(stds))).alias("family", "weight"))
    return _rounded(out, 9)


def window_event_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = windows(spark, d).withColumns({"zcr": F.col("onset") / 10, "rolloff": F.col("centroid") * 2, "peak": F.col("rms") * 1.5})
    return _rounded(scoring.rolled_up(rows, ["user_id"], 0.6), 9)


def mean_attention(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").select("label", F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("attention"))
    return scoring.mean_vector(rows, ["label"], "attention").select("label", F.posexplode("mean_attention").alias("i", "weight")).withColumn("weight", F.round("weight", 9))


def history_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.scored(windows(spark, d)).select("event_id", "ts", F.concat(F.lit("Sensor-"), F.col("user_id").cast("string")).alias("source"), "category", "level")
    return scoring.filtered_history(rows, "MEDIUM", "Fixed-wing", "sensor-1").orderBy(F.desc("ts"), "event_id")


def history_trend(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.last_rows(scoring.scored(windows(spark, d)).select("event_id", "threat", "level"), "event_id", 30))


def decimated_view(spark: SparkSession, d: str) -> DataFrame:
    return scoring.decimated(windows(spark, d).select("user_id", "event_id"), ["user_id"], "event_id", 10)


def sliding_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of 4 hours, 2 hours apart: the batch form of the streaming roll-up."""
    rows = read_table(spark, d, "events").groupBy(F.window("ts", "4 hours", "2 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


def display_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "combined_manifest").where("size_bytes IS NOT NULL")
    return rows.select("row_seq", parsing.bytes_text(F.col("size_bytes")).alias("size_text"), parsing.clock_text(F.col("size_bytes") / 3200).alias("clock"), parsing.percent_text((F.col("size_bytes") % 1000) / 1000).alias("percent"))


_W = "w AS (SELECT event_id, user_id, event_type, ts, (value + 0.0) * 25 AS centroid, (value + 0.0) / 1500 AS rms, ((value + 0.0) % 5.0::DOUBLE + 5.0::DOUBLE) % 5.0::DOUBLE AS onset, (value + 0.0) / ((value + 0.0) + 50) AS model_probability FROM events), h AS (SELECT *, greatest(0.02, least(0.98, 0.35::DOUBLE + 0.25::DOUBLE * tanh((centroid - 800) / 1300) + 0.18::DOUBLE * tanh((rms - 0.025::DOUBLE) * 14) + 0.06::DOUBLE * tanh(onset / 3))) AS heuristic FROM w)"
_B = "['{n}'][CAST(trunc(greatest(0, least({top}, {at}))) AS INT) + 1]"


def _bucket(names: tuple[str, ...], at: str) -> str:
    return _B.format(n="', '".join(names), top=len(names) - 1, at=at)


_G = f"""g AS (SELECT *, {_bucket(scoring.CATEGORIES, '(centroid - 500) / 1700 * 2.1::DOUBLE')} AS category, {_bucket(scoring.SIZES, '(centroid - 300) / 1300 * 3.6::DOUBLE')} AS size, {_bucket(scoring.MOVEMENTS, 'onset / 3 * 3.2::DOUBLE')} AS movement, CAST(floor((centroid * 0.19::DOUBLE + onset * 23) % 360) AS INT) AS direction,
greatest(2.5, least(45, 8 + (1 - heuristic) * 25)) AS distance, greatest(0.5, least(28, 2 + heuristic * 18 + (onset % 1) * 5)) AS speed, CAST(greatest(1, least(4, 1 + round_even(heuristic * 2 + greatest(0, onset - 1) * 0.25::DOUBLE, 0))) AS INT) AS count FROM h)"""
_THREAT = "greatest(0, least(100, {p} * 62 + (1 - distance / 50) * 18 + least(speed / 28, 1) * 12 + (count - 1) * 4))"
_LEVEL = "CASE WHEN {x} >= 82 THEN 'CRITICAL' WHEN {x} >= 64 THEN 'HIGH' WHEN {x} >= 40 THEN 'MEDIUM' ELSE '{low}' END"
_X = f"{_W}, {_G}, t AS (SELECT *, {_THREAT.format(p='heuristic')} AS threat FROM g), x AS (SELECT *, {_LEVEL.format(x='threat', low='LOW')} AS level FROM t)"
_V = "v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS w FROM embeddings)"
_RMS = "sqrt(list_sum(list_transform({w}, lambda e: e * e)) / len({w}))"
_ZC = "list_sum(list_transform(range(1, len({w})), lambda i: CASE WHEN ({w}[i] < 0) <> ({w}[i + 1] < 0) THEN 1 ELSE 0 END))"
_PEAK = "list_max(list_transform({w}, lambda e: abs(e)))"

_NAMES = [wave_metrics, wave_conditioned, wave_zcr, wave_mono, wave_frames, wave_checks, wave_standardised, feature_families, window_scores, model_scores, threat_levels, level_counts_domain, contact_fanout, airspace_contacts, factor_breakdown, feature_weights, window_event_rollup, mean_attention, history_filter, history_trend, decimated_view, sliding_event_windows, display_texts]
QUERIES = {f.__name__: f for f in _NAMES}
ORACLE = {
    "wave_metrics": f"WITH {_V}, m AS (SELECT vec_id, w, {_RMS.format(w='w')} AS r, {_PEAK.format(w='w')} AS p FROM v) SELECT vec_id, len(w) / 64 AS duration, round(r, 6) AS rms, round(p, 6) AS peak, round(20 * log10((p + 1e-8) / (r + 1e-8)), 6) AS dynamic_range, round(len(list_filter(w, lambda e: abs(e) < 0.001)) / len(w), 6) AS silence_ratio FROM m",
    "wave_conditioned": f"WITH {_V}, f AS (SELECT vec_id, list_transform(w, lambda e: e - list_sum(w) / len(w)) AS f FROM v), n AS (SELECT vec_id, CASE WHEN {_PEAK.format(w='f')} > 0 THEN list_transform(f, lambda e: e / {_PEAK.format(w='f')} * 0.99::DOUBLE) ELSE f END AS w FROM f) SELECT vec_id, round(list_sum(w) / len(w), 6) + 0.0 AS mean, round({_PEAK.format(w='w')}, 6) AS peak, round({_RMS.format(w='w')}, 6) AS rms FROM n",
    "wave_zcr": f"WITH {_V} SELECT vec_id, CAST({_ZC.format(w='w')} AS BIGINT) AS crossings, round({_ZC.format(w='w')} / len(w), 6) AS rate FROM v",
    "wave_mono": f"WITH {_V}, m AS (SELECT vec_id, list_transform(range(1, 33), lambda i: (w[i] + w[i + 32]) / 2) AS m FROM v) SELECT vec_id, len(m) AS samples, round(list_sum(m), 6) AS total, round({_PEAK.format(w='m')}, 6) AS peak FROM m",
    "wave_frames": f"WITH {_V}, f AS (SELECT vec_id, unnest(range(0, 7)) AS frame, w FROM v), g AS (SELECT vec_id, CAST(frame AS INT) AS frame, w[frame * 8 + 1 : frame * 8 + 16] AS w FROM f) SELECT vec_id, frame, round({_RMS.format(w='w')}, 6) AS rms, round({_ZC.format(w='w')} / len(w), 6) AS zcr FROM g",
    "wave_checks": f"WITH {_V} SELECT count(*) AS n, count(*) FILTER (len(list_filter(w, lambda e: isnan(e) OR isinf(e))) = 0) AS finite, count(*) FILTER (len(w) >= 64) AS long_enough FROM v",
    "wave_standardised": f"WITH {_V}, z AS (SELECT vec_id, list_transform(w, lambda e: (e - list_avg(w)) / (list_stddev_pop(w) + 1e-8)) AS z FROM v) SELECT vec_id, round({_RMS.format(w='z')}, 6) AS spread, round(list_max(z), 6) AS largest FROM z",
    "window_scores": f"WITH {_X} SELECT event_id, round(heuristic, 6) AS heuristic, category, size, movement, direction, round(distance, 6) AS distance, round(speed, 6) AS speed, count, round(threat, 6) AS threat, level FROM x",
    "model_scores": f"WITH {_W}, {_G}, t AS (SELECT event_id, greatest(0, least(1, model_probability)) AS likelihood, {_THREAT.format(p='greatest(0, least(1, model_probability))')} AS threat FROM g) SELECT event_id, round(likelihood, 6) AS likelihood, round(threat, 6) AS threat, {_LEVEL.format(x='threat', low='LOW')} AS level FROM t",
    "threat_levels": f"WITH {_X} SELECT level, category, count(*) AS n, round(avg(threat), 6) AS mean_threat FROM x GROUP BY 1, 2",
    "level_counts_domain": f"WITH {_X}, d AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS level, unnest([0, 1, 2, 3]) AS place) SELECT place, d.level, count(x.level) AS n FROM d LEFT JOIN x ON x.level = d.level GROUP BY 1, 2",
    "contact_fanout": f"WITH {_X}, c AS (SELECT *, unnest(range(0, greatest(count, 1))) AS i FROM x) SELECT event_id, CAST(i AS INT) AS i, round(greatest(0.46, least(0.98, heuristic - i * 0.11::DOUBLE)), 6) AS contact_likelihood, round(greatest(18, least(96, threat - i * 9)), 6) AS contact_threat FROM c",
    "airspace_contacts": f"WITH {_X}, c AS (SELECT *, unnest(range(0, greatest(count, 1))) AS i FROM x), s AS (SELECT *, greatest(10, threat - i * 11) AS score FROM c) SELECT event_id, printf('DRONE %02d', i + 1) AS contact, round(distance + i * 4, 6) AS range_m, CAST((direction + i * 37) % 360 AS INT) AS bearing, round(greatest(0.5, speed - i * 1.4::DOUBLE), 6) AS contact_speed, round(score, 6) AS score, {_LEVEL.format(x='score', low='MEDIUM')} AS contact_level FROM s",
    "factor_breakdown": f"WITH {_X} SELECT event_id, 'Drone likelihood' AS factor, round(heuristic * 62, 6) AS contribution FROM x UNION ALL SELECT event_id, 'Speed contribution', round(least(speed / 28, 1) * 12, 6) FROM x UNION ALL SELECT event_id, 'Range contribution', round((1 - least(distance / 45, 1)) * 18, 6) FROM x UNION ALL SELECT event_id, 'Signal energy', round(least(rms * 180, 12), 6) FROM x",
    "feature_weights": f"WITH {_V}, s AS (SELECT vec_id, list_transform(w, lambda e: e * 10) AS w FROM v), r AS (SELECT vec_id, [0.22::DOUBLE * (1 + {_RMS.format(w='w')} / 25), 0.27::DOUBLE * (1 + {_PEAK.format(w='w')} / 20), 0.18::DOUBLE * 1.2::DOUBLE, 0.12::DOUBLE * 1.1::DOUBLE, 0.09::DOUBLE * 1.1::DOUBLE, 0.12::DOUBLE * 1.15::DOUBLE] AS f FROM s) SELECT vec_id, CAST(i AS INT) AS family, round(f[i + 1] / list_sum(f), 9) AS weight FROM (SELECT vec_id, f, unnest(range(0, 6)) AS i FROM r)",
    "window_event_rollup": f"WITH {_W} SELECT user_id, count(*) AS windows, round(avg(rms), 9) AS rms, round(avg(centroid), 9) AS centroid, round(avg(onset / 10), 9) AS zcr, round(avg(onset), 9) AS onset, round(avg(centroid * 2), 9) AS rolloff, round(max(rms * 1.5), 9) AS peak, round(avg(model_probability), 9) AS mean_probability, round(max(model_probability), 9) AS peak_probability, count(*) FILTER (model_probability >= 0.6) AS positive_windows, bool_or(model_probability >= 0.6) AS decision FROM w GROUP BY 1",
    "mean_attention": "SELECT label, CAST(i - 1 AS INT) AS i, round(avg(x), 9) AS weight FROM (SELECT label, unnest(range(1, 7)) AS i, unnest(list_transform(embedding[1:6], lambda e: e::DOUBLE)) AS x FROM embeddings) GROUP BY 1, 2",
    "history_filter": f"WITH {_X} SELECT event_id, ts, 'Sensor-' || user_id AS source, category, level FROM x WHERE level = 'MEDIUM' AND category = 'Fixed-wing' AND contains(lower('Sensor-' || user_id), 'sensor-1')",
    "history_trend": f"WITH {_X} SELECT event_id, round(threat, 6) AS threat, level FROM x ORDER BY event_id DESC LIMIT 30",
    "decimated_view": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE p % greatest(1, CAST(ceil(n / 10) AS BIGINT)) = 0",
    "sliding_event_windows": "WITH b AS (SELECT *, time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') AS k FROM events), s AS (SELECT event_type, value, k AS started FROM b UNION ALL SELECT event_type, value, k - INTERVAL '2 hours' FROM b) SELECT started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2",
    "display_texts": "SELECT row_seq, CASE WHEN size_bytes < 1024 THEN printf('%.1f B', size_bytes::DOUBLE) WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576) ELSE printf('%.1f GB', size_bytes / 1073741824) END AS size_text, CASE WHEN size_bytes / 3200 >= 3600 THEN printf('%02d:', (size_bytes // 3200) // 3600) ELSE '' END || printf('%02d:%02d', ((size_bytes // 3200) // 60) % 60, (size_bytes // 3200) % 60) AS clock, printf('%.2f%%', (size_bytes % 1000) / 1000 * 100) AS percent FROM combined_manifest WHERE size_bytes IS NOT NULL",
}
