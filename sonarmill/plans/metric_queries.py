"""Detection metrics over the event table read as predictions: score value/(value+50), label event_type = 'error', recording user_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.operators import metrics, prefix
from sonarmill.session import read_table

THRESHOLD = 0.5


def predictions(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value") + F.lit(0.0)
    return read_table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("recording"), (value / (value + 50)).alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


def confusion_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.at_threshold(predictions(spark, d), THRESHOLD))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.sweep(predictions(spark, d)), 9)


def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.sweep(predictions(spark, d), list(metrics.TABLE)), 9)


def _best(rule: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(metrics.best_threshold(metrics.sweep(predictions(spark, d)), rule), 9)

    return query


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.roc_auc(predictions(spark, d)), 9)


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_points(predictions(spark, d)).select(F.round("score", 9).alias("score"), "pos", "neg", "tp", "fp")


def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.pr_auc(predictions(spark, d), "seq"), 9)


def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_ranks(predictions(spark, d)).select(F.round("score", 9).alias("score"), "n", "average_rank")


def _per_recording(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).withColumn("label", (F.col("recording") % 2).cast("int"))


def recording_rollup_max(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.by_recording(_per_recording(spark, d), "recording", "max"), 9)


def recording_rollup_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.by_recording(_per_recording(spark, d), "recording", "mean"), 9)


def recording_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.at_threshold(metrics.by_recording(_per_recording(spark, d), "recording", "max"), 0.9))


def error_types(spark: SparkSession, d: str) -> DataFrame:
    """Each prediction with its kind of error, signed distance from the threshold and flags."""
    hit = F.col("score") >= THRESHOLD
    kind = F.when(hit & (F.col("label") == 1), "TP").when(hit, "FP").when(F.col("label") == 1, "FN").otherwise("TN")
    return predictions(spark, d).select(
        "seq", "label", F.round("score", 9).alias("score"), F.round(1 - F.col("score"), 9).alias("background"), hit.cast("int").alias("predicted"), kind.alias("error_type"), (hit.cast("int") == F.col("label")).alias("correct"),
        F.round(F.greatest("score", 1 - F.col("score")), 9).alias("confidence"), F.round(F.col("score") - THRESHOLD, 9).alias("margin"), F.round(F.abs(F.col("score") - THRESHOLD), 9).alias("distance"), ((F.col("label") == 1) & (F.abs(F.col("score") - THRESHOLD) <= 0.2)).alias("borderline"),
    )


def error_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(error_types(spark, d).groupBy("error_type").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score")))


def hardness_stats(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy per class: mean, median, 90th percentile and largest."""
    loss = -F.log(F.greatest(F.lit(1e-12), F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))))
    rows = predictions(spark, d).withColumn("loss", loss)
    ends = rows.groupBy("label").agg(F.avg("loss").alias("mean_loss"), F.max("loss").alias("max_loss"))
    return _rounded(ends.join(prefix.quantiles(rows, ["label"], "loss", {"median_loss": 0.5, "p90_loss": 0.9}), "label"))


_P = "p AS (SELECT event_id AS seq, user_id AS recording, (value + 0.0) / ((value + 0.0) + 50) AS score, CAST(event_type = 'error' AS INT) AS label FROM events)"
_C = "count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label = 0) AS fp, count(*) FILTER (score < {t} AND label = 1) AS fn, count(*) FILTER (score < {t} AND label = 0) AS tn"


def _rates(more: str, places: int, source: str = "c") -> str:
    r = lambda x: f"round({x}, {places})"
    pre, rec = "(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END)", "(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END)"
    return f"SELECT {more} tp, fp, fn, tn, {r('100.0 * (tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r(pre)} AS precision, {r(rec)} AS recall, {r('CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END')} AS specificity, {r('CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0 END')} AS fpr, {r(f'CASE WHEN {pre} + {rec} > 0 THEN 2 * {pre} * {rec} / ({pre} + {rec}) ELSE 0 END')} AS f1 FROM {source}"


_GRID = "g AS (SELECT CAST(i AS INT) AS step, CASE WHEN i = 180 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 180) END AS threshold FROM range(181) t(i))"
_TABLE = "g AS (SELECT CAST(i AS INT) AS step, 0.20::DOUBLE + 0.05::DOUBLE * i AS threshold FROM range(11) t(i))"
_SWEPT = "c AS (SELECT step, threshold, " + _C.format(t="threshold") + " FROM p, g GROUP BY 1, 2)"
_F1 = "f AS (SELECT step, threshold, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END AS f1 FROM c)"
_NEAR = "f.f1 >= b.f1 - 0.001"


def _fold(same: str, f1: str, recall: str) -> str:
    better = f"(f.f1 > b.f1 + 0.001 OR ({_NEAR} AND f.recall > b.recall + 1e-12) OR ({_NEAR} AND {same} AND abs(f.threshold - 0.5) < b.gap))"
    return f"WITH RECURSIVE {_P}, {_GRID}, {_SWEPT}, {_F1}, b AS (SELECT -1 AS step, 0.5::DOUBLE AS t, -1.0::DOUBLE AS f1, -1.0::DOUBLE AS recall, 'inf'::DOUBLE AS gap UNION ALL SELECT f.step, CASE WHEN {better} THEN f.threshold ELSE b.t END, CASE WHEN {better} THEN {f1} ELSE b.f1 END, CASE WHEN {better} THEN {recall} ELSE b.recall END, CASE WHEN {better} THEN abs(f.threshold - 0.5) ELSE b.gap END FROM b JOIN f ON f.step = b.step + 1) SELECT round(t, 9) AS threshold, round(greatest(0, f1), 9) AS f1 FROM b WHERE step = 180"


def _rollup(score: str) -> str:
    return f"WITH {_P} SELECT recording, round({score}(score), 9) AS score, CAST(max(recording % 2) AS INT) AS label, false AS mixed FROM p GROUP BY 1"


_KIND = "CASE WHEN score >= 0.5 AND label = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END"

QUERIES = {
    "confusion_at_threshold": confusion_at_threshold, "threshold_sweep": threshold_sweep, "threshold_table": threshold_table, "threshold_best_first": _best("first"), "threshold_best_recall": _best("recall"), "threshold_best_stable": _best("stable"),
    "roc_auc": roc_auc, "roc_curve": roc_curve, "pr_auc": pr_auc, "average_ranks": average_ranks, "recording_rollup_max": recording_rollup_max, "recording_rollup_mean": recording_rollup_mean, "recording_metrics": recording_metrics,
    "error_types": error_types, "error_probabilities": error_probabilities, "hardness_stats": hardness_stats,
}
ORACLE = {
    "confusion_at_threshold": f"WITH {_P}, c AS (SELECT {_C.format(t='0.5')} FROM p) " + _rates("", 6),
    "threshold_sweep": f"WITH {_P}, {_GRID}, {_SWEPT} " + _rates("step, round(threshold, 9) AS threshold,", 9),
    "threshold_table": f"WITH {_P}, {_TABLE}, {_SWEPT} " + _rates("step, round(threshold, 9) AS threshold,", 9),
    "threshold_best_first": f"WITH {_P}, {_GRID}, {_SWEPT}, {_F1} SELECT round(threshold, 9) AS threshold, round(f1, 9) AS f1 FROM f ORDER BY f.f1 DESC, step LIMIT 1",
    "threshold_best_recall": _fold("abs(f.recall - b.recall) <= 1e-12", "f.f1", "f.recall"),
    "threshold_best_stable": _fold("abs(f.recall - b.recall) <= 1e-12 + 1e-5 * abs(b.recall)", "greatest(b.f1, f.f1)", "greatest(b.recall, f.recall)"),
    "roc_auc": f"WITH {_P}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM p) SELECT round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS roc_auc FROM r",
    "roc_curve": f"WITH {_P}, s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM p GROUP BY 1) SELECT round(score, 9) AS score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM s WINDOW w AS (ORDER BY score DESC)",
    "pr_auc": f"WITH {_P}, o AS (SELECT label, sum(label) OVER w AS tp, row_number() OVER w AS n FROM p WINDOW w AS (ORDER BY score DESC, seq)), q AS (SELECT tp / (SELECT sum(label) FROM p) AS r, tp / n AS pr, n FROM o), l AS (SELECT r, pr, lag(r, 1, 0) OVER (ORDER BY n) AS r0, lag(pr, 1, 1) OVER (ORDER BY n) AS p0 FROM q) SELECT round(sum((r - r0) * (pr + p0) / 2), 9) AS pr_auc FROM l",
    "average_ranks": f"WITH {_P} SELECT round(score, 9) AS score, count(*) AS n, min(k) + (count(*) - 1) / 2 AS average_rank FROM (SELECT score, rank() OVER (ORDER BY score) AS k FROM p) GROUP BY p.score, score".replace("GROUP BY p.score, score", "GROUP BY score"),
    "recording_rollup_max": _rollup("max"),
    "recording_rollup_mean": _rollup("avg"),
    "recording_metrics": f"WITH {_P}, m AS (SELECT recording % 2 AS label, max(score) AS score FROM p GROUP BY recording), c AS (SELECT {_C.format(t='0.9')} FROM m) " + _rates("", 6),
    "error_types": f"WITH {_P} SELECT seq, label, round(score, 9) AS score, round(1 - score, 9) AS background, CAST(score >= 0.5 AS INT) AS predicted, {_KIND} AS error_type, (score >= 0.5) = (label = 1) AS correct, round(greatest(score, 1 - score), 9) AS confidence, round(score - 0.5, 9) AS margin, round(abs(score - 0.5), 9) AS distance, label = 1 AND abs(score - 0.5) <= 0.2 AS borderline FROM p",
    "error_probabilities": f"WITH {_P} SELECT {_KIND} AS error_type, count(*) AS n, round(avg(round(score, 9)), 6) AS mean_score, round(min(round(score, 9)), 6) AS min_score, round(max(round(score, 9)), 6) AS max_score FROM p GROUP BY 1",
    "hardness_stats": f"WITH {_P}, l AS (SELECT label, -ln(greatest(1e-12, CASE WHEN label = 1 THEN score ELSE 1 - score END)) AS loss FROM p) SELECT label, round(avg(loss), 6) AS mean_loss, round(median(loss), 6) AS median_loss, round(quantile_cont(loss, 0.9), 6) AS p90_loss, round(max(loss), 6) AS max_loss FROM l GROUP BY 1",
}
