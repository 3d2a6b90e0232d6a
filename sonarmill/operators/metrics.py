"""Detection metrics over predictions ``(label, score)``: confusion, threshold search, ROC and PR curves, recording roll-up.

Everything is reduced to counts per threshold step or per score before it is ordered; no operator compares every row with
every threshold. Rows with a null label or score are left out. An empty input gives zeros, and no area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.operators.prefix import ordered_totals, share_of

GRID = (0.05, 0.95, 181)
TABLE = tuple(0.20 + 0.05 * i for i in range(11))
DEFAULT_THRESHOLD, F1_TOLERANCE, RECALL_TOLERANCE = 0.50, 0.001, 1e-12
#: Stretches of the score axis that curves are ordered in.
STRETCHES = 4096


def grid(first: float = GRID[0], last: float = GRID[1], steps: int = GRID[2]) -> list[float]:
    width = (last - first) / (steps - 1)
    return [first + i * width for i in range(steps - 1)] + [last]


def confusion(score: Column, label: Column, threshold: Column) -> dict[str, Column]:
    """Counting aggregates; a score at the threshold is a detection."""
    hit = score >= threshold
    return {"tp": F.count_if(hit & (label == 1)), "fp": F.count_if(hit & (label == 0)), "fn": F.count_if(~hit & (label == 1)), "tn": F.count_if(~hit & (label == 0))}


def rates(df: DataFrame) -> DataFrame:
    """Metrics from ``tp, fp, fn, tn``; 0 where a denominator is 0. Accuracy in percent."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = df.withColumns({"accuracy": 100 * share_of(tp + tn, tp + fp + fn + tn), "precision": share_of(tp, tp + fp), "recall": share_of(tp, tp + fn), "specificity": share_of(tn, tn + fp), "fpr": share_of(fp, tn + fp)})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", share_of(2 * F.col("precision") * F.col("recall"), both))


def at_threshold(df: DataFrame, threshold: float) -> DataFrame:
    each = confusion(F.col("score"), F.col("label"), F.lit(threshold))
    return rates(df.where("score IS NOT NULL AND label IS NOT NULL").agg(*[v.alias(k) for k, v in each.items()]))


def sweep(df: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Metrics at each threshold: ``step, threshold`` and the rates.

    Each row is put between two neighbouring thresholds once; the counts of the steps, a bounded table, are accumulated.
    """
    at = sorted(thresholds or grid())
    edges = F.array(*[F.lit(x) for x in at])
    # the guess can be off by rounding at an edge; comparing with the edges themselves sets it right
    guess = F.greatest(F.lit(0), F.least(F.lit(len(at) - 1), F.floor((F.col("score") - at[0]) / ((at[-1] - at[0]) / max(1, len(at) - 1) or 1.0)).cast("int")))
    up = F.when((guess < len(at) - 1) & (F.get(edges, guess + 1) <= F.col("score")), 1).otherwise(0)
    passed = guess + F.when(F.get(edges, guess) > F.col("score"), 0).otherwise(1) + F.when(F.get(edges, guess) > F.col("score"), 0).otherwise(up)
    counts = df.where("score IS NOT NULL AND label IS NOT NULL").groupBy(passed.alias("passed")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    steps = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(at)], "step int, threshold double")
    each = steps.join(F.broadcast(counts), F.lit(True), "left").groupBy("step", "threshold").agg(  # at most one row of counts for each step
        *[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0).cast("bigint")).alias(k) for k, cond, c in (("tp", F.col("passed") > F.col("step"), "pos"), ("fp", F.col("passed") > F.col("step"), "neg"), ("fn", F.col("passed") <= F.col("step"), "pos"), ("tn", F.col("passed") <= F.col("step"), "neg"))]
    )
    return rates(each)


def best_threshold(swept: DataFrame, rule: str = "first", default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``(threshold, f1)`` by one of three rules, as an ordered fold over the swept steps.

    * ``first``: the largest F1, the lowest threshold among equals;
    * ``recall``: within the F1 tolerance a larger recall, then the nearest to 0.5, wins, and the winner's values are kept;
    * ``stable``: as ``recall``, but the best F1 and recall seen are kept, and recalls are equal within a relative 1e-5.
    """
    if rule not in ("first", "recall", "stable"):
        raise ValueError(f"unknown rule {rule!r}")
    steps = swept.agg(F.array_sort(F.collect_list(F.struct("step", "threshold", "f1", "recall"))).alias("steps"))  # bounded by the grid
    start = F.struct(F.lit(float(default)).alias("t"), F.lit(-1.0).alias("f1"), F.lit(-1.0).alias("recall"), F.lit(float("inf")).alias("gap"))

    def fold(best: Column, now: Column) -> Column:
        gap = F.abs(now["threshold"] - 0.5)
        near = now["f1"] >= best["f1"] - F1_TOLERANCE
        if rule == "first":
            better = now["f1"] > best["f1"]
        else:
            slack = RECALL_TOLERANCE + (1e-5 * F.abs(best["recall"]) if rule == "stable" else 0.0)
            better = (now["f1"] > best["f1"] + F1_TOLERANCE) | (near & (now["recall"] > best["recall"] + RECALL_TOLERANCE)) | (near & (F.abs(now["recall"] - best["recall"]) <= slack) & (gap < best["gap"]))
        f1, recall = (F.greatest(best["f1"], now["f1"]), F.greatest(best["recall"], now["recall"])) if rule == "stable" else (now["f1"], now["recall"])
        return F.when(better, F.struct(now["threshold"].alias("t"), f1.alias("f1"), recall.alias("recall"), gap.alias("gap"))).otherwise(best)

    won = steps.select(F.aggregate("steps", start, fold).alias("b"))
    return won.select(F.col("b.t").alias("threshold"), F.greatest(F.lit(0.0), F.col("b.f1")).alias("f1"))


def _stretch(score: Column) -> Column:
    """Falls as the score rises; scores outside of 0 to 1 share the outer stretches."""
    return -F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * STRETCHES)


def roc_points(df: DataFrame) -> DataFrame:
    """``(score, pos, neg, tp, fp)``: running counts from the highest score down, ties as one point."""
    known = df.where("score IS NOT NULL AND label IS NOT NULL")
    ties = known.groupBy((F.col("score") + F.lit(0.0)).alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return ordered_totals(ties, [], _stretch(F.col("score")), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve as the Mann-Whitney statistic with ties counted half; null with one class only."""
    sums = roc_points(df).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("u"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def pr_auc(df: DataFrame, order: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, a point for every row from the highest score down.

    Ties are not merged: rows of one score follow in the order of column ``order``. The curve starts at recall 0,
    precision 1. Null without positives.
    """
    known = df.where("score IS NOT NULL AND label IS NOT NULL").select("score", "label", F.col(order).alias("seq"))
    run = ordered_totals(known, [], _stretch(F.col("score")), [F.desc("score"), F.col("seq")], {"tp": F.col("label").cast("bigint"), "n": F.lit(1).cast("bigint")})
    # a row adds to recall only if it is positive; the point before it has tp - 1 of n - 1
    before = F.when(F.col("n") == 1, 1.0).otherwise((F.col("tp") - 1) / (F.col("n") - 1))
    area = F.sum(F.when(F.col("label") == 1, (F.col("tp") / F.col("n") + before) / 2))
    return run.agg(area.alias("a"), F.sum("label").alias("p")).select(F.when(F.col("p") > 0, F.col("a") / F.col("p")).alias("pr_auc"))


def average_ranks(df: DataFrame, group: str | None = None) -> DataFrame:
    """``(score, n, average_rank)``: the rank of each score from the lowest, ties at their mean rank."""
    by = [group] if group else []
    ties = df.where("score IS NOT NULL").groupBy(*by, "score").agg(F.count("*").alias("n"))
    run = ordered_totals(ties, by, -_stretch(F.col("score")), [F.col("score")], {"upto": F.col("n")})
    return run.select(*by, "score", "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("average_rank"))


def by_recording(df: DataFrame, recording: str, method: str = "max") -> DataFrame:
    """Segments rolled up to recordings: the largest or mean score, the largest label and whether labels are mixed."""
    if method not in ("max", "mean"):
        raise ValueError("method must be max or mean")
    score = F.max("score") if method == "max" else F.avg("score")
    return df.groupBy(recording).agg(score.alias("score"), F.max("label").alias("label"), (F.min("label") < F.max("label")).alias("mixed"))

