"""Sampler weights, hardness and draws for training rows, and the stopping rule over a training history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarmill.operators.prefix import ordered_totals, quantiles
from sonarmill.session import cut_lineage

LEAST_HARD, MOST_HARD, STRENGTH, BALANCED, MOMENTUM = 0.5, 2.0, 0.25, 0.90, 0.85
PATIENCE, MIN_DELTA = 15, 1e-4


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``balanced``: rows of each class share half of the weight. The class counts are a table of two rows."""
    counts = df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n_class"))
    classes = counts.select(F.count("*").alias("n")).scalar()
    return df.join(F.broadcast(counts), label).withColumn("balanced", 1 / (F.col("n_class") * classes)).drop("n_class")


def hard_weights(df: DataFrame, hardness: str) -> DataFrame:
    """``hard``: hardness over its median, clipped and flattened, summing to 1. Missing and infinite hardness count as 1."""
    h = F.col(hardness)
    known = F.greatest(F.lit(1e-8), F.when(h.isNull() | F.isnan(h) | h.isin(float("inf"), float("-inf")), 1.0).otherwise(h))
    rows = df.withColumn("__h", known)
    median = quantiles(rows.select("__h"), [], "__h", {"m": 0.5}).select(F.when(F.col("m") <= 1e-8, 1.0).otherwise(F.col("m")).alias("m")).scalar()
    rows = rows.withColumn("__w", F.pow(F.greatest(F.lit(LEAST_HARD), F.least(F.lit(MOST_HARD), F.col("__h") / median)), F.lit(STRENGTH)))
    return rows.withColumn("hard", F.col("__w") / rows.select(F.sum("__w").alias("s")).scalar()).drop("__h", "__w")


def blended_weights(df: DataFrame, label: str, hardness: str, share: float = BALANCED) -> DataFrame:
    rows = hard_weights(balanced_weights(df, label), hardness).withColumn("__p", share * F.col("balanced") + (1 - share) * F.col("hard"))
    return rows.withColumn("probability", F.col("__p") / rows.select(F.sum("__p").alias("s")).scalar()).drop("__p")


#: Probabilities are counted in units of this size, so that sums are whole numbers and the same in every layout.
UNITS = 1 << 48
#: Stretches of the summed weight that draws and rows are matched in.
STRETCHES = 1 << 14


def draw_with_replacement(df: DataFrame, key: str, probability: str, draws: int, seed: int = 42) -> DataFrame:
    """``(key, times)``: how often each row is drawn in exactly ``draws`` draws; rows never drawn are left out.

    ``key`` is a unique bigint. Rows lie behind each other in its order, each as long as its probability; draw i has a
    point, a digest of seed and i, and takes the row that the point lies in. So the result depends on nothing but the
    rows, the seed and the number of draws. Rows without a positive probability are never drawn; without any, none is.
    """
    units = F.floor(F.col(probability) * UNITS).cast("bigint")
    # written once: two numbers a row, which sums, places and points read in turn
    rows = cut_lineage(df.select(F.col(key).cast("bigint").alias("key"), units.alias("units")).where("key IS NOT NULL AND units > 0"))
    placed = ordered_totals(rows, [], F.shiftright("key", 16), [F.col("key")], {"upto": F.col("units")}).select("key", (F.col("upto") - F.col("units")).alias("at"))
    total = rows.agg(F.sum("units").alias("total")).where("total > 0")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint")
    points = df.sparkSession.range(draws).crossJoin(F.broadcast(total)).select(F.lit(None).cast("bigint").alias("key"), (drawn % F.col("total")).alias("at"))  # one row
    both = placed.withColumn("kind", F.lit(0)).unionByName(points.withColumn("kind", F.lit(1))).crossJoin(F.broadcast(total))
    both = both.withColumn("stretch", F.floor(F.col("at") / (F.floor(F.col("total") / STRETCHES) + 1)))
    # the row that reaches into a stretch from an earlier one: a table of at most STRETCHES rows
    last = both.groupBy("stretch").agg(F.max_by("key", F.when(F.col("kind") == 0, F.col("at"))).alias("last"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("stretch", F.last("last", ignorenulls=True).over(before).alias("carried"))
    upto = Window.partitionBy("stretch").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = both.withColumn("row", F.last("key", ignorenulls=True).over(upto)).where("kind = 1").join(F.broadcast(carried), "stretch")
    return hit.groupBy(F.coalesce("row", "carried").alias(key)).agg(F.count("*").alias("times"))


def updated_hardness(df: DataFrame, old: str, loss_sum: str, seen: str, momentum: float = MOMENTUM) -> DataFrame:
    """``hardness``: the old value moved towards the mean loss of this epoch, for rows that were seen."""
    if not 0 <= momentum < 1:
        raise ValueError("momentum must be in [0, 1)")
    new = momentum * F.col(old) + (1 - momentum) * F.col(loss_sum) / F.col(seen)
    return df.withColumn("hardness", F.when(F.col(seen) > 0, new).otherwise(F.col(old)))


def hardness_over_epochs(df: DataFrame, key: str, epoch: str, loss: str, start: float = 1.0, momentum: float = MOMENTUM) -> DataFrame:
    """The hardness after all epochs: an ordered fold over each row's epochs, whose number is bounded by the run."""
    means = df.groupBy(key, epoch).agg(F.avg(loss).alias("m"))
    folded = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(epoch, "m"))).alias("e"))
    return folded.select(key, F.aggregate("e", F.lit(float(start)), lambda h, x: momentum * h + (1 - momentum) * x["m"]).alias("hardness"))


def stopping(history: DataFrame, by: str, epoch: str, f1: str, loss: str, patience: int = PATIENCE, least: float = MIN_DELTA) -> DataFrame:
    """Per run: best epoch and F1, epochs without improvement at the end, and the epoch at which training stops, if it does.

    An epoch improves with an F1 better by ``least``, or one as good with a loss below the epoch before. A run's epochs are few.
    """
    rows = history.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(epoch, f1, loss))).alias("e"))
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("idle"), F.lit(float("inf")).alias("loss"), F.lit(None).cast("int").alias("stop"))

    def fold(a: Column, x: Column) -> Column:
        better = (x[f1] > a["best"] + least) | ((F.abs(x[f1] - a["best"]) <= least) & (x[loss] < a["loss"]))
        idle = F.when(better, 0).otherwise(a["idle"] + 1)
        now = F.struct(F.when(better, F.greatest(a["best"], x[f1])).otherwise(a["best"]).alias("best"), F.when(better, x[epoch].cast("int")).otherwise(a["at"]).alias("at"), idle.alias("idle"), x[loss].alias("loss"), F.when(idle >= patience, x[epoch].cast("int")).alias("stop"))
        return F.when(a["stop"].isNotNull(), a).otherwise(now)

    done = rows.select(by, F.aggregate("e", start, fold).alias("s"))
    return done.select(by, F.col("s.best").alias("best_f1"), F.col("s.at").alias("best_epoch"), F.col("s.idle").alias("idle_epochs"), F.col("s.stop").alias("stopped_at"))
