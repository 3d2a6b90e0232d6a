"""Scores of analysed windows: likelihood, categories, distance, threat and its parts, contacts, levels and history views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: names and bounds of the buckets
CATEGORIES = ("Multirotor", "Fixed-wing", "Unknown")
SIZES = ("Micro", "Small", "Medium", "Large")
MOVEMENTS = ("Hover", "Cruise", "Approach", "Departing")
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
LEVEL_BOUNDS = (40, 64, 82)
FEATURE_WEIGHTS = (0.22, 0.27, 0.18, 0.12, 0.09, 0.12)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def likelihood(centroid: Column, rms: Column, onset: Column) -> Column:
    return clip(0.35 + 0.25 * F.tanh((centroid - 800) / 1300) + 0.18 * F.tanh((rms - 0.025) * 14) + 0.06 * F.tanh(onset / 3), 0.02, 0.98)


def bucket(names: tuple[str, ...], at: Column) -> Column:
    """The name at a real place, cut to the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), clip(at, 0, len(names) - 1).cast("int"))


def threat(chance: Column, distance: Column, speed: Column, count: Column) -> Column:
    return clip(chance * 62 + (1 - distance / 50) * 18 + F.least(speed / 28, F.lit(1.0)) * 12 + (count - 1) * 4, 0, 100)


def level(score: Column, lowest: str = "LOW") -> Column:
    """Level by the three bounds; ``lowest`` names what is below the first, for views without a LOW band."""
    return F.when(score >= LEVEL_BOUNDS[2], LEVELS[3]).when(score >= LEVEL_BOUNDS[1], LEVELS[2]).when(score >= LEVEL_BOUNDS[0], LEVELS[1]).otherwise(lowest)


def scored(df: DataFrame, noise: Column | None = None, model: Column | None = None) -> DataFrame:
    """Adds all scores to ``centroid, rms, onset``. A model's mean probability replaces the likelihood for the threat only.

    ``noise`` is added to the distance; by default none, so that the result depends on the row alone.
    """
    c, onset = F.col("centroid"), F.col("onset")
    out = df.withColumn("heuristic", likelihood(c, F.col("rms"), onset))
    chance = F.col("heuristic")
    out = out.withColumns({
        "category": bucket(CATEGORIES, (c - 500) / 1700 * 2.1), "size": bucket(SIZES, (c - 300) / 1300 * 3.6), "movement": bucket(MOVEMENTS, onset / 3 * 3.2),
        "direction": F.floor(F.pmod(c * 0.19 + onset * 23, F.lit(360.0))).cast("int"),
        "distance": clip(8 + (1 - chance) * 25 + (F.lit(0.0) if noise is None else noise), 2.5, 45), "speed": clip(2 + chance * 18 + F.pmod(onset, F.lit(1.0)) * 5, 0.5, 28),
        "count": clip(1 + F.bround(chance * 2 + F.greatest(F.lit(0.0), onset - 1) * 0.25), 1, 4).cast("int"),
    })
    known = chance if model is None else F.coalesce(clip(model, 0, 1), chance)
    out = out.withColumn("likelihood", known).withColumn("threat", threat(F.col("likelihood"), F.col("distance"), F.col("speed"), F.col("count")))
    return out.withColumn("level", level(F.col("threat")))


def overview_contacts(df: DataFrame) -> DataFrame:
    """One row per contact, each further one less likely and less of a threat."""
    each = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("count"), F.lit(1)) - 1)))
    return each.withColumns({"contact_likelihood": clip(F.col("likelihood") - F.col("i") * 0.11, 0.46, 0.98), "contact_threat": clip(F.col("threat") - F.col("i") * 9, 18, 96)})


def airspace_contacts(df: DataFrame) -> DataFrame:
    each = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("count"), F.lit(1)) - 1)))
    score = F.greatest(F.lit(10.0), F.col("threat") - F.col("i") * 11)
    return each.withColumns({"contact": F.format_string("DRONE %02d", F.col("i") + 1), "range_m": F.col("distance") + F.col("i") * 4, "bearing": F.pmod(F.col("direction") + F.col("i") * 37, F.lit(360)), "contact_speed": F.greatest(F.lit(0.5), F.col("speed") - F.col("i") * 1.4), "score": score, "contact_level": level(score, "MEDIUM")})


def factors(df: DataFrame, range_scale: float = 45.0) -> DataFrame:
    """The four parts of a threat as rows. The range part is scaled by 45 here and by 50 in the threat itself."""
    part = lambda name, value: F.struct(F.lit(name).alias("factor"), value.alias("contribution"))
    parts = F.array(
        part("Drone likelihood", F.col("likelihood") * 62), part("Speed contribution", F.least(F.col("speed") / 28, F.lit(1.0)) * 12),
        part("Range contribution", (1 - F.least(F.col("distance") / range_scale, F.lit(1.0))) * 18), part("Signal energy", F.least(F.col("rms") * 180, F.lit(12.0))),
    )
    return df.select("*", F.inline(parts))


def feature_weights(mfcc_std: Column, mel_std: Column) -> Column:
    """Weights of the six families, the first two raised by their spread, summing to 1."""
    raised = [FEATURE_WEIGHTS[0] * (1 + mfcc_std / 25), FEATURE_WEIGHTS[1] * (1 + mel_std / 20)] + [F.lit(w * (1 + k)) for w, k in zip(FEATURE_WEIGHTS[2:], (0.2, 0.1, 0.1, 0.15), strict=True)]
    whole = sum(raised[1:], raised[0])
    return F.array(*[r / whole for r in raised])


def rolled_up(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Windows of one recording: means, largest peak and model scores, positive windows and whether there is any."""
    p = F.col("model_probability")
    return df.groupBy(*by).agg(
        F.count("*").alias("windows"), *[F.avg(c).alias(c) for c in ("rms", "centroid", "zcr", "onset", "rolloff")], F.max("peak").alias("peak"),
        F.avg(p).alias("mean_probability"), F.max(p).alias("peak_probability"), F.count_if(p >= threshold).alias("positive_windows"), F.coalesce(F.bool_or(p >= threshold), F.lit(False)).alias("decision"),
    )


def mean_vector(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The mean of each element of an array column, as an array again."""
    each = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("m"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(f"mean_{vector}"))


def domain_counts(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows per value of a fixed domain, in its order, 0 where there are none."""
    known = df.sparkSession.createDataFrame(list(enumerate(domain)), f"place int, {column} string")
    return known.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select("place", column, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def filtered_history(df: DataFrame, wanted_level: str | None = None, category: str | None = None, source: str | None = None) -> DataFrame:
    """History rows by level, category and part of the source in any case; null sources match no text."""
    out = df
    if wanted_level:
        out = out.where(F.col("level") == wanted_level)
    if category:
        out = out.where(F.col("category") == category)
    if source:
        out = out.where(F.contains(F.lower("source"), F.lit(source.lower())))
    return out


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows in insertion order, oldest first: a trend view."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def decimated(df: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced in order: every k-th row. For views of one recording at a time."""
    w = Window.partitionBy(*by)
    placed = df.withColumns({"__place": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / most))
    return placed.where(F.col("__place") % step == 0).drop("__place", "__n")
