"""Where errors sit: concentration on recordings, runs of segments, hard examples, lineage and identifiers in texts.

Top-k reports rank with ``row_number`` and keep ranks up to k, which Spark cuts on the map side before the shuffle. Ties
are broken by the key, so every report is the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarmill.operators.prefix import share_of

#: Identifiers that are searched for in texts go to the workers in blocks of so many characters.
ID_CHARS = 16_000_000


def concentration(df: DataFrame, by: Sequence[str], segment: str, label: str, method: str | None = None) -> DataFrame:
    """Per recording: samples, distinct segments, labels and how the recording was inferred (``mixed:a|b`` if in several ways)."""
    methods = F.sort_array(F.collect_set(method)) if method else None
    out = df.groupBy(*by).agg(F.count("*").alias("samples"), F.countDistinct(segment).alias("unique_segments"), F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1"), *([methods.alias("methods")] if method else []))
    out = out.withColumns({"label_0_fraction": share_of(F.col("label_0"), F.col("samples")), "label_1_fraction": share_of(F.col("label_1"), F.col("samples"))})
    if not method:
        return out
    text = F.when(F.size("methods") == 1, F.get("methods", F.lit(0))).otherwise(F.concat(F.lit("mixed:"), F.array_join("methods", "|")))
    return out.withColumn("inference_method", text).drop("methods")


def label_majority(states: DataFrame) -> DataFrame:
    """Majority label (0 on a tie) and the shares of the larger and the smaller class."""
    total = F.col("label_0") + F.col("label_1")
    return states.withColumns({"majority_label": F.when(F.col("label_0") >= F.col("label_1"), 0).otherwise(1), "majority_fraction": share_of(F.greatest("label_0", "label_1"), total), "minority_fraction": share_of(F.least("label_0", "label_1"), total)})


def top_shares(counts: DataFrame, by: Sequence[str], key: str, n: str, tops: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Which part of each group's total its largest 1, 3, 5 and 10 keys have, and the largest key."""
    whole = counts.groupBy(*by).agg(F.sum(n).alias("total"), F.count("*").alias("n_keys"))
    w = Window.partitionBy(*by).orderBy(F.desc(n), key)
    top = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(tops))
    sums = top.groupBy(*by).agg(F.min_by(key, "place").alias("largest_key"), *[F.sum(F.when(F.col("place") <= k, F.col(n)).otherwise(0)).alias(f"top_{k}") for k in tops])
    return whole.join(sums, list(by)).withColumns({f"top_{k}_share": share_of(F.col(f"top_{k}"), F.col("total")) for k in tops})


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))


def error_counts(errors: DataFrame, by: Sequence[str], kind: str = "kind") -> DataFrame:
    """False positives and negatives per key, in one pass instead of a full outer join of two counts."""
    return errors.groupBy(*by).agg(F.count_if(F.col(kind) == "FP").alias("false_positives"), F.count_if(F.col(kind) == "FN").alias("false_negatives"), F.count("*").alias("total_errors"))


def runs(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """Consecutive numbers as text, ``1-3, 5, 7-9``; repeated and negative numbers are left out."""
    distinct = df.where(F.col(number) >= 0).select(*by, number).distinct()
    w = Window.partitionBy(*by).orderBy(number)
    islands = distinct.withColumn("island", F.col(number) - F.row_number().over(w)).groupBy(*by, "island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    each = islands.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))).alias("runs"), F.sum(F.col("b") - F.col("a") + 1).alias("n_segments"))
    return each.select(*by, F.array_join(F.transform("runs", lambda r: r["t"]), ", ").alias("ranges"), F.size("runs").cast("bigint").alias("n_runs"), "n_segments")


def first_match(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order, so that a join with it keeps the other side's rows."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def health(features: Column) -> Column:
    """Largest value, smallest channel deviation, non-finite values and whether normalising a near-constant input blew it up.

    ``features`` is an array of channels, each an array of double.
    """
    flat = F.flatten(features)
    largest = F.array_max(F.transform(flat, lambda x: F.abs(x)))

    def deviation(c: Column) -> Column:
        sums = F.aggregate(c, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("m"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"] - (x - a["m"]) / (a["n"] + 1))).alias("s"), (a["m"] + (x - a["m"]) / (a["n"] + 1)).alias("m"), (a["n"] + 1).alias("n")))
        return F.sqrt(sums["s"] / sums["n"])

    least = F.array_min(F.transform(features, deviation))
    digest = F.left(F.sha1(F.array_join(F.transform(flat, lambda x: F.format_number(x, 2)), "|")), F.lit(16))
    return F.struct(largest.alias("max_abs"), least.alias("min_channel_std"), F.exists(flat, lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf"))).alias("non_finite"), ((largest > 15.0) & (least < 1e-3)).alias("blow_up"), digest.alias("feature_hash"))


def repeated(df: DataFrame, column: str) -> DataFrame:
    """Whether a value occurs on another row too; blank values never do. Counted per value, not in a window over its rows."""
    counts = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg((F.count("*") > 1).alias("is_repeated"))
    return df.join(counts, column, "left").withColumn("is_repeated", F.coalesce("is_repeated", F.lit(False)))


def texts_with_ids(df: DataFrame, key: str, text: str, ids: Sequence[str], block_chars: int = ID_CHARS) -> DataFrame:
    """``(key, id)`` for each text that contains an id in any case, each pair once.

    All ids of a block are sought in one pass; more than ``block_chars`` characters of ids make several blocks and passes.
    """
    wanted = sorted({x for x in ids if x})
    if not wanted:
        return df.select(F.col(key), F.lit("").alias("id")).where("false")
    blocks: list[list[str]] = [[]]
    size = 0
    for x in wanted:
        if blocks[-1] and size + len(x) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append(x)
        size += len(x)
    kind = dict(df.dtypes)[key]
    out = None
    for block in blocks:
        found = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(_searcher(block), f"k {kind}, id string")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("k", key)


def _searcher(wanted: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        spelt: dict[str, list[str]] = {}
        for x in wanted:
            spelt.setdefault(x.lower(), []).append(x)
        for low in spelt:
            automaton.add_word(low, low)
        automaton.make_automaton()
        for frame in frames:
            rows = [(k, x) for k, t in zip(frame["k"], frame["t"], strict=True) if t for low in {found for _, found in automaton.iter(t.lower())} for x in spelt[low]]
            yield pd.DataFrame(rows, columns=["k", "id"])

    return run
