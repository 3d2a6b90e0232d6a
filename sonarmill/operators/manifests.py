"""Manifest operators: identity by content, quarantine of contradictions, group splits, and integrity checks.

Manifests come as DataFrames with explicit keys; nothing here collects rows to the driver. Rows without a content hash
have no identity: they are neither duplicates nor conflicts and are left out of both results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.functions.keys import filled
from sonarmill.operators.prefix import ordered_totals

SPLITS = ("train", "validation", "test")
RATIOS = (0.70, 0.15, 0.15)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that lists the missing columns in order."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str], exact_case: bool = False) -> str | None:
    """The first candidate that the frame has; by default in any case. Never by part of a name."""
    known = {c if exact_case else c.lower(): c for c in df.columns}
    return next((known[k] for c in candidates if (k := c if exact_case else c.lower()) in known), None)


def columns_like(df: DataFrame, term: str) -> list[str]:
    return [c for c in df.columns if term.lower() in c.lower()]


def checked_ratios(ratios: Sequence[float]) -> tuple[float, ...]:
    if len(ratios) != len(SPLITS) or min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("three positive ratios that sum to 1 are needed")
    return tuple(ratios)


# identity


def content_states(df: DataFrame, sha: str, label: str, order: str) -> DataFrame:
    """One compact row per content: rows, first row, whether labels contradict. Aggregated on the map side first."""
    known = df.where(F.col(sha).isNotNull())
    return known.groupBy(sha).agg(F.count("*").alias("n_rows"), F.min(order).alias("first_row"), (F.min(label) < F.max(label)).alias("conflict"))


def deduplicate(df: DataFrame, sha: str, label: str, order: str) -> DataFrame:
    """The first row of each content whose labels agree. Hot contents are met as one state, never sorted."""
    first = content_states(df, sha, label, order).where("NOT coalesce(conflict, false)").select(sha, F.col("first_row").alias(order))
    return df.join(first, [sha, order], "left_semi")


def conflicts(df: DataFrame, sha: str, label: str, order: str, reason: str = "conflicting_binary_labels_for_identical_content") -> DataFrame:
    """All rows of each content whose labels contradict, with a reason."""
    bad = content_states(df, sha, label, order).where("conflict").select(sha)
    return df.join(bad, sha, "left_semi").withColumn("conflict_reason", F.lit(reason))


def dedup_summary(df: DataFrame, sha: str, label: str, order: str) -> DataFrame:
    states = content_states(df, sha, label, order)
    bad = F.coalesce("conflict", F.lit(False))
    return states.agg(F.count_if(~bad).alias("retained"), F.sum(F.when(~bad, F.col("n_rows") - 1).otherwise(0)).alias("duplicates"), F.sum(F.when(bad, F.col("n_rows")).otherwise(0)).alias("quarantined"), F.count_if(bad).alias("conflicting_contents"))


# group split


def group_sizes(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.min(label).alias("label"), F.max(label).alias("other"), F.count("*").alias("n"))


def group_split(df: DataFrame, group: str, label: str, ratios: Sequence[float] = RATIOS, seed: int = 42) -> DataFrame:
    """``(group, label, n, split)``: whole groups into splits, label by label, largest group first.

    The first three groups of a label seed the splits; each later one goes where most is missing, ties to the split with
    fewer rows, then in the order of the names. Equal sizes are ordered by a digest of group and seed. Groups with both
    labels are left out; ``mixed_groups`` names them. The choice is sequential by definition, so one task streams each
    label's groups, keeping three numbers.
    """
    ratios = checked_ratios(ratios)
    pure = group_sizes(df, group, label).where("label = other").select("group", "label", "n")
    total = pure.groupBy("label").agg(F.sum("n").alias("total"))
    order = F.sha2(F.concat(F.col("group"), F.lit(f"|{seed}")), 256)
    rows = pure.join(F.broadcast(total), "label").withColumn("order", order)  # one row for each label

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, have, seen = None, [0, 0, 0], 0
        for frame in frames:
            chosen = []
            for known, n, whole in zip(frame["label"], frame["n"], frame["total"], strict=True):
                if known != now:
                    now, have, seen = known, [0, 0, 0], 0
                best = seen if seen < 3 else max(range(3), key=lambda i: (whole * ratios[i] - have[i], -have[i], -i))
                have[best] += n
                seen += 1
                chosen.append(SPLITS[best])
            yield frame.assign(split=chosen)[["group", "label", "n", "split"]]

    return rows.repartition("label").sortWithinPartitions("label", F.desc("n"), "order").mapInPandas(choose, "group string, label int, n bigint, split string")


def mixed_groups(df: DataFrame, group: str, label: str) -> DataFrame:
    return group_sizes(df, group, label).where("label < other").select("group", "n")


# integrity


def memberships(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split, with the splits in order of name. At most three per key are gathered."""
    known = df.where(F.col(key).isNotNull() & F.col(split).isNotNull())
    each = known.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_set(split)).alias("splits"))
    return each.where(F.size("splits") > 1)


def split_overlaps(df: DataFrame, keys: Sequence[str], split: str) -> DataFrame:
    """``(key_name, left, right, n, example)`` for each pair of splits, from one aggregation per key, not three intersections."""
    out = None
    for key in keys:
        pairs = F.array(*[F.when(F.array_contains("splits", a) & F.array_contains("splits", b), F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"))) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]])
        found = memberships(df, key, split).select("key", F.inline(F.array_compact(pairs)))
        rows = found.groupBy("left_split", "right_split").agg(F.count("*").alias("n"), F.min("key").alias("example")).select(F.lit(key).alias("key_name"), "left_split", "right_split", "n", "example")
        out = rows if out is None else out.unionByName(rows)
    return out


def missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` lacks."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().join(other.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other: ``side`` and the columns. Nothing, if both hold the same rows."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


# shards


def shard_numbers(df: DataFrame, by: Sequence[str], order: str, size: int = 256, stretch_bits: int = 16) -> DataFrame:
    """``shard_no, slot``: rows of each part packed in the order of a bigint column, ``size`` to a shard.

    Stretches of ``2**stretch_bits`` order values are counted first and numbered within, so no task sorts a whole part.
    """
    placed = ordered_totals(df, by, F.shiftright(F.col(order).cast("bigint"), stretch_bits), [F.col(order)], {"place": F.lit(1).cast("bigint")})
    place = F.col("place") - 1
    return placed.withColumns({"shard_no": F.floor(place / size).cast("int"), "slot": (place % size).cast("int")}).drop("place")


def not_yet_built(wanted: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """Rows whose output doesn't exist yet."""
    return wanted.join(built.select(key).distinct(), key, "left_anti")


# derived keys


def recording_group(dataset: Column, path: Column, name: Column) -> Column:
    """The recording a file belongs to; chunks of one recording share it.

    al_emadi: the path; uavirbase: its directory; ddl: its directory or else the stem; others: the stem without a
    trailing chunk number, or the stem if nothing would be left.
    """
    parent = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    stem = F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
    group = F.when(dataset == "al_emadi", path).when(dataset == "uavirbase", parent).when(dataset == "ddl", F.when(parent.isin("", "."), stem).otherwise(parent)).otherwise(F.coalesce(filled(F.regexp_replace(stem, "_\\d+_?$", "")), stem))
    return F.concat(dataset, F.lit(":"), group)


def strip_null_words(c: Column) -> Column:
    """Trimmed; null for what stands for nothing."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)
