"""Eager aggregation through joins, for keys that hold most rows (problem 2).

Both inputs are reduced to one compact state per key before anything is joined; partial aggregation on the map side
means that a key holding a third of all rows sends one row per map task, not its rows. The join then works on states,
and what a row-level join would have given follows algebraically: the number of joined rows is the product of the
counts, the sum of a left value over the joined rows is its left sum times the right count.

Defined results: rows whose key is null count in the table's total and in no state; a null source is one source of its
own kind and is not counted; null times are left out of first and last. Empty tables give no states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT = "decimal(38,0)"


def key_states(df: DataFrame, key: Column, source: Column | None = None, time: Column | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: ``key_value, n_rows, n_sources, first_at, last_at`` and the sums asked for.

    Aggregated twice, by (key, source) and then by key, so that the distinct sources need no set in one task.
    """
    sums = sums or {}
    rows = df.select(key.alias("key_value"), (F.lit(None).cast("string") if source is None else source).alias("source"), (F.lit(None).cast("timestamp_ntz") if time is None else time).alias("at"), *[v.alias(f"s_{k}") for k, v in sums.items()]).where("key_value IS NOT NULL")
    by_source = rows.groupBy("key_value", "source").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in sums])
    return by_source.groupBy("key_value").agg(F.sum("n").alias("n_rows"), F.count("source").alias("n_sources"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), *[F.sum(f"s_{k}").alias(k) for k in sums])


def join_states(left: DataFrame, right: DataFrame, how: str = "full_outer") -> DataFrame:
    """States of two inputs by key; ``joined_rows`` is how many rows an inner join of the inputs would have.

    Columns of the right side get the prefix ``other_``. Counts missing on one side are 0.
    """
    other = right.select("key_value", *[F.col(c).alias(f"other_{c}") for c in right.columns if c != "key_value"])
    joined = left.join(other, "key_value", how)
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({"n_rows": F.coalesce("n_rows", zero), "other_n_rows": F.coalesce("other_n_rows", zero)}).withColumn("joined_rows", (F.col("n_rows").cast("decimal(19,0)") * F.col("other_n_rows").cast("decimal(19,0)")).cast(COUNT))


def joined_sum(column: str, of_left: bool = True) -> Column:
    """The sum of a value over the joined rows, from the states."""
    return (F.col(column) if of_left else F.col(f"other_{column}")) * F.col("other_n_rows" if of_left else "n_rows")


def heavy_keys(states: DataFrame, table: DataFrame, share: float) -> DataFrame:
    """The states of the keys that hold at least ``share`` of all rows of ``table``, null keys counted."""
    total = table.select(F.count("*").alias("n")).scalar()
    return states.where((F.col("n_rows") > 0) & (F.col("n_rows") >= F.lit(share) * total))


def roll_up(joined: DataFrame, by: Column) -> DataFrame:
    """Joined states rolled up to a coarser key: keys, rows on each side and joined rows."""
    return joined.groupBy(by.alias("part")).agg(F.count("*").alias("keys"), F.sum("n_rows").alias("n_rows"), F.sum("other_n_rows").alias("other_rows"), F.sum("joined_rows").cast("double").alias("joined_rows"), F.max("n_rows").alias("largest_key_rows"))
