"""Running totals over large groups without a task for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_totals(df: DataFrame, by: Sequence[str], stretch: Column, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with running sums ``name`` over each group, up to and with the row.

    ``stretch`` must never fall along ``order``. A group is cut into its stretches: their sums are accumulated first,
    and rows are sorted within a stretch only, so that no task sorts a whole group.
    """
    cut = df.withColumn("__stretch", stretch)
    parts = cut.groupBy(*by, "__stretch").agg(*[F.sum(v).alias(f"__{k}") for k, v in values.items()])
    w = Window.partitionBy(*by).orderBy("__stretch") if by else Window.orderBy("__stretch")
    starts = parts.select(*by, "__stretch", *[(F.sum(f"__{k}").over(w) - F.col(f"__{k}")).alias(f"__start_{k}") for k in values])
    within = Window.partitionBy(*by, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(starts, [*by, "__stretch"])
    return joined.withColumns({k: F.col(f"__start_{k}") + F.sum(v).over(within) for k, v in values.items()}).drop("__stretch", *[f"__start_{k}" for k in values])


def running_total(df: DataFrame, by: Sequence[str], order: str, value: str, tie: str, ranges: int = 4096) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the group that come earlier in ``(order, tie)``.

    ``order`` must be a bigint spread over its range, such as a hash; it is cut into ``ranges`` stretches.
    """
    bits = max(0, 64 - (ranges - 1).bit_length())
    out = ordered_totals(df, by, F.shiftright(F.col(order), bits), [F.col(order), F.col(tie)], {"before": F.col(value)})
    return out.withColumn("before", F.col("before") - F.col(value))


def ordered_bits(c: Column) -> Column:
    """A bigint that rises with the double, so that its leading bits cut any distribution of values into fine stretches.

    Made of the exponent and 20 bits of the fraction, which built-in functions give; equal numbers say nothing of the rest.
    """
    size = F.abs(c)
    power = F.greatest(F.lit(-1021), F.least(F.lit(1023), F.floor(F.log2(size)).cast("int")))
    part = F.greatest(F.lit(0), F.least(F.lit((1 << 20) - 1), F.floor((size / F.pow(F.lit(2.0), power) - 1) * (1 << 20)).cast("int")))
    bits = (power + 1022).cast("bigint") * (1 << 20) + part
    return F.when(size > 0, F.when(c < 0, -bits - 1).otherwise(bits + 1)).otherwise(F.lit(0).cast("bigint"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of a double column per group; nulls are left out, a group without values has no row.

    Values are counted, then cut into stretches by their leading bits; the sums of the stretches say where a rank lies, and
    only there are values looked at. No task keeps all distinct values, as the built-in exact percentile does.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    run = ordered_totals(counts, by, ordered_bits(F.col("__v")), [F.col("__v")], {"__upto": F.col("__n")})
    whole = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    both = run.join(F.broadcast(whole), list(by)) if by else run.crossJoin(F.broadcast(whole))  # a row for each group; without groups one row
    out = []
    for name, q in wanted.items():
        rank = q * (F.col("__all") - 1)
        for end, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            out.append(F.min(F.when(F.col("__upto") > at, F.col("__v"))).alias(f"__{end}_{name}"))
        out.append(F.first(rank - F.floor(rank)).alias(f"__part_{name}"))
    ends = both.groupBy(*by).agg(*out)
    return ends.select(*by, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")).alias(n) for n in wanted])


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)
