"""Sliding windows over samples in closed form: no loop, one row per recording becomes its segments by ``inline``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Windows:
    """Window, hop and least tail in samples. A tail that adds nothing to the last full window is no segment."""

    window: int = 64_000
    hop: int = 32_000
    least_tail: int = 4_000
    pad_tail: bool = True

    def __post_init__(self) -> None:
        if self.window <= 0 or self.hop <= 0 or self.least_tail <= 0:
            raise ValueError("window, hop and least tail must be positive")
        if self.hop > self.window or self.least_tail > self.window:
            raise ValueError("hop and least tail must not exceed the window")

    @classmethod
    def of_seconds(cls, window: float = 4.0, hop: float = 2.0, least_tail: float = 0.25, rate: int = 16_000) -> Windows:
        return cls(round(window * rate), round(hop * rate), round(least_tail * rate))


def bounds(samples: Column, w: Windows) -> Column:
    """``array<struct<index, start, end, is_padded>>`` for a number of samples; end is exclusive and excludes padding."""
    n = samples.cast("bigint")
    full = F.when(n >= w.window, F.floor((n - w.window) / w.hop) + 1).otherwise(F.lit(0)).cast("bigint")
    covered = F.when(full > 0, (full - 1) * w.hop + w.window).otherwise(F.lit(0))
    tail = full * w.hop
    whole = F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), F.greatest(full, F.lit(1)) - 1), lambda i: i < full), lambda i: F.struct(i.cast("int").alias("index"), (i * w.hop).alias("start"), (i * w.hop + w.window).alias("end"), F.lit(False).alias("is_padded")))
    rest = F.array(F.struct(full.cast("int").alias("index"), tail.alias("start"), n.alias("end"), F.lit(w.pad_tail).alias("is_padded")))
    return F.when(n.isNotNull(), F.when((tail < n) & (n > covered) & (n - tail >= w.least_tail), F.concat(whole, rest)).otherwise(whole))


def segments(df: DataFrame, samples: str, w: Windows | None = None) -> DataFrame:
    """``df`` with a row for each of its segments; recordings too short for one have none."""
    return df.select("*", F.inline(bounds(F.col(samples), w or Windows())))


def chunks(df: DataFrame, samples: str, window: int, hop: int, least: int) -> DataFrame:
    """Windows for a live view: never padded, the last may be shorter but not below ``least``; stops at the end."""
    n = F.col(samples).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)), F.lit(hop).cast("bigint"))
    cut = df.where(n >= least).select("*", F.posexplode(starts).alias("index", "start")).withColumn("end", F.least(F.col("start") + window, n))
    return cut.where((F.col("end") - F.col("start") >= least) & ((F.col("start") == 0) | (F.col("start") + window - hop < n)))
