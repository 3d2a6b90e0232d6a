"""Orphan references, also with composite keys of which parts are null (problem 5).

References are grouped by their null mask, that is, by which parts of the key are null. Each mask is anti-joined with
the targets on its non-null parts only, and a declared rule says what a mask means:

* ``simple``: a key with a null part refers to nothing and is no orphan (SQL's MATCH SIMPLE);
* ``partial``: some target must agree with the parts that are there (MATCH PARTIAL);
* ``full``: a key must be null as a whole or not at all; a mixed one is an orphan (MATCH FULL).

A key that is null as a whole refers to nothing under every rule. With ``valid``, a target also has to be there at the
reference's time: ``since <= time`` and (``until`` null or ``until > time``). A reference without a time is compared
with no interval and is no orphan.

Defined results: repeated references come out once for each row; repeated targets change nothing; an empty target table
makes every reference that refers to something an orphan. Extra columns are left out, whatever their name.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("simple", "partial", "full")


def targets(df: DataFrame, parts: Sequence[Column], since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Distinct targets ``k0, k1, ..., since, until``; of those that start at one time the one that ends last is kept."""
    keys = [p.alias(f"k{i}") for i, p in enumerate(parts)]
    names = [f"k{i}" for i in range(len(parts))]
    if since is None:
        return df.select(*keys).distinct()
    rows = df.select(*keys, since.alias("since"), F.coalesce(until, F.lit("9999-12-31").cast("timestamp_ntz")).alias("until")).where("since IS NOT NULL")
    return rows.groupBy(*names, "since").agg(F.max("until").alias("until"))


def references(df: DataFrame, row_key: Column, parts: Sequence[Column], at: Column | None = None) -> DataFrame:
    return df.select(row_key.alias("row_key"), *[p.alias(f"k{i}") for i, p in enumerate(parts)], (F.lit(None).cast("timestamp_ntz") if at is None else at).alias("at"))


def orphans(refs: DataFrame, there: DataFrame, rule: str = "simple", rules: dict[tuple[bool, ...], str] | None = None) -> DataFrame:
    """The references ``(row_key, at)`` without a target.

    ``rule`` holds for masks with some null part, unless ``rules`` names another for a mask (True: the part is null).
    A skewed key is split by adaptive execution, which splits the reference side of an anti-join.
    """
    parts = [c for c in refs.columns if c.startswith("k") and c[1:].isdigit()]
    timed = "since" in there.columns
    if timed:
        refs = refs.where("at IS NOT NULL")
    found = []
    for mask in product((False, True), repeat=len(parts)):
        declared = "partial" if not any(mask) else (rules or {}).get(mask, rule)
        if declared not in RULES:
            raise ValueError(f"unknown match rule {declared!r}; known: {', '.join(RULES)}")
        if all(mask) or declared == "simple":
            continue
        own = refs
        for part, null in zip(parts, mask, strict=True):
            own = own.where(F.col(part).isNull() if null else F.col(part).isNotNull())
        if any(mask) and declared == "full":
            found.append(own.select("row_key", "at"))
            continue
        given = [p for p, null in zip(parts, mask, strict=True) if not null]
        seen = there.where(" AND ".join(f"{p} IS NOT NULL" for p in given)).select(*[F.col(p).alias(f"t_{p}") for p in given], *(["since", "until"] if timed else []))
        if any(mask) and not timed:
            seen = seen.distinct()
        match = [F.col(p) == F.col(f"t_{p}") for p in given]
        if timed:
            match += [F.col("since") <= F.col("at"), F.col("until") > F.col("at")]
        found.append(own.join(seen, match, "left_anti").select("row_key", "at"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def by_period(found: DataFrame, table: str, period: str = "month") -> DataFrame:
    """Orphans per table and period."""
    return found.groupBy(F.lit(table).alias("table_name"), F.date_trunc(period, "at").alias("period")).agg(F.count("*").alias("orphans"))
