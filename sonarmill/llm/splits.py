"""Splits that keep related records together, by frontier breadth-first components (problem 6).

Records that share a value of any link column belong together. The link values are the vertices, numbered by a 64-bit
hash that is checked for collisions; two values on one record are an edge. Most values touch one other value only: they
follow that value and need no search. What is left, values that tie several others together, is searched: ``reached_labels``
hash-partitions the adjacency lists and expands many seeds at once; where two seeds meet, their pair goes into a small
graph of seed labels, which is merged at the end by star contraction. A vertex is visited once, so the work follows the
edges, not the diameter times the vertices.

``assign`` puts whole components into splits in the order of their hash, within each stratum of labels. Components of at
least ``heavy`` of a stratum are placed first, largest first, where most is missing; there are at most 1 / heavy of
them, so the driver may hold them, and the rest fills what they left.

Defined results: a record whose link values are all null is a component of its own. Records with both labels in
their component form the stratum ``mixed``, those without a label ``none``. Repeated records change nothing but the
counts. An empty table gives an empty assignment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarmill.session import cut_lineage, release, written

#: One vertex in so many starts a search at first; then every vertex that no search has reached.
SEED_ONE_IN = (8, 1)
HEAVY = 0.01
RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def numbered(df: DataFrame, key: Column, links: dict[str, Column], salts: int = 8) -> DataFrame:
    """``(key, vertices)``: the numbers of each record's link values that are not null.

    Two values with one number would tie records together that have nothing in common, so a second hash of every value
    is compared; where it differs, all are numbered anew with another salt.
    """
    rows = df.select(key.alias("key"), *[v.alias(f"l_{k}") for k, v in links.items()])
    for salt in range(salts):
        hashed = [F.when(F.col(f"l_{k}").isNotNull(), F.struct(F.xxhash64(F.lit(salt), F.lit(k), f"l_{k}").alias("vertex"), F.xxhash64(f"l_{k}", F.lit(k)).alias("check"))) for k in links]
        each = rows.select("key", F.array_compact(F.array(*hashed)).alias("each"))
        twice = each.select(F.inline("each")).groupBy("vertex").agg((F.min("check") < F.max("check")).alias("twice")).where("twice")
        if not twice.head(1):
            return each.select("key", F.array_distinct(F.transform("each", lambda x: x["vertex"])).alias("vertices"))
    raise RuntimeError("link values can't be numbered without collisions")


def edges_of(vertices: DataFrame) -> DataFrame:
    """Distinct edges ``(u, v)`` with u < v between the least vertex of a record and each other one."""
    least = F.array_min("vertices")
    return vertices.select(least.alias("u"), F.explode(F.array_remove(F.col("vertices"), least)).alias("v")).distinct()


def _merged(pairs: DataFrame) -> DataFrame:
    """``(label, root)`` for the small graph of seed labels: star contraction until nothing changes."""
    edges = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct())
        release(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("label"), F.col("b").alias("root"))
        before = now


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _few(parts: list[DataFrame], most: int = 8) -> list[DataFrame]:
    """The same rows in fewer parts, so that many rounds don't add up to very many partitions."""
    if len(parts) <= most:
        return parts
    one = written(_all(parts).distinct())
    release(*parts)
    return [one]


def reached_labels(edges: DataFrame, one_in: Sequence[int] = SEED_ONE_IN) -> DataFrame | None:
    """``(vertex, component)`` of all vertices of the edges ``(u, v)``, given once each; None without edges."""
    both = cut_lineage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u"))
    if not both.head(1):
        return None
    linked = both.select(F.col("u").alias("vertex")).distinct()
    layers: list[DataFrame] = []
    meetings: list[DataFrame] = []
    for k in one_in:
        free = linked.join(_all(layers), "vertex", "left_anti") if layers else linked
        frontier = written(free.where(F.pmod(F.xxhash64("vertex"), F.lit(k)) == 0).select("vertex", F.col("vertex").alias("label")))
        while frontier.head(1):
            layers = [*_few(layers), frontier]
            # the frontier is small beside the edges and the vertices seen: both are read in place, and what is shuffled follows the frontier
            reached = both.join(frontier.withColumnRenamed("vertex", "u"), "u").select(F.col("v").alias("vertex"), "label").distinct()
            seen = _all(layers).withColumnRenamed("label", "old").join(reached.select("vertex").distinct(), "vertex")
            met = written(reached.join(seen, "vertex", "left"))
            frontier = written(met.where("old IS NULL").groupBy("vertex").agg(F.min("label").alias("label")))
            late = met.where("old IS NOT NULL AND old <> label").select(F.col("old").alias("a"), F.col("label").alias("b"))
            same = met.where("old IS NULL").join(frontier.withColumnRenamed("label", "first"), "vertex").where("first <> label").select(F.col("first").alias("a"), F.col("label").alias("b"))
            meetings = _few([*meetings, written(late.unionByName(same).distinct())])
            release(met)
    roots = _merged(_all(meetings))
    found = _all(layers).join(roots, "label", "left").select("vertex", F.coalesce("root", "label").alias("component"))
    return found


def components(edges: DataFrame, one_in: Sequence[int] = SEED_ONE_IN) -> DataFrame:
    """``(vertex, component)`` of every vertex of the distinct edges ``(u, v)``, u < v, that isn't a component's name itself.

    A vertex with one neighbour follows it, of two with each other the larger one. Only edges between vertices that both
    have several neighbours are searched.
    """
    edges = cut_lineage(edges)
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = cut_lineage(ends.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")))
    tied = known.where("n > 1").select(F.col("u").alias("vertex"))
    core = edges.join(tied.withColumnRenamed("vertex", "v"), "v", "left_semi").join(tied.withColumnRenamed("vertex", "u"), "u", "left_semi").select("u", "v")
    labels = reached_labels(core, one_in)
    # of a pair with no other neighbour the smaller one is the component
    single = known.where("n = 1").select(F.col("u").alias("vertex"), F.col("v").alias("above"))
    lone = single.alias("s").join(known.where("n = 1").select(F.col("u").alias("above"), F.lit(True).alias("mutual")), "above", "left")
    leaves = lone.where("mutual IS NULL OR above < vertex").select("vertex", "above")
    if labels is None:
        return leaves.select("vertex", F.col("above").alias("component"))
    named = leaves.join(labels.withColumnRenamed("vertex", "above"), "above", "left").select("vertex", F.coalesce("component", "above").alias("component"))
    return labels.unionByName(named)


def record_components(df: DataFrame, key: Column, links: dict[str, Column]) -> DataFrame:
    """``(key, component)`` for every record: the number of a vertex; null for records without link values. Needs a unique ``key``."""
    vertices = numbered(df, key, links)
    found = components(edges_of(vertices))
    named = vertices.select("key", F.array_min("vertices").alias("vertex"))
    return named.join(found, "vertex", "left").select("key", F.coalesce("component", "vertex").alias("component"))


def component_states(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per component of ``(component, split, label)``: rows, which splits and labels occur, and ``more``."""
    return rows.groupBy("component").agg(
        F.count("*").alias("n_rows"),
        *more,
        *[F.max(F.coalesce((F.col("split") == s).cast("int"), F.lit(0))).alias(f"in_{s}") for s in RATIOS],
        *[F.max(F.coalesce((F.col("label") == v).cast("int"), F.lit(0))).alias(f"has_{v}") for v in (0, 1)],
    )


def violations(states: DataFrame) -> DataFrame:
    """The states with a ``kind``: ``split`` for components in two or more splits, ``label`` for those with both labels."""
    flags = F.array(F.when(sum((F.col(f"in_{s}") for s in RATIOS), F.lit(0)) >= 2, "split"), F.when((F.col("has_0") == 1) & (F.col("has_1") == 1), "label"))
    return states.select("*", F.explode(F.array_compact(flags)).alias("kind"))


def assign(states: DataFrame, ratios: dict[str, float] | None = None, heavy: float = HEAVY, seed: int = 42, by: str = "component") -> DataFrame:
    """``(component, stratum, n_rows, split)``: a new split for every component of ``component_states``, in the order of a digest of ``by``."""
    ratios = ratios or RATIOS
    names = list(ratios)
    if abs(sum(ratios.values()) - 1) > 1e-9 or min(ratios.values()) <= 0:
        raise ValueError("ratios must be positive and sum to 1")
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(by).cast("string"))), 1, 15), 16, 10).cast("bigint")
    stratum = F.when(F.col("has_0") + F.col("has_1") == 2, "mixed").when(F.col("has_1") == 1, "1").when(F.col("has_0") == 1, "0").otherwise("none")
    each = cut_lineage(states.select("component", stratum.alias("stratum"), "n_rows", order.alias("order"), F.shiftright(order, 48).alias("range")))
    totals = {r["stratum"]: r["n"] for r in each.groupBy("stratum").agg(F.sum("n_rows").alias("n")).collect()}  # at most four rows
    limit = F.lit(None).cast("double")
    for name, total in totals.items():
        limit = F.when(F.col("stratum") == name, F.lit(heavy * total)).otherwise(limit)
    each = each.withColumn("heavy", F.col("n_rows") >= limit)
    left = {s: {n: ratios[n] * total for n in names} for s, total in totals.items()}
    placed = []
    for row in each.where("heavy").orderBy(F.desc("n_rows"), "order", "component").select("component", "stratum", "n_rows").toLocalIterator():  # at most 1 / heavy per stratum
        room = left[row["stratum"]]
        best = max(names, key=lambda n: room[n])
        room[best] -= row["n_rows"]
        placed.append((row["component"], best))
    light = each.where("NOT heavy")
    sums = light.groupBy("stratum", "range").agg(F.sum("n_rows").alias("n"))
    w = Window.partitionBy("stratum").orderBy("range")
    starts = sums.select("stratum", "range", (F.sum("n").over(w) - F.col("n")).alias("start"))  # at most 4,096 rows in a stratum
    within = Window.partitionBy("stratum", "range").orderBy("order", "component")
    middle = F.col("start") + F.sum("n_rows").over(within) - F.col("n_rows") / 2
    split = F.lit(names[0])
    for name in totals:
        room = [max(0.0, left[name][n]) for n in names]
        free = sum(room) or 1.0
        scale = max(1e-9, totals[name] - sum(ratios[n] * totals[name] - left[name][n] for n in names)) / free
        edges = [sum(room[: i + 1]) * scale for i in range(len(names) - 1)]
        choice = F.lit(names[-1])
        for n, edge in reversed(list(zip(names, edges, strict=False))):
            choice = F.when(F.col("middle") <= edge, n).otherwise(choice)
        split = F.when(F.col("stratum") == name, choice).otherwise(split)
    spread = light.join(F.broadcast(starts), ["stratum", "range"]).withColumn("middle", middle).select("component", "stratum", "n_rows", split.alias("split"))
    known = each.sparkSession.createDataFrame(placed, T.StructType([T.StructField("component", states.schema["component"].dataType), T.StructField("split", T.StringType())]))
    return spread.unionByName(each.where("heavy").join(known, "component").select("component", "stratum", "n_rows", "split"))
