"""Problem 6: components against union-find, and what a split must keep."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sonarmill.llm import splits


def _union_find(rows):
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for key, a, b in rows:
        for kind, value in (("a", a), ("b", b)):
            if value:
                above[top((kind, value))] = top(("row", key))
    groups = defaultdict(set)
    for key, *_ in rows:
        groups[top(("row", key))].add(key)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed,links", [(1, 40), (2, 400), (3, 25)])
def test_components_against_union_find(spark, seed, links):
    draw = random.Random(seed)
    rows = [(i, draw.choice([f"g{draw.randrange(24)}", "hot", None]) if seed != 2 else f"g{draw.randrange(150)}", draw.choice([f"s{draw.randrange(links)}", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, a string, b string")
    found = splits.record_components(df, F.col("k"), {"a": F.col("a"), "b": F.col("b")}).collect()
    groups = defaultdict(set)
    for r in found:
        groups[("row", r["key"]) if r["component"] is None else r["component"]].add(r["key"])
    assert sorted(map(sorted, groups.values())) == _union_find(rows)


def test_components_of_a_long_chain(spark):
    rows = [(i, f"a{i}", f"a{i + 1}") for i in range(24)]
    df = spark.createDataFrame(rows, "k bigint, a string, b string")
    one = splits.record_components(df, F.col("k"), {"l": F.col("a"), "m": F.col("b")})
    assert one.select("component").distinct().count() == 24  # values of different links are different
    edges = spark.createDataFrame([(i, i + 1) for i in range(24)], "u bigint, v bigint")
    found = splits.components(edges)
    assert found.count() == found.select("vertex").distinct().count() == 25 and found.select("component").distinct().count() == 1
    assert splits.reached_labels(edges.where("false")) is None


def test_stars_and_pairs_need_no_search(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(splits, "reached_labels", lambda core, *_: searched.append(core.count()))
    edges = spark.createDataFrame([(1, x) for x in range(10, 40)] + [(2, 3), (5, 50), (5, 51), (4, 60), (9, 60)], "u bigint, v bigint")
    got = {r["vertex"]: r["component"] for r in splits.components(edges).collect()}
    assert searched == [0]
    assert got == {**{x: 1 for x in range(10, 40)}, 3: 2, 50: 5, 51: 5, 4: 60, 9: 60}


def test_colliding_numbers_are_drawn_anew(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, a string")
    real = F.xxhash64
    salted = lambda salt: str(salt._jc.toString()) if hasattr(salt, "_jc") else ""
    monkeypatch.setattr(splits.F, "xxhash64", lambda *c: F.lit(7).cast("bigint") if salted(c[0]) == "0" else real(*c))
    got = splits.record_components(df, F.col("k"), {"a": F.col("a")}).collect()
    assert len({r["component"] for r in got}) == 2


def test_given_manifest_is_split_without_straddling(spark):
    from sonarmill.llm.splits_queries import p6_assignment

    rows = p6_assignment(spark, "/root/testdata/sf0.01").collect()
    shas = {r[0]: (r[1] or "").strip().lower().removeprefix("sha256:") for r in spark.read.parquet("/root/testdata/sf0.01/combined_manifest.parquet").select("row_seq", "sha256").collect()}
    for key in (lambda r: r["group"], lambda r: shas[r["row_seq"]] or None):
        held = defaultdict(set)
        for r in rows:
            held[key(r)].add(r["new_split"])
        assert all(len(v) == 1 for k, v in held.items() if k is not None)
    for label in (0, 1):
        mine = [r["new_split"] for r in rows if r["label"] == label]
        assert {s: pytest.approx(mine.count(s) / len(mine), abs=0.01) for s in splits.RATIOS} == splits.RATIOS


def _states(spark, sizes):
    return spark.createDataFrame([(f"c{i}", n, *s, *h) for i, (n, s, h) in enumerate(sizes)], "component string, n_rows bigint, in_train int, in_validation int, in_test int, has_0 int, has_1 int")


def test_assignment_keeps_components_and_proportions(spark):
    draw = random.Random(8)
    sizes = [(draw.randrange(1, 6), (1, 0, 0), draw.choice([(1, 0), (0, 1)])) for _ in range(3000)] + [(3000, (1, 1, 0), (0, 1)), (900, (1, 0, 0), (1, 0)), (500, (0, 1, 0), (1, 0)), (40, (1, 1, 1), (1, 1)), (3, (0, 0, 0), (0, 0))]
    states = _states(spark, sizes)
    got = splits.assign(states).collect()
    assert Counter(r["component"] for r in got) == Counter({f"c{i}": 1 for i in range(len(sizes))})
    for stratum in ("0", "1"):
        rows = Counter()
        for r in got:
            if r["stratum"] == stratum:
                rows[r["split"]] += r["n_rows"]
        whole = sum(rows.values())
        assert {s: pytest.approx(rows[s] / whole, abs=0.01) for s in splits.RATIOS} == splits.RATIOS
    again = splits.assign(states.repartition(13)).collect()
    assert {r["component"]: r["split"] for r in got} == {r["component"]: r["split"] for r in again}
    assert splits.assign(states.where("false")).count() == 0
    with pytest.raises(ValueError):
        splits.assign(states, {"train": 0.9, "test": 0.2})


def test_violations(spark):
    rows = spark.createDataFrame([("a", "train", 0), ("a", "test", None), ("b", "train", 0), ("b", "train", 1), ("c", None, 1), ("c", "test", 1), ("d", None, None)], "component string, split string, label int")
    got = sorted((r["kind"], r["component"]) for r in splits.violations(splits.component_states(rows)).collect())
    assert got == [("label", "b"), ("split", "a")]
