"""Problem 8: shares, caps and positions of a mix."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sonarmill.llm import mixing

TARGETS = [("big", 0.5, 1), ("Mid-size", 0.3, 2), ("tiny", 0.15, 3), ("none", 0.05, 1), (None, 0.1, 1)]


def _sized(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(900)] + [(1000 + i, "mid_size", 11) for i in range(200)] + [(2000 + i, "tiny", 5) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_shares_and_caps(spark):
    sized = _sized(spark)
    supplied = mixing.supply(sized, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    mixed = mixing.mix(sized, supplied)
    rows = mixed.collect()
    uses = Counter((r["source"], r["doc_id"]) for r in rows)
    caps = {"big": 1, "mid_size": 2, "tiny": 3}
    assert all(n <= caps[s] for (s, _), n in uses.items()) and len(rows) == len({(r["doc_id"], r["pass"]) for r in rows})
    assert sum(1 for (s, _), n in uses.items() if s == "tiny" and n == 3) == 6
    for r in supplied.where("demand > 0").collect():
        got = sum(x["n_tokens"] for x in rows if x["source"] == r["source"])
        assert r["demand"] <= got < r["demand"] + 17
    table = {r["source"]: r for r in mixing.shares(mixed, supplied).collect()}
    assert table["none"]["tokens_used"] == 0 and table["tiny"]["exhausted"] and not table["big"]["exhausted"]
    assert sum(r["actual_share"] for r in table.values()) == pytest.approx(1, abs=1e-4)
    assert all(0 <= r["position"] <= 1.01 * sum(r["n_tokens"] for r in rows) for r in rows) and [r["position"] for r in rows] == sorted(r["position"] for r in rows)


def test_positions_follow_the_schedule(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    for tilt in (-0.9, -0.25, 0.0, 0.5, 1.0):
        t = [r[0] for r in df.select(mixing.time_of(F.col("u"), F.lit(tilt))).collect()]
        for i, x in enumerate(t):
            assert x + tilt * (x * x - x) == pytest.approx(i / 100, abs=1e-9)
    sized = _sized(spark)
    supplied = mixing.supply(sized, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    tilts = {"big": -0.8, "mid_size": 0.8, "tiny": 0.8}
    rows = mixing.mix(sized, supplied, F.when(F.col("source") == "big", -0.8).otherwise(0.8)).collect()
    given = Counter()
    for r in rows:
        given[r["source"]] += r["n_tokens"]
    total = sum(given.values())
    for cut in range(1, 11):  # tokens before a position are the position, and each source has what its schedule says by then
        upto = [r for r in rows if r["position"] <= cut / 10 * total]
        assert sum(r["n_tokens"] for r in upto) == pytest.approx(cut / 10 * total, abs=0.01 * total)
        low, high = 0.0, 1.0
        for _ in range(50):
            t = (low + high) / 2
            low, high = (t, high) if sum(g * (t + tilts[s] * (t * t - t)) for s, g in given.items()) < cut / 10 * total else (low, t)
        for s, g in given.items():
            assert sum(r["n_tokens"] for r in upto if r["source"] == s) == pytest.approx(g * (low + tilts[s] * (low * low - low)), abs=0.02 * g + 12)


def test_tokens_and_odd_documents(spark):
    rows = [(1, "Big", "hello world"), (2, "big", ""), (3, None, "x"), (None, "big", "x"), (4, "big ", "é" * 50_000), (5, "big", None)]
    sized = {r["doc_id"]: r["n_tokens"] for r in mixing.sizes(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert set(sized) == {1, 4} and sized[1] == 2 and sized[4] > 1000
    empty = mixing.supply(_sized(spark).where("false"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    assert mixing.mix(_sized(spark).where("false"), empty).count() == 0
