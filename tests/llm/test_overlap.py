"""Problem 3: chunks, pigeonhole bands and cross-split pairs against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sonarmill.llm import overlap, overlap_queries


def test_cuts_cover_a_text_and_follow_its_content():
    draw = random.Random(1)
    text = "".join(draw.choice("abcdefghij ") for _ in range(5000))
    chunks = overlap.cut(text)
    assert chunks[0][0] == 0 and chunks[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(chunks, chunks[1:], strict=False))
    assert all(b - a <= overlap.MOST for a, b, _ in chunks) and all(b - a >= overlap.LEAST for a, b, _ in chunks[:-1])
    shifted = {c[2] for c in overlap.cut("xyz" + text)}
    assert len([c for c in chunks if c[2] in shifted]) > 0.9 * len(chunks)
    assert overlap.cut("") == [] and len(overlap.cut("a")) == 1
    assert overlap.cut("𝄞é" * 3)[-1][1] == 6


def test_shared_fractions(spark):
    draw = random.Random(2)
    base = "".join(draw.choice("0123456789abcdef") for _ in range(2000))
    half = base[:1000] + "".join(draw.choice("ghijk") for _ in range(1000))
    left = spark.createDataFrame([(1, base), (2, "aa"), (3, None), (4, "")], "record bigint, text string")
    right = spark.createDataFrame([(7, half), (8, base), (9, "aa")], "record bigint, text string")
    got = {(r["left"], r["right"]): r["fraction"] for r in overlap.shared(overlap.chunks(left), overlap.chunks(right)).collect()}
    assert got[1, 8] == 1 and got[2, 9] == 1 and 0.4 < got[1, 7] < 0.55 and (3, 8) not in got
    assert overlap.shared(overlap.chunks(left.where("false")), overlap.chunks(right)).count() == 0


@pytest.mark.parametrize("n", [1, 10**3, 10**5, 10**7, 10**9])
def test_every_layout_of_bands_is_exact(n):
    bands = overlap.pigeonhole(n, n)
    assert sum(f + 1 for _, _, f in bands) > overlap.PRINT_RADIUS
    assert [b[0] for b in bands] == [sum(w for _, w, _ in bands[:i]) for i in range(len(bands))] and sum(w for _, w, _ in bands) == 128
    draw = random.Random(n)
    for _ in range(300):
        flips = draw.sample(range(128), overlap.PRINT_RADIUS)
        assert any(sum(first <= b < first + width for b in flips) <= f for first, width, f in bands)


def _recordings():
    draw = random.Random(4)
    rows, prints = [], []
    for i in range(240):
        bits = draw.getrandbits(128)
        if prints and draw.random() < 0.5:
            bits = draw.choice(prints)
            for b in draw.sample(range(128), draw.randrange(0, 12)):
                bits ^= 1 << b
        prints.append(bits)
        text = draw.choice(["{:032x}", "{:032X}", " {:032x} "]).format(bits)
        sha = draw.choice(["{:064x}", "sha256:{:064x}", "{:064X} "]).format(draw.randrange(60) * 7919**12 % 2**256)
        rows.append((i, draw.choice(["train", " Training", "val", "TEST", None, "other"]), draw.choice([sha, sha, None, ""]), draw.choice([text, text, text, None, "zz", "0" * 31])))
    return rows + [(1000, "train", "f" * 64, "0" * 32), (1001, "test", "f" * 64, "0" * 32), (1002, "test", "f" * 64, "0" * 32)]


def _pairs(rows):
    def side(s):
        return {"tra": 1, "val": 2, "tes": 2}.get((s or "").strip().lower()[:3])

    def sha(s):
        return ((s or "").strip().lower().removeprefix("sha256:")) or None

    def bits(s):
        s = (s or "").strip()
        return int(s, 16) if len(s) == 32 and all(c in "0123456789abcdefABCDEF" for c in s) else None

    out = set()
    for a in rows:
        for b in rows:
            if side(a[1]) == 1 and side(b[1]) == 2:
                near = bits(a[3]) is not None and bits(b[3]) is not None and (bits(a[3]) ^ bits(b[3])).bit_count() <= 8
                if near or (sha(a[2]) and sha(a[2]) == sha(b[2])):
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_recording_pairs_against_brute_force(spark):
    rows = _recordings()
    df = spark.createDataFrame(rows, "row_seq bigint, split string, sha string, print string")
    got = [tuple(r) for r in overlap_queries.recording_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(rows)
    assert overlap_queries.recording_pairs(df.where("false")).count() == 0


def test_both_kinds_of_bands_find_the_same(spark):
    draw = random.Random(9)
    prints = [draw.getrandbits(128) for _ in range(80)]
    prints += [p ^ sum(1 << b for b in draw.sample(range(128), draw.randrange(1, 11))) for p in prints]
    df = spark.createDataFrame([(f"{p:032x}", 1 + i % 2) for i, p in enumerate(prints)], "p string, sides int")
    hi, lo = overlap.print_halves("p")
    df = df.select(hi.alias("hi"), lo.alias("lo"), "sides")
    few = sorted(tuple(r) for r in overlap.near_prints(df, 10, 10).collect())
    many = sorted(tuple(r) for r in overlap.near_prints(df, 1e9, 1e9).collect())
    expected = sum((a ^ b).bit_count() <= 8 for i, a in enumerate(prints) if i % 2 == 0 for j, b in enumerate(prints) if j % 2)
    assert few == many and len(few) == expected


def test_segment_pairs_against_brute_force(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice(["train", "train", "validation", "test", None]), draw.choice(["aa", "BB", "cc"]) + draw.choice([":", "_"]) + str(draw.randrange(12)).zfill(draw.choice([1, 4]))) for i in range(150)] + [(900, "train", None), (901, "test", ""), (902, "test", "aa:x")]
    df = spark.createDataFrame(rows, "row_seq bigint, split string, segment string")

    def key(s):
        head, _, tail = (s or "").lower().replace("_", ":").rpartition(":")
        return (head, int(tail)) if head and tail.isdigit() else None

    expected = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[1] == "train" and b[1] in ("validation", "test") and key(a[2]) and key(b[2]) and key(a[2])[0] == key(b[2])[0] and abs(key(a[2])[1] - key(b[2])[1]) <= 1}
    got = [tuple(r) for r in overlap_queries.segment_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    fractions = overlap.shared_cells(spark.createDataFrame([("r", 1, 0), ("r", 1, 1), ("r", 2, 1), ("r", 4, 1), (None, 1, 1)], "recording string, index int, side int"))
    assert {(r["left"], r["right"]): r["fraction"] for r in fractions.collect()} == {(1, 1): 1.0, (1, 2): 0.5}


def test_overlap_fractions_against_brute_force(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(5, 60)))
    parts = [word() for _ in range(12)]
    texts = {i: "".join(draw.choice(parts) for _ in range(draw.randrange(1, 9))) for i in range(80)} | {80: "", 81: "zzzz" * 40}
    df = spark.createDataFrame(list(texts.items()), "record bigint, text string")
    got = {r["record"]: r["fraction"] for r in overlap.overlap_fractions(overlap.chunks(df), F.pmod("record", F.lit(2)).cast("int") + 1).collect()}
    cuts = {i: [(t[a:b]) for a, b, _ in overlap.cut(t)] for i, t in texts.items()}
    there = [{c for i, own in cuts.items() if i % 2 == side for c in own} for side in (0, 1)]
    expected = {i: sum(len(c) for c in own if c in there[1 - i % 2]) / len(texts[i]) for i, own in cuts.items() if own}
    assert got == {i: pytest.approx(x) for i, x in expected.items() if x > 0} and 0 < min(got.values()) < 1 == max(got.values())


def test_touched_rows_are_those_in_pairs(spark):
    recordings = spark.createDataFrame(_recordings(), "row_seq bigint, split string, sha string, print string")
    segments = spark.createDataFrame([(1, "train", "aa:1"), (2, "train", "aa:2"), (3, "val", "aa:3"), (4, "test", "bb:1"), (5, "train", "AA_0003"), (6, None, "aa:3"), (7, "train", None)], "row_seq bigint, split string, segment string")
    got = {tuple(r) for r in overlap_queries.touched_rows(recordings, segments).collect()}
    expected = {("combined_manifest", x) for pair in _pairs(_recordings()) for x in pair} | {("train_shard_manifest", x) for x in (2, 3, 5)}
    assert got == expected and overlap_queries.touched_rows(recordings.where("false"), segments.where("false")).count() == 0


def test_overlaps_of_given_records(spark):
    rows = overlap_queries.p3_overlaps(spark, "/root/testdata/sf0.001")
    sides = spark.read.parquet("/root/testdata/sf0.001/combined_manifest.parquet").where(overlap_queries._sided("split").isNotNull()).count()
    assert rows.agg(F.sum("n_rows")).first()[0] == sides and rows.where("fraction < 0 OR fraction > 1").count() == 0 and rows.where("fraction > 0.5").count() > 0


def test_report_counts(spark):
    rows = overlap_queries.p3_report(spark, "/root/testdata/sf0.001")
    assert rows.where("n_overlapping > n_rows").count() == 0 and rows.agg(F.sum("n_overlapping")).first()[0] > 0
