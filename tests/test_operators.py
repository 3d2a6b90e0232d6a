"""Operators of the manifests, metrics, diagnostics, sampling and signals: hand-worked cases and odd inputs."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarmill.functions import dsp, parsing, signals
from sonarmill.operators import diagnostics, manifests, metrics, prefix, sampling, scoring, segmentation


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# manifests


def test_dedup_and_quarantine(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "b", 1), (5, None, 1), (6, "c", None)], "seq int, sha string, label int")
    assert [r["seq"] for r in manifests.deduplicate(df, "sha", "label", "seq").orderBy("seq").collect()] == [1, 6]
    assert [r["seq"] for r in manifests.conflicts(df, "sha", "label", "seq").orderBy("seq").collect()] == [3, 4]
    assert tuple(manifests.dedup_summary(df, "sha", "label", "seq").first()) == (2, 1, 2, 1)
    once = manifests.deduplicate(df, "sha", "label", "seq")
    assert rows(manifests.deduplicate(once, "sha", "label", "seq")) == rows(once)


def test_group_split_keeps_groups_and_targets(spark):
    draw = random.Random(1)
    data = [(f"g{i % 97 if i % 5 else 3}", (i % 97 if i % 5 else 3) % 2) for i in range(4000)] + [("mixed", 0), ("mixed", 1), (None, 0)]
    draw.shuffle(data)
    df = spark.createDataFrame(data, "g string, y int")
    got = manifests.group_split(df, "g", "y")
    assert got.count() == got.select("group").distinct().count() == 97 and got.where("group = 'mixed'").count() == 0
    for label in (0, 1):
        sizes = {r["split"]: r["n"] for r in got.where(F.col("label") == label).groupBy("split").agg(F.sum("n").alias("n")).collect()}
        assert set(sizes) == set(manifests.SPLITS) and sizes["train"] > sizes["validation"]
    assert rows(got) == rows(manifests.group_split(df.repartition(11), "g", "y"))
    assert rows(manifests.mixed_groups(df, "g", "y")) == [("mixed", 2)]
    with pytest.raises(ValueError):
        manifests.checked_ratios((0.5, 0.5, 0.5))


def test_integrity(spark):
    df = spark.createDataFrame([("k1", "train"), ("k1", "test"), ("k2", "train"), (None, "test"), ("k3", None)], "k string, s string")
    assert [tuple(r)[1:] for r in manifests.split_overlaps(df.withColumnRenamed("k", "key_col"), ["key_col"], "s").collect()] == [("train", "test", 1, "k1")]
    other = spark.createDataFrame([("k1",), ("k9",)], "k string")
    assert rows(manifests.missing_from(df, other, "k")) == [("k2",), ("k3",)]
    a, b = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert rows(manifests.differing_rows(a, b)) == [(1, "left"), (2, "right")]
    with pytest.raises(ValueError, match="b, c"):
        manifests.require_columns(a, ["x", "c", "b"])
    wide = spark.createDataFrame([(1, 2)], "Segment_ID int, confidence int")
    assert manifests.resolve_column(wide, ["id", "segment_id"]) == "Segment_ID" and manifests.resolve_column(wide, ["segment_id"], exact_case=True) is None and manifests.columns_like(wide, "CONF") == ["confidence"]


@pytest.mark.parametrize("n", [255, 256, 257])
def test_shard_numbers(spark, n):
    got = manifests.shard_numbers(spark.range(n).select(F.lit("s").alias("p"), (F.col("id") * 40_000).alias("seq")), ["p"], "seq").orderBy("seq").collect()
    assert [(r["shard_no"], r["slot"]) for r in got] == [(i // 256, i % 256) for i in range(n)]


def test_recording_groups(spark):
    df = spark.createDataFrame([("al_emadi", "a/b.wav", "b.wav"), ("uavirbase", "r1/t/output.wav", "output.wav"), ("ddl", "x.wav", "x.wav"), ("ddl", "s/T1/x.wav", "x.wav"), ("o", "rec_12.wav", "rec_12.wav"), ("o", "rec_12_.wav", "rec_12_.wav"), ("o", "_7.wav", "_7.wav")], "d string, p string, n string")
    assert [r[0] for r in df.select(manifests.recording_group(F.col("d"), F.col("p"), F.col("n"))).collect()] == ["al_emadi:a/b.wav", "uavirbase:r1/t", "ddl:x", "ddl:s/T1", "o:rec", "o:rec", "o:_7"]


# segments


def _loop(n, w, h, m):
    out, last, start = [], 0, 0
    while start < n:
        end = start + w
        if end <= n:
            out.append((start, end, False))
            last = end
        elif n > last and n - start >= m:
            out.append((start, n, True))
            last = n
        start += h
    return out


@pytest.mark.parametrize("w,h,m", [(64_000, 32_000, 4_000), (10, 3, 2), (7, 7, 7), (5, 5, 1)])
def test_segments_equal_the_loop(spark, w, h, m):
    sizes = [0, 3_999, 4_000, 64_000, 64_001, 96_000, 200_000] if w > 1000 else list(range(60))
    df = spark.createDataFrame([(n,) for n in [*sizes, None]], "n bigint")
    got = {n: [] for n in sizes}
    for r in segmentation.segments(df, "n", segmentation.Windows(w, h, m)).orderBy("n", "index").collect():
        got[r["n"]].append((r["start"], r["end"], r["is_padded"]))
    # a hop below the window may leave a tail after the first one that adds nothing; only the first tail counts
    for n in sizes:
        whole = [s for s in _loop(n, w, h, m) if not s[2]]
        tail = [s for s in _loop(n, w, h, m) if s[2] and s[0] == len(whole) * h]
        assert got[n] == whole + tail
    with pytest.raises(ValueError):
        segmentation.Windows(5, 6, 1)


# metrics


def _predictions(spark, data):
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(data)], "seq bigint, label int, score double")


def test_metrics_by_hand(spark):
    df = _predictions(spark, [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (1, 0.1), (None, 0.3), (1, None)])
    r = metrics.at_threshold(df, 0.5).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 1) and r["precision"] == pytest.approx(2 / 3) and r["recall"] == pytest.approx(2 / 3) and r["accuracy"] == pytest.approx(60)
    assert metrics.roc_auc(df).first()[0] == pytest.approx((0.5 + 1 + 1 + 0 + 0 + 1 - 0) / 6 if False else sum((p > q) + 0.5 * (p == q) for p in (0.9, 0.5, 0.1) for q in (0.9, 0.4)) / 6)
    empty = df.where("false")
    assert metrics.roc_auc(empty).first()[0] is None and metrics.pr_auc(empty, "seq").first()[0] is None
    r = metrics.at_threshold(empty, 0.5).first()
    assert r["tp"] == 0 and r["f1"] == 0.0
    assert metrics.roc_auc(df.where("label = 1")).first()[0] is None


def test_sweep_and_thresholds_by_brute_force(spark):
    draw = random.Random(7)
    grid = metrics.grid()
    data = [(draw.randrange(2), draw.choice([draw.random(), grid[draw.randrange(181)], -0.1, 1.5])) for _ in range(500)]
    df = _predictions(spark, data)
    swept = {r["step"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in metrics.sweep(df).collect()}
    for i, t in enumerate(grid):
        assert swept[i] == tuple(sum(1 for y, p in data if (p >= t) == hit and y == label) for hit, label in ((True, 1), (True, 0), (False, 1), (False, 0)))
    assert np.allclose(grid, np.linspace(0.05, 0.95, 181), rtol=0, atol=0)
    f1 = [2 * tp / (2 * tp + fp + fn) if tp else 0.0 for tp, fp, fn, _ in (swept[i] for i in range(181))]
    best = metrics.best_threshold(metrics.sweep(df), "first").first()
    assert best["threshold"] == grid[f1.index(max(f1))] and best["f1"] == pytest.approx(max(f1))
    assert metrics.best_threshold(metrics.sweep(df.where("false")), "recall").first()["f1"] == 0.0
    with pytest.raises(ValueError):
        metrics.best_threshold(metrics.sweep(df), "other")


def test_curves_against_definitions(spark):
    draw = random.Random(3)
    data = [(draw.randrange(2), round(draw.random(), 2)) for _ in range(400)]
    df = _predictions(spark, data).repartition(5)
    order = sorted(range(400), key=lambda i: (-data[i][1], i))
    tp, area, before = 0, 0.0, (0.0, 1.0)
    whole = sum(y for y, _ in data)
    for n, i in enumerate(order, 1):
        tp += data[i][0]
        area += (tp / whole - before[0]) * (tp / n + before[1]) / 2
        before = (tp / whole, tp / n)
    assert metrics.pr_auc(df, "seq").first()[0] == pytest.approx(area, abs=1e-12)
    wins = sum((a > b) + 0.5 * (a == b) for y, a in data if y for z, b in data if not z)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(wins / (whole * (400 - whole)), abs=1e-12)


# diagnostics


def test_runs_and_shares(spark):
    df = spark.createDataFrame([("r", n) for n in [1, 2, 3, 3, 5, 7, 8, 9, -1, None]] + [("s", -1)], "r string, n int")
    assert [tuple(x) for x in diagnostics.runs(df, ["r"], "n").collect()] == [("r", "1-3, 5, 7-9", 3, 7)]
    counts = spark.createDataFrame([("k", "a", 6), ("k", "b", 3), ("k", "c", 1)], "g string, r string, n bigint")
    r = diagnostics.top_shares(counts, ["g"], "r", "n").first()
    assert (r["largest_key"], r["top_1"], r["top_3_share"], r["n_keys"]) == ("a", 6, 1.0, 3)


def test_health_and_ids_in_texts(spark):
    flat, steep = [[1.0, 1.0], [0.0, 1e-5]], [[20.0, 20.0], [1.0, 1.0]]
    df = spark.createDataFrame([(1, flat), (2, steep), (3, flat), (4, [[float("nan"), 1.0], [1.0, 2.0]])], "i int, f array<array<double>>")
    out = {r["i"]: r["h"] for r in df.select("i", diagnostics.health(F.col("f")).alias("h")).collect()}
    assert out[2]["blow_up"] and not out[1]["blow_up"] and out[4]["non_finite"] and out[1]["feature_hash"] == out[3]["feature_hash"] != out[2]["feature_hash"]
    texts = spark.createDataFrame([(1, "see ABC and abcd"), (2, None), (3, "nothing"), (4, "xabcdx xabcdx")], "k int, t string")
    assert rows(diagnostics.texts_with_ids(texts, "k", "t", ["abc", "abcd", ""])) == [(1, "abc"), (1, "abcd"), (4, "abc"), (4, "abcd")]
    assert diagnostics.texts_with_ids(texts, "k", "t", []).count() == 0
    assert rows(diagnostics.texts_with_ids(texts, "k", "t", ["abc", "abcd", "noth"], block_chars=3)) == [(1, "abc"), (1, "abcd"), (3, "noth"), (4, "abc"), (4, "abcd")]


# sampling


def test_weights_and_draws(spark):
    df = spark.createDataFrame([(i, int(i < 20), float("nan") if i == 3 else 0.1 * i) for i in range(100)], "i int, y int, h double")
    w = sampling.blended_weights(df, "y", "h")
    assert w.agg(F.sum("probability")).first()[0] == pytest.approx(1) and w.where("y = 1").agg(F.sum("balanced")).first()[0] == pytest.approx(0.5)
    draw = lambda df, n: {r["i"]: r["times"] for r in sampling.draw_with_replacement(df, "i", "probability", n).collect()}
    drawn = draw(w, 20_000)
    assert sum(drawn.values()) == 20_000 and draw(w.repartition(7), 20_000) == drawn
    assert sum(n for i, n in drawn.items() if i < 20) / 20_000 == pytest.approx(0.45 + 0.1 * w.where("y = 1").agg(F.sum("hard")).first()[0], abs=0.02)
    assert sum(draw(w, 100).values()) == 100 and draw(w.where("false"), 50) == {} and draw(w.withColumn("probability", F.lit(0.0)), 5) == {}
    # by brute force: the row whose stretch of the summed weight has the point
    rows = sorted((r["i"], int(r["probability"] * sampling.UNITS)) for r in w.collect())
    ends = list(itertools.accumulate(n for _, n in rows))
    points = [int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:15], 16) % ends[-1] for i in range(20_000)]
    assert drawn == Counter(rows[bisect.bisect_right(ends, x)][0] for x in points)


def test_quantiles(spark):
    draw = random.Random(2)
    data = [(g, v) for g in "ab" for v in [draw.choice([draw.gauss(0, 1), 1e300, -1e-300, 0.0, -0.5, draw.random() * 1e-9]) for _ in range(301)]] + [("a", None), ("c", 3.5), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = prefix.quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.9}).collect()
    assert sorted(r["g"] for r in got) == ["a", "b", "c"]
    for r in got:
        own = [v for g, v in data if g == r["g"] and v is not None]
        assert (r["m"], r["p"]) == pytest.approx(tuple(np.quantile(own, [0.5, 0.9])))
    assert prefix.quantiles(df.where("false"), [], "v", {"m": 0.5}).count() <= 1


def test_hardness_and_stopping(spark):
    df = spark.createDataFrame([(1, 2.0, 6.0, 2), (2, 1.0, 0.0, 0)], "i int, h double, s double, n int")
    assert [r["hardness"] for r in sampling.updated_hardness(df, "h", "s", "n").orderBy("i").collect()] == [pytest.approx(0.85 * 2 + 0.15 * 3), 1.0]
    history = spark.createDataFrame([("a", e, min(e, 3) / 10.0, 1.0) for e in range(10)], "run string, e int, f1 double, loss double")
    r = sampling.stopping(history, "run", "e", "f1", "loss", patience=3).first()
    assert (r["best_epoch"], r["best_f1"], r["stopped_at"]) == (3, 0.3, 6)
    with pytest.raises(ValueError):
        sampling.updated_hardness(df, "h", "s", "n", momentum=1.0)


# names


def test_names(spark):
    names = ["20210329141240MINI0030240312886R290321-T004-005236", "20211329141240xxxx0030240312886s290321-t004-005236", "2021032914124MINI0030240312886R290321-T004-005236", None]
    a, b, c, d = (r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(parsing.ddl(F.col("n"))).collect())
    assert (a["drone_type"], a["azimuth_deg"], a["distance_m"], a["height_m"], a["binary_label"]) == ("DJI Mini 2", 3, 24, 31, 1) and a["temperature_c"] == pytest.approx(15.45) and str(a["recording_start"]) == "2021-03-29 14:12:40"
    assert b["binary_label"] == 0 and b["drone_type"] == "unknown" and b["recording_start"] is None and c is None and d is None
    kaist = [r[0] for r in spark.createDataFrame([("A_CC_N_1_street_2_10dB",), ("b-f-mf3-2-park-1--5",), ("A_CC_N_1_street_2_10dB_mic1",), ("odd",)], "n string").select(parsing.kaist(F.col("n"))).collect()]
    assert (kaist[0]["rotation"], kaist[0]["snr_db"], kaist[0]["background"]) == ("CC", 10, "street") and (kaist[1]["drone_type"], kaist[1]["fault"], kaist[1]["rotation"], kaist[1]["snr_db"]) == ("B", "MF3", "", -5) and kaist[2] == kaist[0] and kaist[3] is None
    texts = ["4.6 C", "90 % RH", "240 degrees", "", "--", None, "1.2.3"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parsing.first_number(F.col("t"))).collect()] == [4.6, 90, 240, None, None, None, None]
    assert [r[0] for r in spark.createDataFrame([(" Drone ",), ("Ambient Noise",), ("bird",), (None,)], "s string").select(parsing.sound_label(F.col("s"))).collect()] == [1, 0, None, None]


# signals


def test_waveforms(spark):
    sine = [0.5 * math.sin(2 * math.pi * 440 * i / 16_000) for i in range(1600)]
    df = spark.createDataFrame([("sine", sine), ("dc", [0.3] * 100), ("zero", [0.0] * 50), ("flip", [1.0, -1.0] * 50), ("none", []), ("null", None)], "k string, w array<double>")
    q = {r["k"]: r for r in df.select("k", signals.quality(F.col("w")).alias("q"), signals.zero_crossing_rate(F.col("w")).alias("z"), signals.peak_normalised(signals.without_offset(F.col("w"))).alias("n"), signals.finite(F.col("w")).alias("f")).collect()}
    assert q["sine"]["q"]["rms"] == pytest.approx(0.35355, abs=1e-3) and max(q["sine"]["n"]) == pytest.approx(0.99, abs=1e-3) and q["flip"]["z"] == pytest.approx(0.99)
    assert max(map(abs, q["dc"]["n"])) < 1e-9 or q["dc"]["n"] == [0.0] * 100 or q["dc"]["q"]["rms"] == pytest.approx(0.3)
    assert q["zero"]["n"] == [0.0] * 50 and q["none"]["q"]["rms"] is None and q["null"]["f"] is None
    masked = spark.createDataFrame([([[1.0] * 16, [2.0] * 16],)], "c array<array<double>>").select(signals.time_masked(F.col("c"), F.lit(2), F.lit(3)).alias("m"), signals.random_time_mask(F.col("c"), 1.0).alias("r")).first()
    assert masked["m"][0][1:6] == [1.0, 0.0, 0.0, 0.0, 1.0] and 1 <= sum(x == 0 for x in masked["r"][1]) <= 2


def test_blocks_and_content_noise(spark):
    df = spark.createDataFrame([([[[1.0, 2.0], [3.0, 4.0]], [[5.0], [6.0], [7.0]]],), ([],)], "b array<array<array<double>>>")
    assert [r[0] for r in df.select(signals.joined_blocks(F.col("b"))).collect()] == [[[1.0, 2.0, 5.0], [3.0, 4.0, 6.0]], []]
    many = spark.range(1).select(F.sequence(F.lit(0), F.lit(299)).alias("b"))
    assert many.select(signals.kept_blocks(F.col("b"))).first()[0] == list(range(60, 300, 2))
    noise = spark.createDataFrame([(b"a",), (b"a",), (b"b",), (None,)], "c binary").select(dsp.content_noise(F.col("c"))).collect()
    assert noise[0] == noise[1] != noise[2] and noise[3][0] is not None


def test_spectral_features_on_known_signals(spark):
    t = np.arange(64_000) / 16_000
    sine, noise = 0.5 * np.sin(2 * np.pi * 1000 * t), np.random.default_rng(1).normal(0, 0.1, 64_000)
    shapes = {name: f(sine).shape for name, f in dsp.FAMILIES.items()}
    assert shapes == {"mfcc": (120, 126), "mel": (128, 126), "spectral": (12, 126), "chroma": (12, 126), "zcr": (1, 126), "energy": (1, 126)}
    raw = dsp.spectral(sine, c=dsp.Spectral(normalise=False))[:, 5:-5]
    assert raw[0].mean() == pytest.approx(1000, rel=0.02) and raw[2].mean() == pytest.approx(1000, rel=0.02) and raw[4].mean() < 0.01
    assert dsp.spectral(noise, c=dsp.Spectral(normalise=False))[4].mean() > 0.3
    assert dsp.energy(sine, c=dsp.Framed(normalise=False))[0, 10:-10] == pytest.approx(0.35355, rel=0.01)
    assert dsp.zcr(sine, c=dsp.Framed(normalise=False))[0, 10:-10].mean() == pytest.approx(2000 / 16_000, rel=0.02)
    assert np.argmax(dsp.chroma(0.5 * np.sin(2 * np.pi * 440 * t), c=dsp.Chroma(normalise=False)).mean(1)) == 9  # A
    m = dsp.mfcc(noise)
    assert abs(m.mean()) < 1e-3 and m.std(axis=1) == pytest.approx(1, abs=0.01)
    line = np.tile(np.arange(20.0), (2, 1))
    assert dsp.derivative(line, 1)[:, 5:-5] == pytest.approx(1) and dsp.derivative(line**2, 2)[:, 5:-5] == pytest.approx(2)
    assert len(dsp.resampled(np.sin(2 * np.pi * 440 * np.arange(44_100) / 44_100), 44_100)) == 16_000
    half = dsp.resampled(np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000), 48_000)
    assert half[500:-500] == pytest.approx(np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)[500:-500], abs=0.02)
    quiet = np.concatenate([np.zeros(16_000), sine[:16_000], np.zeros(16_000)])
    assert 15_000 < len(dsp.trimmed(quiet)) < 19_000 and len(dsp.trimmed(np.zeros(100))) == 100
    assert dsp.live_scalars(sine)["centroid"] == pytest.approx(1000, rel=0.05)
    for bad in ([], [float("nan")], [[1.0]]):
        with pytest.raises(dsp.FeatureError):
            dsp.mfcc(bad)
    with pytest.raises(dsp.FeatureError):
        dsp.mel(sine, c=dsp.Mel(fmax=9000.0))
    assert dsp.seed_of(None) == 42 and dsp.seed_of(b"x") == dsp.seed_of(b"x")
    df = spark.createDataFrame([(1, sine[:8000].tolist()), (2, [float("inf")]), (3, None)], "k int, w array<double>")
    got = {r["k"]: r for r in dsp.features(df, "k", "w").collect()}
    assert got[1]["status"] == "success" and got[1]["mfcc"]["shape"] == "(120, 16)" and got[2]["status"] == got[3]["status"] == "failed" and got[2]["error"] and got[2]["mfcc"] is None
    live = {r["k"]: r["rms"] for r in dsp.live_windows(df, "k", "w").collect()}
    assert live[1] > 0 and live[2] is None


def test_scores_and_views(spark):
    df = spark.createDataFrame([(1, 39.9), (2, 40.0), (3, 64.0), (4, 82.0), (5, None)], "i int, t double")
    assert [r[0] for r in df.orderBy("i").select(scoring.level(F.col("t"))).collect()] == ["LOW", "MEDIUM", "HIGH", "CRITICAL", "LOW"]
    history = df.select("i", scoring.level(F.col("t")).alias("level"), F.lit("Mic A").alias("source"), F.lit("x").alias("category"))
    assert [r["n"] for r in scoring.domain_counts(history, "level", scoring.LEVELS).orderBy("place").collect()] == [2, 1, 1, 1]
    assert scoring.filtered_history(history, source="mic").count() == 5 and scoring.filtered_history(history, "HIGH", "x", "zzz").count() == 0
    assert [r["i"] for r in scoring.last_rows(history, "i", 2).collect()] == [4, 5]
