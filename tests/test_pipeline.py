"""The pipeline from files to shards on a few recordings, its gates, NPZ shards, WAV segments, text search and scoring."""

from __future__ import annotations

import json
import math
import os
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

import sonarmill.__main__ as cli
from sonarmill.operators import inference
from sonarmill.plans import pipeline
from sonarmill.sources import adapters, audio, npz

RULES = adapters.Registry([
    adapters.Rule("drone_audio", "drone_audio", "directory", labels=(("yes_drone", 1), ("unknown", 0))),
    adapters.Rule("uavirbase", "uavirbase", "json", annotation_file="label.json"),
    adapters.Rule("esc50", "esc50", "csv", annotation_file="labels.csv"),
    adapters.Rule("kaist", "not_there", "filename"),
])


def _write(path, seconds, tone):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(path, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16_000)
        f.writeframes(b"".join(struct.pack("<h", int(12_000 * math.sin(2 * math.pi * tone * i / 16_000))) for i in range(int(seconds * 16_000))))


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    for i in range(5):
        _write(f"{root}/drone_audio/yes_drone/rec{i}_0.wav", 1.0 + i, 300 + 10 * i)
        _write(f"{root}/drone_audio/unknown/back{i}_0.wav", 1.0, 100 + 10 * i)
    _write(f"{root}/drone_audio/yes_drone/copy_0.wav", 1.0, 300)  # the content of rec0_0
    _write(f"{root}/drone_audio/yes_drone/short_0.wav", 0.1, 900)
    for name, label in (("r1", "Drone"), ("r2", "Ambient"), ("r3", "bird")):
        _write(f"{root}/uavirbase/{name}/output.wav", 2.0, 500 + len(name) + ord(name[1]))
        with open(f"{root}/uavirbase/{name}/label.json", "w") as f:
            json.dump({"drone": {"sound_source": label}}, f, indent=2)
    _write(f"{root}/esc50/wav_files/x.wav", 1.5, 50)
    with open(f"{root}/esc50/labels.csv", "w") as f:
        f.write("filename,fold,category,src_file\nx.wav,1,rain,77\ngone.wav,2,rain,78\n")
    return root


def test_from_files_to_shards(spark, raw, tmp_path):
    rows = pipeline.dataset_rows(spark, raw, RULES)
    assert {(r["dataset"], r["binary_label"]): r["n"] for r in rows.groupBy("dataset", "binary_label").agg(F.count("*").alias("n")).collect()} == {("drone_audio", 1): 7, ("drone_audio", 0): 5, ("uavirbase", 1): 1, ("uavirbase", 0): 1, ("esc50", 0): 1}
    home = pipeline.rebuild(spark, raw, str(tmp_path / "out"), RULES, pipeline.Options(shard_size=4))
    canonical = spark.read.parquet(f"{home}/manifest")
    assert canonical.count() == 14 and spark.read.parquet(f"{home}/conflicts").count() == 0
    segments = spark.read.parquet(f"{home}/segments")
    assert segments.where(F.size("wave") != 64_000).count() == 0 and segments.where("source_duration_seconds = 5").count() == 2
    report = {r["relative_path"]: (r["status"], r["segment_count"]) for r in spark.read.parquet(f"{home}/report").collect()}
    assert report["yes_drone/short_0.wav"] == ("failed", 0) and report["yes_drone/rec4_0.wav"] == ("success", 2)
    shards = spark.read.parquet(f"{home}/shards")
    assert shards.count() == segments.count() and shards.groupBy("split", "shard_no").count().where("count > 4").count() == 0
    npz.register(spark)
    manifest = pipeline.export_npz(shards, str(tmp_path / "npz"))
    assert manifest.count() == shards.count()
    back = spark.read.format("npz_shards").load(str(tmp_path / "npz"))
    joined = back.join(shards.select("segment_id", "binary_label", F.col("mfcc.values").alias("m")), "segment_id")
    assert back.count() == joined.count() == shards.count() and joined.where("label <> binary_label OR mfcc <> m").count() == 0
    np.savez(str(tmp_path / "npz" / "bad.npz"), labels=np.array([0]))
    assert spark.read.format("npz_shards").load(str(tmp_path / "npz")).where("issues LIKE '%missing%'").count() == 1
    more = pipeline.featured(segments, shards.select("segment_id").limit(3))
    assert more.count() == segments.count() - 3
    wavs = segments.select("split", F.col("source_dataset").alias("dataset"), F.col("binary_label").alias("label"), F.col("source_sha256").alias("sha"), F.col("segment_index").alias("index"), "wave")
    folder = str(tmp_path / "wav")
    assert npz.write_wav_segments(wavs, folder).where("status = 'written'").count() == segments.count()
    assert npz.write_wav_segments(wavs, folder).where("status = 'skipped'").count() == segments.count()
    assert audio.audio_files(spark, folder).count() == segments.count()


def test_gates(spark):
    base = [("train", "a", "g1", 1), ("test", "b", "g2", 0)]
    make = lambda rows: spark.createDataFrame(rows, "split string, sha256 string, recording_group_id string, binary_label int")
    pipeline.check_sources(make(base))
    assert pipeline.preflight(make(base)).count() == 2
    for extra, text in ((("train", "a", "g1", 1), "twice"), (("test", "c", "g1", 1), "several splits"), (("train", "d", "g1", 0), "both labels")):
        with pytest.raises(pipeline.GateError, match=text):
            pipeline.check_sources(make([*base, extra]))
    segment = lambda *r: spark.createDataFrame([r], "segment_id string, source_sha256 string, segment_index int, split string, recording_group_id string, binary_label int")
    pipeline.check_segments(segment("a:0", "a", 0, "train", "g1", 1), make(base))
    for bad in (("a:1", "a", 0, "train", "g1", 1), ("a:0", "a", 0, "test", "g1", 1), ("z:0", "z", 0, "train", "g1", 1), ("a:0", "a", 0, "train", "g1", 0)):
        with pytest.raises(pipeline.GateError):
            pipeline.check_segments(segment(*bad), make(base))


def test_text_search(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("one\nABC here\n\n" + "z" * 2000 + "abc\n")
    (tmp_path / "b.txt").write_text("abc")
    got = sorted((r["line_number"], len(r["line"]), r["id"]) for r in npz.text_lines_with_ids(spark, str(tmp_path), ["abc"], "*.csv").collect())
    assert got == [(2, 8, "abc"), (4, 1000, "abc")]


def test_scoring(spark):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(i % 2, 0.3), draw.gauss(0, 1.0)], i % 2) for i in range(200)] + [(999, None, 1)]
    df = spark.createDataFrame(rows, "k int, v array<double>, y int")
    got = {r["k"]: r["score"] for r in inference.scored(df, "k", "v", lambda: lambda x: 1 / (1 + np.exp(-8 * (x[:, 0] - 0.5)))).collect()}
    assert got[999] is None and sum((got[k] >= 0.5) == y for k, _, y in rows[:-1]) > 180
    model = inference.trained_baseline(df.where("v IS NOT NULL"), "v", "y")
    scored = inference.baseline_scores(model, df.where("v IS NOT NULL"), "v", "k", "y")
    assert scored.where("(score >= 0.5) = (y = 1)").count() > 180
    one = scored.select("*", *[c.alias(n) for n, c in inference.results(F.col("score"), 0.5).items()], inference.cross_entropy(F.col("score"), F.col("y")).alias("loss")).first()
    assert one["confidence"] >= 0.5 and one["loss"] > 0 and (one["label_text"] == "drone") == one["is_drone"]
    vector = spark.createDataFrame([([[1.0, 3.0], [2.0, 2.0]],)], "f array<array<double>>").select(inference.summary_vector(F.col("f"))).first()[0]
    assert vector == [2.0, 1.0, 2.0, 0.0]


def test_command_line(spark, tmp_path, raw):
    assert cli.main(["query", "split_counts", "--data", "/root/testdata/sf0.001", "--output", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() > 1
    assert cli.main(["validate", "--data", f"{raw}/drone_audio", "--output", str(tmp_path / "v")]) == 0
    assert spark.read.parquet(str(tmp_path / "v")).where("issues = 'too short'").count() == 1
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
