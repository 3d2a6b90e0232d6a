"""Sources, sinks and streams: round trips, broken files, several micro-batches."""

from __future__ import annotations

import math
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sonarmill.plans import pipeline, stream_queries
from sonarmill.sources import adapters, audio, tables
from sonarmill.streaming import windows


def _wav(path, samples, rate=16_000, channels=1, width=2):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        f.writeframes(b"".join(struct.pack({1: "<B", 2: "<h", 4: "<i"}[width], int(x * (2 ** (8 * width - 1) - 1)) + (128 if width == 1 else 0)) for x in samples))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    home = str(tmp_path_factory.mktemp("audio"))
    sine = [0.5 * math.sin(2 * math.pi * 440 * i / 16_000) for i in range(16_000)]
    _wav(f"{home}/a/one.wav", sine)
    _wav(f"{home}/a/TWO.WAV", sine[:8000], rate=8000)
    _wav(f"{home}/b/stereo.wav", [x for s in sine[:4000] for x in (s, -s)], channels=2)
    for name, content in (("b/broken.wav", b"RIFF"), ("b/notes.txt", b"x"), ("b/empty.wav", b"")):
        with open(f"{home}/{name}", "wb") as f:
            f.write(content)
    with open(f"{home}/b/float.wav", "wb") as f:
        data = np.array(sine[:1600], "<f4").tobytes()
        f.write(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 16_000, 64_000, 4, 32) + b"data" + struct.pack("<I", len(data)) + data)
    return home


def _name(path):
    return path.rsplit("/", 1)[-1]


def test_listing_and_headers(spark, folder):
    assert {_name(r["path"]) for r in audio.audio_files(spark, folder).collect()} == {"one.wav", "TWO.WAV", "stereo.wav", "broken.wav", "float.wav"}
    meta = {_name(r["path"]): r for r in audio.wav_metadata(audio.audio_files(spark, folder, content=True)).collect()}
    assert (meta["one.wav"]["duration_sec"], meta["one.wav"]["sample_rate"], meta["one.wav"]["subtype"], meta["one.wav"]["status"]) == (1.0, 16_000, "PCM_16", "OK")
    assert meta["stereo.wav"]["channels"] == 2 and meta["broken.wav"]["status"] == "CORRUPTED" and meta["broken.wav"]["duration_sec"] is None and len(meta["broken.wav"]["sha256"]) == 64


def _atom(name, body):
    return struct.pack(">I", len(body) + 8) + name + body


def test_headers_of_other_containers():
    flac = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(10) + (44_100 << 44 | 1 << 41 | 15 << 36 | 88_200).to_bytes(8, "big") + bytes(16)
    assert audio.header(flac) == (2.0, 44_100, 2, "PCM_16")
    page = lambda end, body: b"OggS" + bytes(2) + struct.pack("<q", end) + bytes(12) + bytes([1, len(body)]) + body
    assert audio.header(page(0, b"\x01vorbis" + bytes(4) + struct.pack("<BI", 1, 16_000) + bytes(14)) + page(24_000, b"x")) == (1.5, 16_000, 1, "VORBIS")
    assert audio.header(page(0, b"OpusHead\x01\x02" + struct.pack("<HI", 312, 44_100) + bytes(3)) + page(48_312, b"x")) == (1.0, 44_100, 2, "OPUS")
    frame = (2047 << 21 | 3 << 19 | 1 << 17 | 1 << 16 | 9 << 12 | 0 << 10 | 3 << 6).to_bytes(4, "big")  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz, mono
    assert audio.header(frame + bytes(16_000 * 3 - 4)) == (3.0, 44_100, 1, "MP3")
    assert audio.header(b"ID3" + bytes([4, 0, 0, 0, 0, 0, 5]) + bytes(5) + frame + bytes(17) + b"Info" + struct.pack(">II", 1, 100) + bytes(99))[0] == pytest.approx(100 * 1152 / 44_100)
    stsd = _atom(b"stsd", bytes(8) + struct.pack(">I", 36) + b"mp4a" + bytes(16) + struct.pack(">HH", 2, 16) + bytes(4) + struct.pack(">I", 48_000 << 16))
    track = _atom(b"trak", _atom(b"mdia", _atom(b"mdhd", bytes(12) + struct.pack(">II", 48_000, 120_000) + bytes(4)) + _atom(b"hdlr", bytes(8) + b"soun" + bytes(12)) + _atom(b"minf", _atom(b"stbl", stsd))))
    film = _atom(b"trak", _atom(b"mdia", _atom(b"mdhd", bytes(12) + struct.pack(">II", 600, 600) + bytes(4)) + _atom(b"hdlr", bytes(8) + b"vide" + bytes(12))))
    assert audio.header(_atom(b"ftyp", b"M4A ") + _atom(b"moov", film + track)) == (2.5, 48_000, 2, "MP4A")
    for broken in (b"", b"fLaC", b"RIFF....WAVE", b"OggS", b"ID3", _atom(b"ftyp", b"M4A ") + b"junkjunk" * 3):
        with pytest.raises(Exception):  # noqa: B017
            audio.header(broken)


def test_unknown_containers_are_no_issue(spark):
    files = spark.createDataFrame([("a.aac", 5, bytearray(b"\x00\x01\x02\x03\x04")), ("b.wav", 5, bytearray(b"\x00\x01\x02\x03\x04")), ("c.flac", 4, bytearray(b"fLaC"))], "path string, length bigint, content binary")
    got = {r["path"]: (r["status"], r["issues"]) for r in pipeline.validated(files).collect()}
    assert got == {"a.aac": ("UNSUPPORTED", "PASS"), "b.wav": ("CORRUPTED", "corrupted, missing duration"), "c.flac": ("CORRUPTED", "corrupted, missing duration")}


def test_decoding_with_fallbacks(spark, folder):
    got = {_name(r["path"]): r for r in audio.decoded(audio.audio_files(spark, folder, content=True)).collect()}
    assert len(got["one.wav"]["wave"]) == len(got["TWO.WAV"]["wave"]) == 16_000 and len(got["float.wav"]["wave"]) == 1600
    assert max(map(abs, got["stereo.wav"]["wave"])) < 1e-3 and got["broken.wav"]["status"] == "failed" and "decode_wave" in got["broken.wav"]["error"]


def test_block_source(spark, folder):
    audio.register(spark)
    df = spark.read.format("wav_blocks").option("block_frames", 1000).option("partition_frames", 6000).load(folder)
    one = [r for r in df.collect() if _name(r["path"]) == "one.wav"]
    assert sorted(r["first_frame"] for r in one) == [a for p in (0, 6000, 12_000) for a in range(p, min(p + 6000, 16_000), 1000)]
    assert sum(len(r["samples"]) for r in one) == 16_000 and df.rdd.getNumPartitions() >= 5
    with pytest.raises(Exception, match="path"):
        spark.read.format("wav_blocks").load().collect()


def test_registry_and_adapters(spark):
    rules = adapters.Registry([adapters.Rule("drone_audio", "d", "directory", labels=(("yes", 1), ("yes/no", 0))), adapters.Rule("al_emadi", "a", "directory", enabled=False)])
    assert [r.name for r in rules.enabled()] == ["drone_audio"] and rules.frame(spark).count() == 2
    with pytest.raises(ValueError, match="more than once"):
        adapters.Registry([rules.rules[0], rules.rules[0]])
    with pytest.raises(KeyError, match="drone_audio"):
        rules["odd"]
    with pytest.raises(ValueError):
        adapters.Rule("x", "x", "guess")
    files = spark.createDataFrame([("yes/a_1.wav", 1, "s"), ("yes/no/b.WAV", 1, "s"), ("other/c.wav", 1, "s"), ("yes/d.txt", 1, "s")], "relative_path string, size_bytes bigint, sha256 string")
    got = sorted((r["relative_path"], r["binary_label"], r["recording_group_id"]) for r in adapters.rows_of(rules["drone_audio"], files).collect())
    assert got == [("yes/a_1.wav", 1, "drone_audio:a"), ("yes/no/b.WAV", 0, "drone_audio:b")]
    with pytest.raises(KeyError):
        adapters.rows_of(adapters.Rule("new", "n", "csv"), files)
    texts = spark.createDataFrame([("r1/label.json", '{"drone": {"sound_source": "Drone"}}'), ("r2/label.json", '{"drone": {"sound_source": "ambient"}}'), ("r3/label.json", '{"drone": {"sound_source": "bird"}}'), ("r4/label.json", "{"), ("r5/label.json", None)], "relative_path string, text string")
    audio_files = spark.createDataFrame([("r1/z.wav", 1, "a"), ("r1/OUTPUT.WAV", 2, "b"), ("r2/z.wav", 3, "c"), ("r2/b.wav", 4, "d"), ("r3/x.wav", 5, "e")], "relative_path string, size_bytes bigint, sha256 string")
    got = sorted((r["relative_path"], r["binary_label"], r["size_bytes"]) for r in adapters.rows_of(adapters.Rule("uavirbase", "u", "json"), audio_files, texts).collect())
    assert got == [("r1/OUTPUT.WAV", 1, 2), ("r2/b.wav", 0, 4)]
    notes = spark.createDataFrame([(" a.wav ", "2", "rain", "7"), ("gone.wav", "1", None, "8")], "file_name string, fold string, category string, source_id string")
    stored = spark.createDataFrame([("fold2/a.wav", 9, "h")], "relative_path string, size_bytes bigint, sha256 string")
    urban = adapters.Rule("urbansound8k", "u", "csv")
    assert [(r["relative_path"], r["recording_group_id"]) for r in adapters.rows_of(urban, stored, notes).collect()] == [("fold2/a.wav", "urbansound8k:7")]
    assert [r[0] for r in adapters.missing_audio(urban, stored, notes).collect()] == ["fold1/gone.wav"]
    with pytest.raises(Exception, match="unexpected label"):
        adapters.with_label(adapters.rows_of(rules["drone_audio"], files), 1, strict=True).collect()


def test_annotated_files_of_every_csv_dataset_in_any_spelling(spark, tmp_path):
    stored = [("raw/esc50/wav_files/a.wav", 5), ("raw\\esc50\\wav_files\\b.wav", 6), (" /srv/x/raw/./esc50//wav_files/a.wav ", 9), ("raw/urbansound8k/fold3/c.wav", 7), ("./raw\\urbansound8k/fold10/c.wav", 8), ("raw/other/wav_files/a.wav", 99), (None, 1)]
    listed = [("esc50", " a.wav", "1 ", "crow", "17"), ("esc50", "b.wav", "2", None, "18"), ("esc50", "c.wav", "3", "dog", "19"), ("urbansound8k", "c.wav\t", " 3", "siren", "20"), ("urbansound8k", "c.wav", "10", "siren", "21"), ("urbansound8k", "a.wav", "1", "siren", "22"), ("other", "a.wav", "1", "x", "23"), (None, "a.wav", "1", "x", "24")]
    spark.createDataFrame(stored, "file_path string, size_bytes bigint").write.parquet(f"{tmp_path}/stored_files.parquet")
    spark.createDataFrame(listed, "dataset string, file_name string, fold string, category string, source_id string").write.parquet(f"{tmp_path}/background_annotations.parquet")
    got = stream_queries.annotated_files(spark, str(tmp_path))
    assert got.columns == ["relative_path", "source_category", "source_fold", "recording_group_id", "size_bytes"]
    assert sorted(tuple(r) for r in got.collect()) == [
        ("fold10/c.wav", "siren", "10", "urbansound8k:21", 8), ("fold3/c.wav", "siren", "3", "urbansound8k:20", 7),
        ("wav_files/a.wav", "crow", "1", "esc50:17", 9), ("wav_files/b.wav", None, "2", "esc50:18", 6),
    ]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "shards.csv")
    head = "split,segment_id,binary_label,source_sha256,recording_group_id,source_dataset,source_relative_path,shard_path,shard_index"
    with open(path, "w") as f:
        f.write(f"{head}\ntrain,a:0,1,a,g,d,p,s,0\ntrain,a:1,0,a,g,d,,s,1\n")
    df = tables.read_manifest(spark, path, "shard", "train")
    assert df.where("source_relative_path IS NULL").count() == 1 and dict(df.dtypes)["shard_index"] == "int"
    with pytest.raises(ValueError, match="another split"):
        tables.read_manifest(spark, path, "shard", "test")
    with open(path, "a") as f:
        f.write("train,a:2,7,a,,d,p,s,2\n")
    with pytest.raises(ValueError, match="labels"):
        tables.read_manifest(spark, path, "shard")
    with open(path, "a") as f:
        f.write("train,a:3,x,a,g,d,p,s,3\n")
    with pytest.raises(Exception):
        tables.read_manifest(spark, path, "shard")
    with pytest.raises(ValueError, match="shard_index"):
        with open(path, "w") as f:
            f.write("split,segment_id\n")
        tables.read_csv(spark, path, tables.SHARDS)
    with open(path, "w") as f:
        f.write(head + "\n")
    with pytest.raises(ValueError, match="is empty"):
        tables.read_manifest(spark, path, "shard")
    out = str(tmp_path / "out")
    shards = spark.range(600).select(F.lit("train").alias("split"), (F.col("id") / 256).cast("int").alias("shard_no"), (F.col("id") % 256).alias("slot"))
    tables.write_shards(shards, out)
    assert spark.read.parquet(out).groupBy("shard_no").count().count() == 3 and len(spark.read.parquet(out).inputFiles()) == 3
    tables.append_rows(spark.range(3), f"{out}-log"), tables.append_rows(spark.range(3), f"{out}-log")
    assert spark.read.parquet(f"{out}-log").count() == 6
    tables.write_csv(spark.range(3).withColumn("b", F.lit("x")), f"{out}-csv", ("b", "id"))
    assert tables.read_csv(spark, f"{out}-csv").columns == ["b", "id"]
    tables.write_json_report(spark.range(1), f"{out}-json")
    assert spark.read.text(f"{out}-json").first()[0] == '{"id":0}'
    tables.save_model_entry(spark, f"{out}-models", "m", 1, 3, 0.8, 0.4, "w1"), tables.save_model_entry(spark, f"{out}-models", "m", 2, 1, 0.9, 0.6, "w2")
    assert tables.latest_model(spark, f"{out}-models", "m").first()["path"] == "w2"
    assert tables.versioned_path(out) != tables.versioned_path(out) and tables.decision_threshold(None) == 0.5 and tables.decision_threshold(0.4, 0.7) == 0.7
    with pytest.raises(ValueError):
        tables.decision_threshold(1.0)
    assert tables.package_listing(spark, str(tmp_path), ("*.csv", "shards*")).where("path LIKE '%shards.csv'").count() == 1


def test_sample_windows_across_micro_batches(spark, tmp_path):
    source = str(tmp_path / "blocks")
    waves = {"a": np.sin(np.arange(500)), "b": np.cos(np.arange(130))}
    sizes = [37, 64, 5, 100, 200, 94]
    for stream, w in waves.items():
        at = 0
        for i, n in enumerate(sizes):
            part = w[at : at + n]
            at += n
            if len(part):
                spark.createDataFrame([(stream, i, part.tolist())], "stream string, seq bigint, samples array<double>").coalesce(1).write.mode("append").parquet(source)
    stream = windows.stream_of(spark, source)
    got = windows.drained(windows.sample_windows(stream, 64, 32))
    by = {}
    for r in got.orderBy("stream", "index").collect():
        by.setdefault(r["stream"], []).append((r["index"], r["start"], r["end"], r["peak"]))
    for name, w in waves.items():
        assert by[name] == [(i, i * 32, i * 32 + 64, pytest.approx(np.abs(w[i * 32 : i * 32 + 64]).max())) for i in range((len(w) - 64) // 32 + 1)]
    with pytest.raises(ValueError):
        windows.sample_windows(stream, 10, 20)


def test_event_windows_close_with_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(folder)
    batch = rows.groupBy(F.window("ts", "4 hours", "2 hours"), "event_type").agg(F.count("*").alias("n")).count()
    whole = windows.drained(windows.event_windows(windows.stream_of(spark, folder)), "complete")
    assert whole.count() == batch
    sorted_folder = str(tmp_path / "sorted")
    rows.orderBy("ts").coalesce(1).write.parquet(sorted_folder)
    closed = windows.drained(windows.event_windows(windows.stream_of(spark, sorted_folder)), "append")
    assert 0.9 * batch < closed.count() <= batch
    log, reports = str(tmp_path / "log"), windows.Progress()
    spark.streams.addListener(reports)
    for _ in range(2):  # a second run finds nothing new
        windows.append_history(windows.stream_of(spark, folder), log, str(tmp_path / "state")).awaitTermination()
    spark.streams.removeListener(reports)
    assert spark.read.parquet(log).count() == rows.count()
    assert windows.drained(windows.session_events(windows.stream_of(spark, sorted_folder)), "append").count() > 0
    def broken():
        raise StreamingQueryException("lost")

    assert windows.with_fallback(broken, lambda: "batch") == "batch" and windows.with_fallback(lambda: "stream", lambda: "batch") == "stream"
    with pytest.raises(ZeroDivisionError):
        windows.with_fallback(lambda: 1 / 0, lambda: "batch")


def test_every_query_has_its_columns(spark):
    """Every query runs on the smallest data, and each SQL names a query."""
    import __spark_entry__

    from sonarmill.plans import registry

    assert set(registry.ORACLE) <= set(registry.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    for name, query in registry.QUERIES.items():
        df = query(spark, "/root/testdata/sf0.001")
        assert df.columns and len(set(df.columns)) == len(df.columns), name
    assert __spark_entry__.entry(spark).count() > 0
