"""Problems 1, 2, 4 and 5: small cases worked out by hand or by brute force, and the defined results of odd inputs."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sonarmill.functions import keys
from sonarmill.operators import compaction, eager, prefix, references, shredding
from sonarmill.plans import data_problems

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# keys


def test_keys(spark):
    df = spark.createDataFrame([(" Training ", "DDL:X ", "sha256:AB ", " AB_0007\t", " D:\\capture\\features\\.\\shards//a.npz"), (None, "", " ", "ab:0", "/srv/x/raw/esc50/"), ("other", None, None, "odd", "a/segmentsx/b"), ("val", "g", "f", "x:y:010", "./.")], "s string, g string, h string, k string, p string")
    got = df.select(keys.split_name("s"), keys.group_key("g"), keys.sha_key("h"), keys.segment_key("k"), keys.path_key("p"), keys.segment_sha("k"), keys.segment_index("k")).collect()
    assert [tuple(r) for r in got] == [
        ("train", "ddl:x", "ab", "ab:7", "features/shards/a.npz", "ab", 7),
        (None, None, None, "ab:0", "raw/esc50", "ab", 0),
        (None, None, None, "odd", "a/segmentsx/b", None, None),
        ("validation", "g", "f", "x:y:10", None, "x:y", 10),
    ]


# problem 1


def _found(spark, tmp_path, texts):
    spark.createDataFrame([(i, "p", t, T0) for i, t in enumerate(texts)], "label_id bigint, relative_path string, label string, received_at timestamp_ntz").write.parquet(f"{tmp_path}/uavirbase_labels.parquet")
    return str(tmp_path)


def _brute(text):
    """Child rows by plain recursion over the parsed value."""

    def named(value, name):
        return [v for k, v in value.items() if k.strip().lower().replace(" ", "_").replace("-", "_") == name] if isinstance(value, dict) else []

    def objects(value, name):
        for v in named(value, name):
            if isinstance(v, dict):
                yield 0, v
            elif isinstance(v, list):
                yield from ((i, x) for i, x in enumerate(v) if isinstance(x, dict))

    try:
        value = json.loads(text.lstrip("﻿"))
        if isinstance(value, str):
            value = json.loads(value)
    except (ValueError, AttributeError, RecursionError):
        return []
    if not isinstance(value, dict):
        return []
    out = [("weather_measurement", -1, i) for _, w in objects(value, "weather_data") for i, _ in objects(w, "measurements")]
    out += [("label_measurement", -1, i) for i, _ in objects(value, "measurements")]
    for _, array in objects(value, "microphone_array"):
        for i, mic in objects(array, "microphones"):
            out.append(("microphone", -1, i))
            out += [("calibration", i, j) for j, _ in objects(mic, "calibrations")]
    return out


def test_shredding_odd_texts(spark, tmp_path):
    texts = [
        None, "", "{", "[]", "3", '"x"', "null", "{}", '﻿{"measurements": {}}', json.dumps('{"Measurements ": [1, {}, null, {"a": 1}]}'),
        '{"weather-data": {"measurements": [{}, [{}], {}]}, "MICROPHONE ARRAY": {"microphones": [{"calibrations": {"gain_db": 1}}, "x", {"calibrations": [2, {}]}]}}',
        '{"measurements": [{"a": "' + "x" * 300_000 + '"}]}', "[" * 100_000, '{"measurements": ' + "[" * 50 + "]" * 50 + "}", '{"measurements": {"measurements": {}}}', '{"\\ud800": "\\udfff", "measurements": {}}',
    ]
    folder = _found(spark, tmp_path, texts)
    got = rows(data_problems.p1_found(spark, folder))
    assert got == sorted({(i, *row) for i, t in enumerate(texts) if t for row in _brute(t)})
    assert rows(data_problems.p1_microphones(spark, folder).select("label_id", "pos")) == [(10, 0), (10, 2)]
    assert data_problems.p1_calibrations(spark, folder).where("gain_db = '1'").count() == 1


def test_shredding_on_the_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/uavirbase_labels.parquet").select("label_id", "label").collect()}
    assert rows(data_problems.p1_found(spark, folder)) == sorted({(i, *row) for i, t in texts.items() if t for row in _brute(t)})


def test_shredding_entities_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, '{"drone": {"type": "quad", "Distance": 24, "x": null}}', "n", 0), (None, "{}", "n", 0)], "id bigint, node string, label string, parent int")
    nodes = shredding.shred(df, "id", "node")
    assert rows(nodes.select("node", "parent", "label", "ordinal", "kind", "scalar")) == [(0, -1, None, 0, "object", None), (1, 0, "drone", 0, "object", None), (2, 1, "type", 0, "string", "quad"), (3, 1, "Distance", 1, "number", "24"), (4, 1, "x", 2, "null", None)]
    flat = shredding.entity(nodes, shredding.roots(nodes), {"type": ("drone", "type"), "distance": ("drone", "distance"), "x": ("drone", "x")})
    assert [(r["type"], r["distance"], r["x"]) for r in flat.collect()] == [("quad", "24", None)]
    assert shredding.shred(df.where("false"), "id", "node").count() == 0


# problem 2


def test_eager_join_equals_row_join(spark):
    draw = random.Random(3)
    left = [(draw.choice(["hot"] * 6 + ["a", "b", "c", None]), draw.choice(["x", "y", None]), i) for i in range(400)]
    right = [(draw.choice(["hot"] * 5 + ["b", "d", None]), i % 7) for i in range(300)]
    a = spark.createDataFrame(left, "key_value string, source string, v bigint")
    b = spark.createDataFrame(right, "k string, w bigint")
    joined = eager.join_states(eager.key_states(a, F.col("key_value"), F.col("source"), sums={"v": F.col("v")}), eager.key_states(b, F.col("k"), sums={"w": F.col("w")}))
    got = {r["key_value"]: (r["n_rows"], r["n_sources"], int(r["joined_rows"]), r["sv"], r["sw"]) for r in joined.withColumns({"sv": eager.joined_sum("v"), "sw": eager.joined_sum("w", of_left=False)}).collect()}
    for key in {x[0] for x in left} | {x[0] for x in right}:
        if key is None:
            assert key not in got
            continue
        l, r = [x for x in left if x[0] == key], [x for x in right if x[0] == key]
        assert got[key][:3] == (len(l), len({x[1] for x in l} - {None}) if l else None, len(l) * len(r))
        if l and r:
            assert got[key][3:] == (sum(x[2] for x in l) * len(r), sum(x[1] for x in r) * len(l))
    heavy = eager.heavy_keys(joined, a, 0.5)
    assert [r["key_value"] for r in heavy.collect()] == ["hot"]
    assert eager.heavy_keys(eager.key_states(a.where("false"), F.col("key_value")), a.where("false"), 0.02).count() == 0


# problem 4


def _shards(spark, data):
    return compaction.records(spark.createDataFrame(data, "f string, s int, r string"), F.col("f"), F.col("s"), F.col("r"))


def test_shard_audit(spark):
    got = _shards(spark, [("a", 0, "x"), ("a", 0, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, None), ("b", 2, "q"), (None, 1, "n"), ("c", None, "n"), ("d", -1, "m")])
    held = compaction.slots(got)
    wrong = compaction.audit(held, 2)
    assert rows(wrong.where("kind = 'lost_index'").select("file", "slot")) == [("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert rows(wrong.where("kind = 'taken_twice'").select("file", "slot")) == [("a", 3)]
    assert rows(wrong.where("kind = 'small_shard'").select("file")) == [("b",), ("d",)]
    assert compaction.unplaced(got).first()[0] == 2 and compaction.audit(held.where("false")).count() == 0
    with pytest.raises(ValueError):
        compaction.audit(held, 3)


def test_a_wild_slot_and_stretches(spark):
    last = 3 * (1 << compaction.STRETCH_BITS) + 7
    held = compaction.slots(_shards(spark, [("w", 0, "a"), ("w", 70_000, "b"), ("w", last, "c"), ("x", 1, "d"), ("x", 1, "e")]))
    lost = compaction.audit(held, 1).where("kind = 'lost_index' AND file = 'w'")
    assert lost.count() == lost.select("slot").distinct().count() == last - 2 and lost.where("slot IN (0, 70000)").count() == 0
    assert rows(compaction.file_sizes(compaction.inventory(held))) == [("w", 3, 3), ("x", 1, 2)]


def test_plan_fills_files_and_keeps_every_record(spark):
    draw = random.Random(11)
    data = [(f"s{i % 2}/f{i:03}", s, f"r{i}.{s}") for i in range(120) for s in range(draw.choice([1, 2, 3, 5, 8, 13, 30, 60, 100, 200, 256]))]
    data.append(("s0/f000", 1 << 20, "far"))  # in another stretch of its file
    records = _shards(spark, data + data[:50])
    files = records.distinct().groupBy("file").agg(F.count("*").alias("n_records")).withColumn("part", F.substring("file", 1, 2))
    plan = compaction.plan(files, part="part")
    assert plan.count() == 120 and plan.select("file").distinct().count() == 120
    moved = compaction.relocate(records, plan)
    assert Counter(r["record"] for r in moved.collect()) == Counter(x[2] for x in data)
    sizes = moved.groupBy("new_file").agg(F.count("*").alias("n"), F.max("new_slot").alias("last"), F.countDistinct("new_slot").alias("slots"), F.min(F.substring("file", 1, 2)).alias("part"), F.countDistinct(F.substring("file", 1, 2)).alias("parts"))
    assert all(r["n"] <= 256 and r["last"] == r["n"] - 1 and r["slots"] == r["n"] and r["parts"] == 1 for r in sizes.collect())
    assert all(r["count"] <= 1 for r in sizes.where("n < 128").groupBy("part").count().collect())
    again = compaction.plan(files.repartition(7), part="part")
    assert rows(compaction.journal(plan)) == rows(compaction.journal(again))
    assert compaction.plan(files.where("false")).count() == 0
    with pytest.raises(ValueError):
        compaction.plan(files, target=100)


def test_many_files_of_one_size_leave_none_alone(spark):
    files = spark.range(20_000).select(F.format_string("f%05d", "id").alias("file"), F.lit(100).alias("n_records"))
    sizes = Counter(r["n"] for r in compaction.journal(compaction.plan(files)).select(F.col("n_inputs").alias("n")).collect())
    assert sizes == {2: 10_000}
    few = compaction.plan(files.limit(9).withColumn("n_records", F.lit(1)), fan=4, rest=False)
    assert sorted(r["n_inputs"] for r in compaction.journal(few).collect()) == [4, 4] and few.where("output IS NULL").count() == 1


def test_feature_files_are_compacted_too(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    features = spark.read.parquet(f"{folder}/train_feature_manifest.parquet")
    extra = [f"features/mfcc/f{i:04}.npy" for i in range(600)]
    spelt = [" /srv/x/./" + x.replace("/", "\\") for x in extra[:50]]  # other spellings of the same files
    more = spark.createDataFrame([(x,) for x in extra + spelt + [None, ""]], "mfcc_path string")
    features.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/train_feature_manifest.parquet")
    spark.read.parquet(f"{folder}/train_shard_manifest.parquet").write.parquet(f"{tmp_path}/train_shard_manifest.parquet")
    mine = "table_name = 'train_feature_manifest'"
    expected = {r[0] for r in features.select(keys.path_key("mfcc_path")).collect() if r[0]} | set(extra)
    moved = data_problems.p4_compacted(spark, str(tmp_path)).where(mine).collect()
    assert Counter(r["record"] for r in moved) == Counter(expected) and all(r["record"] == r["file"] for r in moved)
    sizes = Counter(r["new_file"] for r in moved)
    assert {(r["new_file"], r["new_slot"]) for r in moved} == {(f, i) for f, n in sizes.items() for i in range(n)}
    assert max(sizes.values()) <= compaction.TARGET and sum(n <= compaction.TARGET // 2 for n in sizes.values()) <= 1
    journal = data_problems.p4_journal(spark, str(tmp_path))
    assert {r["txn_id"]: r["n_records"] for r in journal.where(mine).collect()} == {f: n for f, n in sizes.items() if n > 1}
    assert journal.where("table_name = 'train_shard_manifest'").count() == data_problems.p4_journal(spark, folder).where("table_name = 'train_shard_manifest'").count() > 0


def test_unplaced_rows_are_reported(spark):
    folder = "/root/testdata/sf0.01"
    count = lambda table, path, slot: sum(not (r[0] or "").strip() or r[1] is None for r in spark.read.parquet(f"{folder}/{table}.parquet").selectExpr(path, slot).collect())
    expected = [("train_feature_manifest", count("train_feature_manifest", "mfcc_path", "0")), ("train_shard_manifest", count("train_shard_manifest", "shard_path", "shard_index"))]
    assert rows(data_problems.p4_unplaced(spark, folder)) == expected and min(n for _, n in expected) > 0


def _all_ids(spark, source, out, journal):
    there = [compaction._readable(r["file"]) for r in compaction.waiting_files(spark, source, journal).collect()]
    done = [r["id"] for r in compaction.consolidated(spark, out, journal).select("id").collect()] if compaction._folders(spark, out) else []
    return sorted(done + ([r["id"] for r in spark.read.parquet(*there).collect()] if there else []))


def test_compact_directory_is_idempotent(spark, tmp_path, monkeypatch):
    source, out, journal = (str(tmp_path / x) for x in ("in put", "out", "journal"))
    run = lambda **k: compaction.compact_directory(spark, source, out, journal, target_bytes=1 << 20, **k)
    files = lambda: len([f for f in os.listdir(out) if f.startswith("__")])
    spark.range(1000).repartition(30).write.parquet(source)
    assert run() >= 1 and _all_ids(spark, source, out, journal) == list(range(1000)) and files() <= 2 * compaction.FAN
    before = compaction.read_journal(spark, journal).count()
    assert run() == 0 and compaction.read_journal(spark, journal).count() == before
    # later files, and a run that breaks off after it has written records but before it commits them
    spark.range(1000, 1500).repartition(10).write.mode("append").parquet(source)
    carry = compaction._carry_out

    def broken(session, txns, *more):
        carry(session, txns, out, str(tmp_path / "lost"))
        raise RuntimeError("lost")

    monkeypatch.setattr(compaction, "_carry_out", broken)
    with pytest.raises(RuntimeError):
        run()
    assert _all_ids(spark, source, out, journal) == list(range(1500))
    monkeypatch.setattr(compaction, "_carry_out", carry)
    spark.range(1500, 1600).withColumn("more", F.lit("x")).repartition(5).write.mode("append").parquet(source)
    assert run() >= 2 and _all_ids(spark, source, out, journal) == list(range(1600)) and run() == 0
    assert run(finish=True) == 1 and files() == 1 and compaction.waiting_files(spark, source, journal).count() == 0
    assert compaction.consolidated(spark, out, journal).where("more = 'x'").count() == 100
    assert run(finish=True) == 0


def test_runs_with_one_small_file_each_end_in_few_files(spark, tmp_path, monkeypatch):
    source, out, journal = (str(tmp_path / x) for x in ("in", "out", "journal"))
    monkeypatch.setattr(compaction, "JOURNAL_FILES", 4)
    txns = 0
    for i in range(11):
        spark.range(5 * i, 5 * i + 5).coalesce(1).write.mode("append").parquet(source)
        txns += compaction.compact_directory(spark, source, out, journal, target_bytes=1 << 16, fan=3)
    assert _all_ids(spark, source, out, journal) == list(range(55))
    waiting, written = compaction.waiting_files(spark, source, journal).count(), len([f for f in os.listdir(out) if f.startswith("__")])
    assert waiting < 3 and written <= 4 and 3 <= txns <= 6 and len(os.listdir(journal)) <= 6


# problem 5


def test_orphans_by_mask_and_rule(spark):
    refs = references.references(spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, None), (4, "q", None), (5, "b", "x"), (6, None, "x"), (6, None, "x")], "i int, p string, q string"), F.col("i"), [F.col("p"), F.col("q")])
    there = references.targets(spark.createDataFrame([("a", "x"), ("a", "x"), (None, "z")], "p string, q string"), [F.col("p"), F.col("q")])
    found = lambda **k: sorted(r["row_key"] for r in references.orphans(refs, there, **k).collect())
    assert found(rule="simple") == [5]
    assert found(rule="partial") == [4, 5]
    assert found(rule="full") == [2, 4, 5, 6, 6]
    assert found(rule="simple", rules={(False, True): "full"}) == [2, 4, 5]
    empty = references.orphans(refs, there.where("false"), rule="partial")
    assert sorted(r["row_key"] for r in empty.collect()) == [1, 2, 4, 5, 6, 6]
    with pytest.raises(ValueError):
        references.orphans(refs, there, rule="odd")


def test_orphans_in_time_against_brute_force(spark):
    draw = random.Random(5)
    day = lambda: T0 + dt.timedelta(days=draw.randrange(30))
    stored = [(draw.choice("abc"), day(), draw.choice([None, day(), day()])) for _ in range(25)]
    refs = [(i, draw.choice(["a", "b", "c", "d", None]), draw.choice([day(), day(), None])) for i in range(200)]
    there = references.targets(spark.createDataFrame(stored, "p string, s timestamp_ntz, u timestamp_ntz"), [F.col("p")], F.col("s"), F.col("u"))
    got = references.orphans(references.references(spark.createDataFrame(refs, "i int, p string, at timestamp_ntz"), F.col("i"), [F.col("p")], F.col("at")), there)
    expected = [i for i, p, at in refs if p and at and not any(q == p and s <= at and (u is None or u > at) for q, s, u in stored)]
    assert sorted(r["row_key"] for r in got.collect()) == expected
    assert sum(r["orphans"] for r in references.by_period(got, "t").collect()) == len(expected)


def test_running_total(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("o"), "id", (F.col("id") % 5).alias("v"))
    got = prefix.running_total(df, ["g"], "o", "v", "id", ranges=8).collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["o"], r["id"])):
            assert r["before"] == total
            total += r["v"]
