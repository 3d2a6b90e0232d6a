"""NPZ shards: a data source that reads them, one partition to a file, and a writer of at most ``size`` records to a shard."""

from __future__ import annotations

import io
import os
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FAMILIES = ("mfcc", "mel", "spectral", "chroma", "zcr", "energy")
TEXTS = ("segment_ids", "source_sha256", "recording_group_ids")


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


def checked_shard(held: dict[str, np.ndarray]) -> list[str]:
    """What is wrong with a shard: missing arrays, lengths that differ, labels outside of 0 and 1, ids missing or repeated, values that aren't finite."""
    issues = [f"{k} is missing" for k in (*FAMILIES, "labels", *TEXTS) if k not in held]
    if issues:
        return issues
    n = len(held["labels"])
    issues += [f"{k} has {len(held[k])} records, not {n}" for k in (*FAMILIES, *TEXTS) if len(held[k]) != n]
    issues += [f"{k} has {held[k].ndim} dimensions, not 3" for k in FAMILIES if held[k].ndim != 3]
    issues += [f"{k} has values that are not finite" for k in FAMILIES if not np.isfinite(held[k]).all()]
    ids = held["segment_ids"].astype(str)
    if not np.isin(held["labels"], (0, 1)).all():
        issues.append("labels outside of 0 and 1")
    if (np.char.str_len(ids) == 0).any() or len(set(ids.tolist())) != len(ids):
        issues.append("segment ids missing or repeated")
    return issues


class NpzReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        found = sorted(os.path.join(root, n) for root, _, names in os.walk(self.folder) for n in names if n.endswith(".npz"))
        return [_Shard(p) for p in found] or [_Shard("")]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        if not partition.path:
            return
        with np.load(partition.path, allow_pickle=False) as f:
            held = {k: f[k] for k in f.files}
        name = os.path.relpath(partition.path, self.folder).replace(os.sep, "/")
        if issues := checked_shard(held):
            yield name, -1, None, None, None, None, "; ".join(issues), *[None] * len(FAMILIES)
            return
        for i in range(len(held["labels"])):
            yield name, i, int(held["labels"][i]), str(held["segment_ids"][i]), str(held["source_sha256"][i]), str(held["recording_group_ids"][i]), "", *[held[k][i].tolist() for k in FAMILIES]


class NpzSource(DataSource):
    """``spark.read.format("npz_shards").load(folder)``; a shard that fails its checks is one row that names its issues."""

    @classmethod
    def name(cls) -> str:
        return "npz_shards"

    def schema(self) -> str:
        return "shard_path string, shard_index int, label int, segment_id string, source_sha256 string, recording_group_id string, issues string, " + ", ".join(f"{k} array<array<float>>" for k in FAMILIES)

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)


def write_npz(df: DataFrame, folder: str) -> DataFrame:
    """Writes shards and gives the shard manifest.

    df: ``split, shard_no, slot, segment_id, label, source_sha256, recording_group_id`` and the six families, a shard's
    records few enough for one task (see ``manifests.shard_numbers``). A shard appears under its name once it is whole.
    """

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        name = f"{key[0]}/shard_{key[1]:05d}.npz"
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        arrays = {k: np.array([[list(c) for c in x] for x in rows[k]], np.float32) for k in FAMILIES}
        out = io.BytesIO()
        np.savez(out, **arrays, labels=rows["label"].to_numpy(np.int64), segment_ids=rows["segment_id"].to_numpy(str), source_sha256=rows["source_sha256"].to_numpy(str), recording_group_ids=rows["recording_group_id"].to_numpy(str))
        with open(f"{path}.{os.getpid()}.part", "wb") as f:
            f.write(out.getvalue())
        os.replace(f"{path}.{os.getpid()}.part", path)
        return pd.DataFrame({"split": key[0], "segment_id": rows["segment_id"].values, "binary_label": rows["label"].to_numpy(np.int32), "source_sha256": rows["source_sha256"].values, "recording_group_id": rows["recording_group_id"].values, "shard_path": name, "shard_index": np.arange(len(rows), dtype=np.int32)})

    schema = "split string, segment_id string, binary_label int, source_sha256 string, recording_group_id string, shard_path string, shard_index int"
    return df.groupBy("split", "shard_no").applyInPandas(write, schema)


def wav_bytes(samples, rate: int = 16_000) -> bytes:
    x = np.clip(np.asarray(samples, np.float64), -1, 1)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(struct.pack(f"<{len(x)}h", *np.round(x * 32767).astype(int).tolist()))
    return out.getvalue()


def write_wav_segments(df: DataFrame, folder: str, rate: int = 16_000, overwrite: bool = False) -> DataFrame:
    """Writes one PCM-16 file for each row of ``split, dataset, label, sha, index, wave`` and gives the paths.

    Names follow from the row alone, ``<split>/label_<label>/<dataset>/<sha>_<index>.wav``, so a task that is run again
    writes the same files; existing ones are left alone unless ``overwrite``.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths, done = [], []
            for r in frame.itertuples(index=False):
                name = f"{r.split}/label_{r.label}/{r.dataset}/{r.sha}_{r.index:04d}.wav"
                path = os.path.join(folder, name)
                new = overwrite or not os.path.exists(path)
                if new:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(f"{path}.{os.getpid()}.part", "wb") as f:
                        f.write(wav_bytes(r.wave, rate))
                    os.replace(f"{path}.{os.getpid()}.part", path)
                paths.append(name), done.append("written" if new else "skipped")
            yield pd.DataFrame({"path": paths, "status": done})

    return df.select("split", "dataset", "label", "sha", F.col("index").cast("int").alias("index"), "wave").mapInPandas(write, "path string, status string")


def text_lines_with_ids(spark: SparkSession, folder: str, ids: list[str], glob: str = "*", width: int = 1000) -> DataFrame:
    """``file, line_number, line, id`` of text lines that contain an id; lines are reported up to ``width`` characters but searched whole."""
    from sonarmill.operators.diagnostics import texts_with_ids

    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    whole = read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).withColumn("place", F.concat_ws("\x1f", "file", (F.col("at") + 1).cast("string")))
    hits = texts_with_ids(lines.select("place", "line"), "place", "line", ids)
    return lines.join(hits, "place").select("file", (F.col("at") + 1).alias("line_number"), F.left("line", F.lit(width)).alias("line"), "id")
