"""Streaming operators: windows over sample streams with a carried tail, event windows with late data, and history logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonarmill.session import checkpoint_dir

SAMPLE_WINDOWS = "stream string, index bigint, start bigint, end bigint, rms double, peak double, zcr double"
_STATE = "tail array<double>, offset bigint, index bigint"


def sample_windows(blocks: DataFrame, window: int, hop: int) -> DataFrame:
    """Sliding windows over streams of sample blocks ``stream, seq, samples``; a window spans blocks and micro-batches.

    State per stream is what the next window still needs: fewer than ``window`` samples, an offset and an index. Blocks of
    a micro-batch are put in the order of ``seq``; across micro-batches they must arrive in order, as from a pipe.
    """
    if not 0 < hop <= window:
        raise ValueError("the hop must be positive and not longer than the window")
    names = [x.split()[0] for x in SAMPLE_WINDOWS.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, offset, index = state.get if state.exists else ([], 0, 0)
        parts = [(int(s), np.asarray(x, np.float64)) for frame in frames for s, x in zip(frame["seq"], frame["samples"], strict=True) if x is not None]
        buffer = np.concatenate([np.asarray(tail, np.float64), *[x for _, x in sorted(parts, key=lambda p: p[0])]]) if parts else np.asarray(tail, np.float64)
        rows, at = [], 0
        while at + window <= len(buffer):
            w = buffer[at : at + window]
            sign = w < 0
            rows.append((key[0], index, offset + at, offset + at + window, float(np.sqrt((w * w).mean())), float(np.abs(w).max()), float((sign[1:] != sign[:-1]).sum() / window)))
            at, index = at + hop, index + 1
        state.update((buffer[at:].tolist(), offset + at, index))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    rows = blocks.select(F.col("stream").cast("string").alias("stream"), F.col("seq").cast("bigint").alias("seq"), "samples").where("stream IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("stream").applyInPandasWithState(step, SAMPLE_WINDOWS, _STATE, "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, length: str = "4 hours", hop: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Counts and totals of events in sliding windows; what comes later than ``late`` after the newest is dropped."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", length, hop), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("started"), "event_type", "n", "total")


def session_events(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a user in sessions that end after a gap."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("started"), "user_id", "n")


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, with the schema that they have; the path is a folder or a file, named here by a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path.rstrip("/") + "*")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder, and gives that table.

    In complete mode each micro-batch replaces the table, in append mode it is added under its batch number, so that a
    batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    home = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        target = f"{home}/out" if mode == "complete" else f"{home}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{home}/out")
    return out.select(*stream.columns)


def append_history(stream: DataFrame, path: str, checkpoint: str):
    """An append-only log of detections, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows read and written per query, as they come; ``then`` is called with each report."""

    def __init__(self, then=None):
        self.reports: list[tuple[str, int, int]] = []
        self.then = then

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report = (str(event.progress.id), event.progress.batchId, event.progress.numInputRows)
        self.reports.append(report)
        if self.then:
            self.then(report)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def with_fallback(stream_result, batch_result):
    """The streaming result, or the batch result of the same transform if the stream fails; its state isn't kept. Other faults are raised."""
    try:
        return stream_result()
    except StreamingQueryException:
        return batch_result()
