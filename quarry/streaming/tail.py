"""Structured Streaming over the event log: tail, deduplication, event-time windows, rate limits."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """New rows of a folder of Parquet files, at most `files` files a batch (the bound that back-pressure gives)."""
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.parquet(path)


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time with a watermark; zoneless timestamps are read as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated rows of a key are dropped as long as the watermark remembers it."""
    return events.dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, ts: str, width: str, *by: str, slide: str | None = None) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("bucket"), *by, "cnt")


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("cnt")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cnt")


def rate_limit(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """One row for each key and batch: requests let through and refused; a window opens at the first request after the last one passed."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        passed = refused = 0
        times = np.sort(np.concatenate([b[ts].astype("datetime64[ns]").to_numpy().astype(np.int64) for b in batches])) / 1e9
        i = 0
        while i < len(times):  # a window at a time
            if start is None or times[i] - start >= seconds:
                start, n = float(times[i]), 0
            end = int(np.searchsorted(times, start + seconds, "left"))
            ok = min(max(0, limit - n), end - i)
            passed, refused, n, i = passed + ok, refused + end - i - ok, n + end - i, end
        state.update((start, n))
        yield pd.DataFrame({key: [k[0]], "passed": [passed], "refused": [refused]})

    return events.select(key, ts).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, passed long, refused long", "start double, n long", "update", GroupStateTimeout.NoTimeout)


def of_workspace(events: DataFrame, workspace_id: str) -> DataFrame:
    """The events of one workspace, whatever their execution."""
    return events.where(F.col("workspace_id") == workspace_id)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is there to a Parquet table, and ends; a restart goes on at the checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def follow(stream: DataFrame, kind: str, terminal: tuple[str, ...], each, checkpoint: str, every: str = "500 milliseconds", seconds: float = 3600.0) -> bool:
    """Hands every batch to each(batch, number) until a terminal event has come; then drains what is there and ends. False if none came in time."""
    done = threading.Event()

    def run(batch: DataFrame, number: int) -> None:
        each(batch, number)
        if batch.where(F.col(kind).isin(*terminal)).take(1):
            done.set()

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        end = time.monotonic() + seconds
        while q.isActive and not done.wait(0.1) and time.monotonic() < end:
            pass
        if done.is_set() and q.isActive:
            q.processAllAvailable()
        if (e := q.exception()) is not None:
            raise e
    finally:
        q.stop()
    return done.is_set()
