"""Sinks that may be asked twice, and jobs on a clock.

A micro-batch has a number that it keeps if it is run again after a failure; what is
written for it goes to a folder of that number, as a whole, so it is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Audit rows to a write.
AUDIT_ROWS = 64


def put(batch: DataFrame, number: int, path: str, rows: int = AUDIT_ROWS, key: str | None = None) -> None:
    """One batch into its folder, in files of so many rows at most; with a key, rows that repeat in it are written once."""
    batch = batch.dropDuplicates([key]) if key else batch
    batch.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{path.rstrip('/')}/batch={number}")


def audited(stream: DataFrame, path: str, checkpoint: str, rows: int = AUDIT_ROWS, key: str | None = None, every: str | None = None) -> StreamingQuery:
    """Appends a stream of audit rows; a batch that is run again replaces itself. Without `every`, all that is there, and an end."""
    w = stream.writeStream.foreachBatch(lambda b, n: put(b, n, path, rows, key)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def entries(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """What audited() wrote; with a key, once each, the earliest batch's row."""
    rows = spark.read.parquet(path)
    if key is None:
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")


def scheduled(spark: SparkSession, every: str, jobs: dict[str, Callable[[], DataFrame]], path: str, checkpoint: str) -> StreamingQuery:
    """Runs each job's query once a tick and keeps its rows, with the tick's number and time, below path/name; a tick that is run again replaces itself."""

    def tick(clock: DataFrame, number: int) -> None:
        now = clock.agg(F.max("timestamp")).first()[0]
        for name, job in jobs.items():
            put(job().withColumn("tick", F.lit(number)).withColumn("at", F.lit(now)), number, f"{path.rstrip('/')}/{name}", 1_000_000)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
