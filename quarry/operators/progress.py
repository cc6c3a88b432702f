"""Durable progress of a run through its stages, and going on where one stopped.

A run's files are dealt into batches by a hash of their path, so a batch is the same on
every attempt.  A stage turns a batch of its predecessor's output into its own, in a
folder of its own that is overwritten as a whole: a batch done twice is there once.
Behind each batch a checkpoint is appended: run, stage, batch, files, tier and a number
that grows.  A run that is resumed reads them, leaves out the batches they name, and
ends with the tables that a run without a stop has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, last_stage string, batch int, files_processed long, tier string, cleared boolean, seq long, created_at timestamp"


def batch_of(path: str, batches: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(batches)).cast("int")


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """All checkpoints below a folder; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/checkpoints")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{root}/checkpoints")


def latest(log: DataFrame, run_id: str | None = None) -> DataFrame:
    """The last checkpoint of each run, or of one, that has not been cleared since."""
    rows = log if run_id is None else log.where(F.col("run_id") == run_id)
    rest = [c for c in rows.columns if c != "run_id"]
    last = rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), "seq").alias("_c"))
    return last.select("run_id", "_c.*").where(~F.col("cleared")).select(rows.columns)


def resumable(log: DataFrame) -> DataFrame:
    """The newest checkpoint of all runs that were not cleared, as when a run's id is lost: one row or none."""
    return latest(log).orderBy(F.desc("seq"), "run_id").limit(1)


def completed(log: DataFrame, run_id: str) -> DataFrame:
    """last_stage and batch of what a run has done since it was last cleared."""
    own = log.where(F.col("run_id") == run_id)
    since = own.where("cleared").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_s"))
    return own.where("NOT cleared").join(F.broadcast(since), F.col("seq") > F.col("_s")).select("last_stage", "batch").distinct()


class Run:
    """A run of stages over files(file_path, ...), below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], batches: int = 16, tier: str = "full"):
        self.spark, self.root, self.run_id, self.stages, self.batches, self.tier = spark, root.rstrip("/"), run_id, stages, batches, tier

    def _path(self, stage: str, batch: int) -> str:
        return f"{self.root}/{self.run_id}/{stage}/batch={batch}"

    def _note(self, stage: str, batch: int, files: int, cleared: bool = False) -> None:
        # One row a batch: the log grows with batches, not with files.
        seq = (checkpoints(self.spark, self.root).agg(F.max("seq")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(self.run_id, stage, batch, files, self.tier, cleared, seq)], SCHEMA.rsplit(",", 1)[0]).withColumn("created_at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/checkpoints")

    def table(self, stage: str) -> DataFrame:
        """A stage's output of all batches."""
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(self._path(stage, b)) for b in range(self.batches)])

    def go(self, files: DataFrame) -> DataFrame:
        """Runs what is still to do and returns the last stage's table; checkpoints stay until clear()."""
        done = {(r["last_stage"], r["batch"]) for r in completed(checkpoints(self.spark, self.root), self.run_id).collect()}  # stages times batches at most
        dealt = files.withColumn("_batch", batch_of("file_path", self.batches))
        for i, (name, stage) in enumerate(self.stages):
            for b in range(self.batches):
                if (name, b) in done:
                    continue
                rows = dealt.where(F.col("_batch") == b).drop("_batch") if i == 0 else self.spark.read.parquet(self._path(self.stages[i - 1][0], b))
                out = stage(rows)
                out.write.mode("overwrite").parquet(self._path(name, b))
                self._note(name, b, rows.select("file_path").distinct().count() if "file_path" in rows.columns else 0)
        return self.table(self.stages[-1][0])

    def clear(self) -> None:
        """Marks the run as finished: it is resumable no longer, and would begin anew."""
        self._note("", -1, 0, cleared=True)
