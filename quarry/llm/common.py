"""What the operators of this package share: scratch tables, ids, text columns.

Scratch tables are Parquet in a folder below ``spark.checkpoint.dir`` of the
session, which driver and executors share, so a lost executor costs only the
tasks it ran.  A folder of our own is set only where that setting is empty,
as in tests on one machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables, a URI that Spark reads and writes."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not _own:
        import shutil

        _own.append(tempfile.mkdtemp(prefix="quarry-scratch-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/quarry-{label}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df to a scratch table and returns that table: lineage is cut, work is done once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes scratch tables of written() that no later step reads, so the folder holds only what is still needed."""
    for df in tables:
        remove_path(df.sparkSession, df.scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str, folds: int):
    """crc32 of doc_id as text, modulo folds; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def partitions_for(df: DataFrame, per_split: int = 4) -> int:
    """Range or hash partitions for a shuffle of whole rows: so many for each input split."""
    return max(df.sparkSession.sparkContext.defaultParallelism, per_split * df.rdd.getNumPartitions(), 1)


def slices(rows: int, sizes, most: int):
    """Consecutive (start, end) over rows, each of about `most` units of size, at least one row."""
    start, held = 0, 0
    for i in range(rows):
        if held and held + sizes[i] > most:
            yield start, i
            start, held = i, 0
        held += sizes[i]
    if rows > start:
        yield start, rows
