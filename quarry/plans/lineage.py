"""Cutting lineage: results of rounds are written once below the session's shared checkpoint folder, so a lost executor costs only its tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def folder(spark, label: str) -> str:
    """A new path below spark.checkpoint.dir; a folder of our own, deleted at the end, stands in only where that is empty (one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quarry-lineage-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/quarry-{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, as a table in a folder()."""
    path = folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def changed(spark, *paths: str) -> tuple[int, ...]:
    """When each path was last written, in milliseconds: of a folder the latest of its files; 0 if it isn't there."""
    jvm, out = spark.sparkContext._jvm, []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            out.append(0)
            continue
        at = fs.getFileStatus(p)
        out.append(max([at.getModificationTime(), *(f.getModificationTime() for f in (fs.listStatus(p) if at.isDirectory() else []))]))
    return tuple(out)
