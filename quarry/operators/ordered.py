"""Previous rows and running totals by key without a task for each key.

Rows are dealt out by ranges of (key, order), so a key of any size is spread over
as many partitions as its rows fill.  Windows run inside a partition; what crosses
into the next one, the last row and the total of the last key, is one row a
partition, which is joined back to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def ranged(df: DataFrame, key: str, order: str) -> DataFrame:
    """df in order of key and order, stored, with `_i`, a number that grows along it."""
    rows = df.repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order)
    return cut(rows.withColumn("_i", F.monotonically_increasing_id()))


def previous(rows: DataFrame, key: str, *cols: str) -> DataFrame:
    """rows of ranged() with `_was`, a struct of columns of the row before of the same key; null at a key's first."""
    rows = rows.withColumn("_p", F.shiftright("_i", 33))
    one = F.struct(F.col(key).alias("_k"), *cols)
    ends = rows.groupBy("_p").agg(F.max_by(one, "_i").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.orderBy("_p")))  # one row a partition
    out = rows.withColumn("_was", F.lag(one).over(Window.partitionBy("_p").orderBy("_i"))).join(F.broadcast(ends), "_p")
    was = F.coalesce("_was", "_end")
    return out.withColumn("_was", F.when(was["_k"].eqNullSafe(F.col(key)), was)).drop("_p", "_end")


def running(rows: DataFrame, key: str, value: Column, name: str, most: bool = False) -> DataFrame:
    """rows of ranged() with the sum of a value up to each row of its key, or with `most` its maximum."""
    agg = F.max if most else F.sum
    rows = rows.withColumn("_p", F.shiftright("_i", 33)).withColumn("_v", value)
    w = Window.partitionBy("_p", key).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = rows.groupBy("_p", F.col(key).alias("_k")).agg(agg("_v").alias("_s"), F.max("_i").alias("_m"))
    tails = per.groupBy("_p").agg(F.min_by("_k", "_m").alias("_first"), F.max_by(F.struct("_k", "_s"), "_m").alias("_t"))
    # One row a partition: totals of a last key over the partitions it ends, handed to the next one if it begins with that key.
    tails = tails.withColumn("_r", F.struct(F.col("_t._k").alias("_k"), agg("_t._s").over(Window.partitionBy("_t._k").orderBy("_p")).alias("_s")))
    before = F.lag("_r").over(Window.orderBy("_p"))
    tails = tails.withColumn("_c", before).select("_p", "_first", F.when(F.col("_c._k").eqNullSafe(F.col("_first")), F.col("_c._s")).alias("_carry"))
    out = rows.withColumn("_own", agg("_v").over(w)).join(F.broadcast(tails), "_p")
    carry = F.when(F.col(key).eqNullSafe(F.col("_first")), F.col("_carry"))
    total = F.greatest("_own", carry) if most else F.coalesce(F.col("_own") + carry, F.col("_own"), carry)
    return out.withColumn(name, total).drop("_p", "_v", "_own", "_first", "_carry")
