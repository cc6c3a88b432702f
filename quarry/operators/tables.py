"""Upserts, change detection and set comparison of tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order: an aggregate, so a key's rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of old overwritten by rows of new with equal keys, and the rest of both; keep_old columns take new only where it isn't null."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.withColumn("_o", F.lit(True)).alias("o").join(n.withColumn("_n", F.lit(True)).alias("n"), on, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys or c in keep_old:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*cols)


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old and new by key, a property at a time: new where it isn't null, maps entry by entry."""
    from pyspark.sql.types import MapType

    both = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")

    def one(c):
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if isinstance(old.schema[c].dataType, MapType):
            kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(kept, b))
        return F.coalesce(b, a)

    return both.select(*[one(c).alias(c) for c in old.columns])


def page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows behind a key, in its order: a scroll whose cost doesn't grow with its depth."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(int(size))


def counted(df: DataFrame, **by) -> DataFrame:
    """How many rows equal each value that isn't None."""
    for c, v in by.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.agg(F.count("*").alias("cnt"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti").select(old.columns))


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone, keys, "left_anti")


def changes(stored: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status (changed, unchanged, deleted): new keys are changed, and so is a null digest, which counts as unreadable."""
    s, n = stored.select(key, F.col(digest).alias("s"), F.lit(True).alias("_s")), now.select(key, F.col(digest).alias("n"), F.lit(True).alias("_n"))
    both = s.join(n, key, "full_outer")
    status = F.when(F.col("_n").isNull(), "deleted").when(F.col("_s").isNotNull() & (F.col("s") == F.col("n")), "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"))


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys to clean up: existing without current; none at all if current is empty."""
    guard = current.select(key).limit(1).agg((F.count("*") > 0).alias("_any"))
    return existing.select(key).distinct().join(current.select(key), key, "left_anti").crossJoin(guard).where("_any").select(key)


def presence(key: str, **stores: DataFrame) -> DataFrame:
    """One row for each key of any store, with in_<store> booleans, synced and missing (names of stores)."""
    out = None
    for name, df in stores.items():
        one = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(f"in_{name}", F.lit(True))
        out = one if out is None else out.join(one, key, "full_outer")
    flags = [F.coalesce(F.col(f"in_{n}"), F.lit(False)).alias(f"in_{n}") for n in stores]
    out = out.select(key, *flags)
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"in_{n}"), F.lit(n)) for n in stores])), ",")
    synced = F.lit(True)
    for n in stores:
        synced = synced & F.col(f"in_{n}")
    return out.withColumn("synced", synced).withColumn("missing", missing)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(df.columns)


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def tree(paths: DataFrame, path: str = "path", is_dir: str | None = None) -> DataFrame:
    """path, parent, name, is_dir: a row for each file and folder that flat paths name; a folder named by itself is one, even if empty."""
    parts = F.split(path, "/")
    own = F.lit(False) if is_dir is None else F.col(is_dir)
    rows = paths.select(F.filter(parts, lambda x: x != "").alias("p"), own.alias("d")).select("p", "d", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    at = lambda k: F.array_join(F.slice("p", F.lit(1), k), "/")
    rows = rows.select(at(F.col("k")).alias("path"), F.when(F.col("k") > 1, at(F.col("k") - 1)).alias("parent"), F.element_at("p", F.col("k")).alias("name"), ((F.col("k") < F.size("p")) | F.col("d")).alias("is_dir"))
    return rows.groupBy("path", "parent", "name").agg(F.bool_or("is_dir").alias("is_dir"))
