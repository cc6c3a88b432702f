"""Tables that are stored for a use: by key in buckets, vectors by centroid, texts by trigram.

Each is a folder of Parquet below one that all executors share, laid out so that a use
reads or rewrites only the partitions it concerns; results are exact, the layout only
decides how much is read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..plans.lineage import cut
from . import search, tables


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Keyed:
    """A table by key in hash buckets, of which an upsert or a delete rewrites only those its keys fall in."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> Keyed:
        self.schema = rows.schema
        self._dealt(rows).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self.path)
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().drop("_bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that keys fall in: as many numbers as there are buckets, at most."""
        return sorted(r[0] for r in self._dealt(keys).select("_bucket").distinct().collect())

    def _rewrite(self, buckets: list[int], rows: DataFrame) -> None:
        """Replaces buckets by rows: computed first, then put in place as a whole, so a repeated attempt ends alike."""
        done = cut(self._dealt(rows.select(self.schema.names)))
        done.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        left = {r[0] for r in done.select("_bucket").distinct().collect()}
        for b in set(buckets) - left:  # a bucket that lost all its rows is no partition of the new ones
            fs, p = _fs(self.spark, f"{self.path}/_bucket={b}")
            fs.delete(p, True)

    def upsert(self, new: DataFrame, keep_old: tuple[str, ...] = ()) -> list[int]:
        """tables.upsert() of rows with unique keys; returns the buckets that were rewritten."""
        new = cut(new)
        buckets = self.touched(new)
        if buckets:
            old = self._stored().where(F.col("_bucket").isin(buckets)).drop("_bucket")
            self._rewrite(buckets, tables.upsert(old, new, self.keys, keep_old))
        return buckets

    def overlay(self, new: DataFrame) -> list[int]:
        """tables.overlay(), property by property."""
        new = cut(new)
        buckets = self.touched(new)
        if buckets:
            self._rewrite(buckets, tables.overlay(self._stored().where(F.col("_bucket").isin(buckets)).drop("_bucket"), new, self.keys))
        return buckets

    def delete(self, keys: DataFrame) -> list[int]:
        keys = cut(keys.select(*self.keys).distinct())
        buckets = self.touched(keys)
        if buckets:
            self._rewrite(buckets, self._stored().where(F.col("_bucket").isin(buckets)).drop("_bucket").join(keys, self.keys, "left_anti"))
        return buckets


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centroids(sample: np.ndarray, cells: int, steps: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means, from evenly spaced ones."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(steps):
        own = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        n = np.linalg.norm(sums, axis=1) > 0
        c[n] = unit(sums[n])
    return c


class Vectors:
    """Points stored by their nearest centroid; a search reads the cells that may hold one of the k nearest.

    Centroids are fitted on `sample` points, the first by hash of their id.  Of each
    cell the widest angle from its centroid is kept, so no point in it is nearer to a
    query than the centroid's angle less that: a search probes the nearest cells, and
    with the k-th score so far reads those others that may still hold a better one.
    """

    def __init__(self, points: DataFrame, path: str, cells: int = 64, sample: int = 20_000, key: str = "vec_id", embedding: str = "embedding"):
        self.key, self.embedding, self.path, self.spark = key, embedding, path, points.sparkSession
        some = points.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(embedding).toPandas()[embedding]
        x = unit(np.array([np.asarray(v, float) for v in some]).reshape(len(some), -1))
        self.centres = c = centroids(x, max(1, min(cells, len(x)))) if len(x) else x

        def assigned(batches):
            for pdf in batches:
                v = np.array([np.asarray(e, float) if e is not None else np.zeros(c.shape[1]) for e in pdf[embedding]]).reshape(len(pdf), c.shape[1])
                near = unit(v) @ c.T
                cell = near.argmax(1) if len(pdf) else np.zeros(0, int)
                flat = ~np.any(v, axis=1)
                # Points without direction have no score; they lie in a cell that no search reads.
                yield pdf.assign(_cell=np.where(flat, -1, cell).astype("int32"), _angle=np.arccos(np.clip(near[np.arange(len(pdf)), cell], -1, 1)))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
        points.mapInPandas(assigned, f"{fields}, _cell int, _angle double").repartition("_cell").write.mode("overwrite").partitionBy("_cell").parquet(path)
        self.points = self.spark.read.parquet(path)
        found = self.points.where("_cell >= 0").groupBy("_cell").agg(F.max("_angle").alias("a")).collect()  # a row for each cell
        self.cells, self.widest = np.array([r["_cell"] for r in found], int), np.array([r["a"] for r in found])

    def _angles(self, query) -> np.ndarray:
        return np.arccos(np.clip(unit(np.asarray(query, float)[None, :])[0] @ self.centres[self.cells].T, -1, 1))

    def probed(self, query, probes: int) -> DataFrame:
        """The points of the cells whose centroids are nearest."""
        near = self.cells[np.argsort(self._angles(query), kind="stable")[:probes]]
        return self.points.where(F.col("_cell").isin(near.tolist()))

    def search(self, query, k: int = 10, probes: int = 4, exact: bool = True) -> DataFrame:
        """The k nearest points by cosine, as search.semantic() finds them; without `exact` of the probed cells only."""
        found = search.semantic(self.probed(query, probes).drop("_cell", "_angle"), query, k, key=self.key, embedding=self.embedding)
        if not exact:
            return found
        scores = [r["score"] for r in found.select("score").collect()]  # k rows
        least = min(scores) if len(scores) == k else -math.inf
        # A margin for rounding: a cell is left out only if it is surely too far.
        best = np.cos(np.maximum(0, self._angles(query) - self.widest)) + 1e-6
        self.read = self.cells[best >= least]
        return search.semantic(self.points.where(F.col("_cell").isin(self.read.tolist())).drop("_cell", "_angle"), query, k, key=self.key, embedding=self.embedding)


class Trigrams:
    """Postings from the trigrams of text columns to keys, so a LIKE reads the rows that may match and tests these."""

    def __init__(self, rows: DataFrame, path: str, key: str, columns: tuple[str, ...], buckets: int = 32):
        self.rows, self.key, self.columns, self.buckets = rows, key, columns, buckets
        def cut_up(c):
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.lower(F.col(c)), i, F.lit(3)))

        cols = [cut_up(c) for c in columns]
        every = rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in cols])))).alias("gram")).where(F.length("gram") == 3)
        every = every.withColumn("_bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        # A common gram is spread over files by key; in a file grams are sorted, so row groups can be skipped too.
        every.repartitionByRange("_bucket", "gram", key).sortWithinPartitions("_bucket", "gram").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        self.postings = rows.sparkSession.read.parquet(path)

    @staticmethod
    def grams(query: str) -> list[str]:
        """The trigrams that every text LIKE %query% holds: of its stretches without wildcards."""
        out: list[str] = []
        for part in query.lower().replace("_", "%").split("%"):
            out += [part[i : i + 3] for i in range(len(part) - 2)]
        return sorted(set(out))

    def candidates(self, query: str) -> DataFrame | None:
        """Keys of the rows that hold all trigrams of a query, in any of the columns; None if it has none."""
        grams = self.grams(query)
        if not grams:
            return None
        spark = self.rows.sparkSession
        own = spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(self.buckets)).cast("int")).distinct()
        buckets = [r[0] for r in own.collect()]  # a number for each trigram of the query
        hit = self.postings.where(F.col("_bucket").isin(buckets) & F.col("gram").isin(grams))
        return hit.groupBy(self.key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(self.key)

    def like(self, query: str) -> DataFrame:
        """Rows of which a column holds the query, as ILIKE %query% tells."""
        few = self.candidates(query)
        rows = self.rows if few is None else self.rows.join(few, self.key, "left_semi")
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
        return rows.where(hit)


def looked_up(requests: DataFrame, cache: DataFrame, now, ttl: int, ts: str = "ts") -> DataFrame:
    """requests(cache_key, ts) with the vector that cache(cache_key, vector, inserted, used) holds and that hasn't expired `ttl` seconds after it was inserted; null where it must be made."""
    live = cache.where(F.unix_micros(F.col("inserted").cast("timestamp")) + ttl * 1_000_000 > F.unix_micros(now.cast("timestamp")))
    return requests.join(live.select("cache_key", "vector"), "cache_key", "left")


def refreshed(cache: DataFrame, requests: DataFrame, made: DataFrame, now, ttl: int, capacity: int, ts: str = "ts") -> DataFrame:
    """The cache after requests(cache_key, ts), with vectors made(cache_key, vector) for those it lacked.

    What has expired goes; a request sets an entry's last use, a made vector enters
    at its first request, and beyond `capacity` the entries that were used least
    recently are evicted, of equals those of greater key: a top-k, as the cache is bounded.
    """
    uses = requests.groupBy("cache_key").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    live = cache.where(F.unix_micros(F.col("inserted").cast("timestamp")) + ttl * 1_000_000 > F.unix_micros(now.cast("timestamp")))
    old = live.join(uses, "cache_key", "left").select("cache_key", "vector", "inserted", F.greatest("used", "_last").alias("used"))
    new = made.dropDuplicates(["cache_key"]).join(live.select("cache_key"), "cache_key", "left_anti").join(uses, "cache_key")
    new = new.select("cache_key", "vector", F.col("_first").alias("inserted"), F.col("_last").alias("used"))
    return old.unionByName(new).orderBy(F.desc("used"), "cache_key").limit(capacity)
