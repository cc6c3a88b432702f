"""Exact top-k search by inner product over a pivot-distance index.

Components are whole numbers: floor(scale * x).  An inner product falls as a
distance grows once every vector gets one more component that makes all their
norms equal (a query's is 0), so the nearest of these are the best.  Vectors are
keyed by their nearest pivot (centres of a bounded sample) and their distance to
it; a pivot's vectors, sorted by distance, are cut into annuli of equal counts.
By the triangle inequality no vector of an annulus is nearer to a query than the
query's own distance to the pivot is outside the annulus's two radii.

A query opens annuli by growing bound, in rounds: after each, it goes on only
with those whose bound is within the distance that its k-th best score stands for,
and stops when there are none.  So results are exact, whatever the pivots; vectors
without structure leave little to skip, and a query then meets all annuli.

Annuli and the queries that open them meet in tiles of TILE vectors by QUERIES
queries, multiplied as matrices in doubles, in which the products are exact; each
tile hands on the best of a query only.  Equal vectors are one entry with their
k + 1 smallest ids, more than which no query can list; equal queries are asked once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import _bytes, _tiles

#: Vectors that pivots are fitted on; vectors to an annulus, at least; most pivots, and most annuli of one.
SAMPLE, ANNULUS, PIVOTS, ANNULI = 16384, 2048, 256, 256
#: Vectors and queries of a tile; annuli that a query opens up to each round, then all that are left.
TILE, QUERIES, ROUNDS = 4096, 1024, (2, 18)


def centres(x: np.ndarray, k: int, steps: int = 6) -> np.ndarray:
    """k centres of the rows of x, by k-means from evenly spaced rows."""
    out = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(steps):
        own = distances(x, out).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between rows of x and rows of y."""
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows of x with one more component, which brings their squared norms to `top`."""
    return np.concatenate([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))[:, None]], axis=1)


class Annuli:
    """Pivots and, of each annulus, its pivot, radii and vectors."""

    def __init__(self, pivots: np.ndarray, top: float, cell: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray):
        self.pivots, self.top, self.cell, self.low, self.high, self.n = pivots, top, cell, low, high, n

    def opened(self, q: np.ndarray, tau: np.ndarray, first: int, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, annulus) for the annuli from place `first` up to `last` in each query's order that may hold a score of tau or more."""
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        to = distances(q, self.pivots)[:, self.cell]
        bound = np.maximum(np.maximum(to - self.high, self.low - to), 0)
        norm = (q * q).sum(1)
        with np.errstate(invalid="ignore"):
            reach = np.sqrt(np.maximum(0, self.top + norm - 2 * tau)) + 1e-6 * (1 + np.sqrt(self.top) + np.sqrt(norm))
        order = np.lexsort((to, bound), axis=1)[:, first:last]
        within = np.take_along_axis(bound, order, 1) <= reach[:, None]
        row, place = np.nonzero(within)
        return row, order[row, place]


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: exact in doubles where these hold them, else by Python's integers, held to 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    return np.clip(whole, 1 - 2**63, 2**63 - 1).astype(np.int64)


def best_of(q: np.ndarray, tau: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int):
    """(query, score, id) of up to k rows of each query with score of tau or more, equal scores by id; x are entries with their ids."""
    order = np.argsort(np.array([i[0] for i in ids]), kind="stable")
    s = scores(q, x[order])
    least = np.maximum(np.partition(s, len(x) - k, axis=1)[:, len(x) - k], tau) if len(x) > k else tau
    row, col = np.nonzero(s >= least[:, None])
    value = s[row, col]
    # The k best entries of each query hold its k best rows.
    at = np.lexsort((col, -value, row))
    row, col, value = row[at], col[at], value[at]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col, value = row[keep], order[col[keep]], value[keep]
    size = np.array([len(i) for i in ids])[col] if len(col) else np.zeros(0, np.int64)
    one = np.concatenate([ids[c] for c in col.tolist()]) if len(col) else np.zeros(0, np.int64)
    row, value = np.repeat(row, size), np.repeat(value, size)
    at = np.lexsort((one, -value, row))
    row, value, one = row[at], value[at], one[at]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], value[keep], one[keep]


def whole_vectors(rows: DataFrame, scale: int, vec_id: str, embedding: str) -> tuple[DataFrame, int, str]:
    """id, key, v, norm of the rows that take part, with the components they share and the kind of number v holds as bytes."""
    bad = F.exists("raw", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    base = rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda c: c.cast("double") * scale).alias("raw")).where(F.col("id").isNotNull() & F.col("raw").isNotNull() & ~bad)
    dims, most = base.agg(F.max(F.size("raw")), F.max(F.array_max(F.transform("raw", F.abs)))).first()
    dims, kind = max(dims or 0, 1), "<i4" if (most or 0) < 2**31 - 1 else "<f8"

    def read(batches):
        for b in batches:
            size = np.asarray(b.column(1).value_lengths()).astype(np.int64) if b.num_rows else np.zeros(0, np.int64)
            x = np.zeros((b.num_rows, dims))
            row = np.repeat(np.arange(b.num_rows), size)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(np.asarray(b.column(1).flatten()))
            raw = [r.tobytes() for r in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array((x * x).sum(1))], ["id", "v", "norm"])

    out = base.mapInArrow(read, "id long, v binary, norm double")
    if base.groupBy("id").count().where("count > 1").take(1):
        out = out.groupBy("id").agg(F.min(F.struct("v", "norm")).alias("one")).select("id", "one.*")
    return out.select("id", F.unhex(F.md5("v")).alias("key"), "v", "norm"), dims, kind


def _index(entries: DataFrame, dims: int, kind: str, width: int):
    """The entries with their annulus, and the Annuli."""
    spark = entries.sparkSession
    count, top = entries.agg(F.count("*"), F.max("norm")).first()
    sample = entries.orderBy("key").limit(SAMPLE).select("v").toPandas()["v"]  # SAMPLE vectors at most
    x = lifted(np.frombuffer(b"".join(bytes(v) for v in sample), kind).astype(np.float64).reshape(len(sample), dims), top)
    annuli = max(1, count // ANNULUS)
    cells = min(PIVOTS, int(np.ceil(np.sqrt(annuli))), len(x))
    cuts = min(ANNULI, -(-annuli // cells))
    pivots = centres(x, cells)
    held = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def placed(batches):
        for b in batches:
            y = lifted(_bytes(b.column(1), width).view(kind).reshape(b.num_rows, dims).astype(np.float64), top)
            for a in range(0, max(len(y), 1), 4096):
                d = distances(y[a : a + 4096], held.value)
                cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(d)) for c in b.columns), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["key", "v", "ids", "cell", "r"])

    rows = common.written(entries.select("key", "v", "ids").mapInArrow(placed, "key binary, v binary, ids array<long>, cell int, r double"), "topk-index")
    share = [i / cuts for i in range(1, cuts)]
    # An edge for each cut of each pivot: PIVOTS * ANNULI numbers at most.
    edges = rows.groupBy("cell").agg((F.percentile_approx("r", share, 10_000) if share else F.array().cast("array<double>")).alias("edges")).select(F.col("cell").alias("c"), "edges")
    edges = common.written(edges, "topk-edges")
    rows = rows.join(F.broadcast(edges), F.col("cell") == F.col("c")).withColumn("annulus", F.col("cell") * cuts + F.size(F.filter("edges", lambda e: e < F.col("r"))))
    found = rows.groupBy("annulus").agg(F.min("cell").alias("cell"), F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).orderBy("annulus").collect()
    at = {r["annulus"]: i for i, r in enumerate(found)}
    cols = [np.array([r[c] for r in found]) for c in ("cell", "low", "high", "n")]
    number = spark.createDataFrame([(a, i) for a, i in at.items()], "a int, number int")
    rows = rows.join(F.broadcast(number), F.col("annulus") == F.col("a")).select("key", "v", "ids", F.col("number").alias("annulus"))
    return common.written(rows, "topk-annuli"), Annuli(pivots, top, *cols)


def search(rows: DataFrame, every: int = 20, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by `every`, the k other rows of highest inner product, ties to smaller ids.

    A vector that is null or holds a null, or a component that isn't finite times
    `scale`, takes no part, nor does a row without id.  Shorter vectors, empty ones
    too, are filled up with zeros.  Rows of one id are one row, its smallest vector
    by bytes; scores beyond 64 bits are held to these.  Other columns are not read;
    no queries give no rows.
    """
    spark = rows.sparkSession
    base, dims, kind = whole_vectors(rows, scale, vec_id, embedding)
    base = common.written(base, "topk-vectors")
    width, more = dims * int(kind[2]), k + 1
    names = "query_id long, rank int, vec_id long, score long"
    asked = base.where(F.col("id") % every == 0)
    if not asked.take(1):
        return spark.createDataFrame([], names)
    # The smallest ids of each vector: cut before the shuffle too, so a vector of many rows gathers nowhere.
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    entries = base.withColumn("place", place).where(F.col("place") <= more).groupBy("key").agg(F.first("v").alias("v"), F.first("norm").alias("norm"), F.sort_array(F.collect_list("id")).alias("ids"))
    entries = common.written(entries, "topk-entries")
    index, annuli = _index(entries, dims, kind, width)
    shape = spark.sparkContext.broadcast(annuli)
    lowest = -(2**63)
    queries = common.written(asked.groupBy("key").agg(F.first("v").alias("v")).withColumn("tau", F.lit(lowest)), "topk-queries")
    best, first = None, 0
    # Queries whose bounds are held at once, and rows of a batch of copies, a few MB each.
    step, some = max(1, (1 << 20) // len(annuli.n)), max(1, (4 << 20) // width)

    def taken(b):
        q = _bytes(b.column(1), width).view(kind).reshape(b.num_rows, dims).astype(np.float64)
        return q, np.asarray(b.column(2)).astype(np.float64)

    for last in (*ROUNDS, None):

        def counted(batches, first=first, last=last):
            held = np.zeros(len(shape.value.n), np.int64)
            for b in batches:
                q, tau = taken(b)
                for a in range(0, len(q), step):
                    held += np.bincount(shape.value.opened(q[a : a + step], tau[a : a + step], first, last)[1], minlength=len(held))
            own = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(held[own])], ["annulus", "m"])

        found = queries.mapInArrow(counted, "annulus int, m long").groupBy("annulus").agg(F.sum("m").alias("m")).collect()  # an annulus each
        if not found:
            break
        asks = np.zeros(len(annuli.n), np.int64)
        asks[[r["annulus"] for r in found]] = [r["m"] for r in found]
        deal = spark.sparkContext.broadcast((-(-annuli.n // TILE), -(-asks // QUERIES)))

        def dealt(batches, first=first, last=last, deal=deal):
            """Queries, once for each tile of the annuli they open."""
            tiles, parts = deal.value
            for b in batches:
                q, tau = taken(b)
                mine = np.frombuffer(b"".join(k.as_py()[:8] for k in b.column(0)), "<u8")
                for a in range(0, len(q), step):
                    row, annulus = shape.value.opened(q[a : a + step], tau[a : a + step], first, last)
                    row = row + a
                    n = tiles[annulus]
                    tile = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    row, annulus = np.repeat(row, n), np.repeat(annulus, n)
                    part = (mine[row] % parts[annulus].astype(np.uint64)).astype(np.int32)
                    for z in range(0, len(row), some):
                        at = pa.array(row[z : z + some])
                        ends = [pa.array(c[z : z + some].astype(np.int32)) for c in (annulus, tile, part)]
                        yield pa.RecordBatch.from_arrays([*ends, *(b.column(c).take(at) for c in range(3))], ["annulus", "tile", "part", "key", "v", "tau"])

        ask = queries.select("key", "v", "tau").mapInArrow(dealt, "annulus int, tile int, part int, key binary, v binary, tau long").withColumn("ids", F.lit(None).cast("array<long>"))
        sizes = spark.createDataFrame([(i, int(n), int(p)) for i, (n, p) in enumerate(zip(*deal.value)) if p], "a int, tiles int, parts int")
        own = index.join(F.broadcast(sizes), F.col("annulus") == F.col("a")).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("annulus", "tile", "part", "key", "v", F.lit(None).cast("long").alias("tau"), "ids")
        names_ = ("annulus", "tile", "part")
        both = own.unionByName(ask).repartition(*names_).sortWithinPartitions(*names_, F.col("tau").isNotNull())

        def met(batches):
            for t in _tiles(batches, names_):
                tau = t.column("tau").combine_chunks()
                asks = ~np.asarray(tau.is_null())
                if asks.all() or not asks.any():
                    continue
                x = _bytes(t.column("v"), width).view(kind).reshape(t.num_rows, dims).astype(np.float64)
                ids = [np.array(i) for i in t.column("ids").combine_chunks().filter(pa.array(~asks)).to_pylist()]
                row, score, one = best_of(x[asks], np.asarray(tau.filter(pa.array(asks))), x[~asks], ids, more)
                keys = t.column("key").combine_chunks().filter(pa.array(asks)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, pa.array(score), pa.array(one)], ["key", "score", "id"])

        got = both.mapInArrow(met, "key binary, score long, id long")
        got = got if best is None else got.union(best)
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
        best = common.written(got.withColumn("place", place).where(F.col("place") <= more).select("key", "score", "id"), "topk-best")
        full = best.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("tau")).where(F.col("n") == more).select("key", "tau")
        if last is not None:
            queries = common.written(queries.drop("tau").join(full, "key", "left").select("key", "v", F.coalesce("tau", F.lit(lowest)).alias("tau")), "topk-queries")
        first = last
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.negative("score").alias("s"), "id", "score"))).alias("all"))
    rows = asked.select("id", "key").join(lists, "key").select("id", F.slice(F.filter("all", lambda e: e["id"] != F.col("id")), 1, k).alias("all"))
    rows = rows.select(F.col("id").alias("query_id"), F.posexplode("all").alias("p", "e"))
    return rows.select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of all embeddings for each whose id is divisible by 20."""
    return search(common.table(spark, sf_dir, "embeddings"))


#: By all pairs.
OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
