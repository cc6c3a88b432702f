"""Near-duplicate vectors by randomised-rotation binary codes.

Equal vectors are one class, compared once.  A class's unit vector is turned by
a random rotation; the signs of its coordinates are its code, and the inner
product of code and vector is stored as its correction factor.  Code against
another turned vector, rounded to eight bits, gives an unbiased estimate of the
inner product, with a bound of SIGMAS deviations and the rounding; a pair is
dropped if even the upper bound is below the threshold, and is computed exactly
in double precision otherwise.

Which pairs are looked at: tables of keys, each of some sign bits of further
rotations.  Pairs at cosine 0.9 agree in a bit with probability 0.856, and there
are as many tables as leave a chance of MISS that such a pair shares no key;
pairs at 0.95 are missed in fewer than 1 of a million cases.  Bits grow with the
logarithm of the rows over BUCKET, so a table's buckets keep their mean size.

Codes and factors are stored once.  Only they go to the buckets, where rows that
may have a partner are found; the vectors themselves are joined to these rows
alone, which meet again in their bucket for the exact computation.  A pair is
counted in the first table whose key it shares.  Buckets beyond SPLIT classes are
dealt out in pairs of parts, so no task gathers one, and no pair leaves a task:
each reduces its pairs to counts and roots, a block at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesio import U, mix, stream, text_buffers
from .components import components

#: Mean classes to a bucket, classes to a part of a split bucket, deviations of the bound, chance of missing a pair at the threshold.
BUCKET, SPLIT, SIGMAS, MISS = 256, 2048, 5.0, 0.0002
#: Pairs that are held against each other at once, and pairs computed exactly at once.
BLOCK, EXACT = 1 << 18, 1 << 14


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, alike in every process."""
    n = dims * dims
    u = (stream(2 * n, 1000 + seed) >> U(11)).astype(np.float64) / 2.0**53
    g = np.sqrt(-2 * np.log(1 - u[:n])) * np.cos(2 * np.pi * u[n:])
    q, r = np.linalg.qr(g.reshape(dims, dims))
    return q * np.sign(np.diag(r))


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for so many classes."""
    bits = min(30, max(4, round(math.log2(max(rows, 1) / BUCKET + 1))))
    share = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(8, math.ceil(math.log(MISS) / math.log1p(-min(share, 0.999999))))


_rotations: dict[tuple, np.ndarray] = {}


def _turn(dims: int, seed: int) -> np.ndarray:
    if (dims, seed) not in _rotations:
        _rotations[dims, seed] = rotation(dims, seed)
    return _rotations[dims, seed]


def keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For each row, the key of each table: sign bits of as many rotations as that takes."""
    dims, need = x.shape[1], bits * tables
    signs = np.concatenate([x @ _turn(dims, 1 + k) > 0 for k in range(-(-need // dims))], axis=1)[:, :need]
    return (signs.reshape(len(x), tables, bits) << np.arange(bits)).sum(2).astype(np.uint32)


def units(column, size: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision of rows of one length."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), int(size[0]))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Codes:
    """Codes, correction factors and rounded turned vectors of unit vectors, one row each."""

    def __init__(self, dims: int, code: np.ndarray, factor: np.ndarray, turned: np.ndarray, step: np.ndarray):
        self.dims, self.code, self.factor, self.turned, self.step = dims, code, factor, turned, step

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        dims = x.shape[1]
        y = x @ _turn(dims, 0)
        step = (np.abs(y).max(1) / 127).astype(np.float32)
        turned = np.rint(y / np.maximum(step, np.float32(1e-30))[:, None]).astype(np.int8)
        return cls(dims, np.packbits(y > 0, axis=1), (np.abs(y).sum(1) / math.sqrt(dims)).astype(np.float32), turned, step)

    def packed(self) -> np.ndarray:
        """Rows of bytes: factor, step, code, turned vector."""
        both = np.stack([self.factor, self.step], 1).view(np.uint8)
        return np.concatenate([both, self.code, self.turned.view(np.uint8)], axis=1)

    @classmethod
    def unpacked(cls, rows: np.ndarray, dims: int) -> Codes:
        both = np.ascontiguousarray(rows[:, :8]).view(np.float32)
        wide = -(-dims // 8)
        return cls(dims, rows[:, 8 : 8 + wide], both[:, 0], rows[:, 8 + wide :].view(np.int8), both[:, 1])

    def take(self, at) -> Codes:
        return Codes(self.dims, self.code[at], self.factor[at], self.turned[at], self.step[at])

    def signs(self) -> np.ndarray:
        return np.unpackbits(self.code, axis=1, count=self.dims).astype(np.float32) * 2 - 1

    def vectors(self) -> np.ndarray:
        return self.turned.astype(np.float32) * self.step[:, None]

    def upper(self, signs: np.ndarray, at: slice, other: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of rows `at` (their signs given) with other vectors and their rounding steps."""
        f, root = self.factor[at, None], math.sqrt(self.dims)
        estimate = (signs[at] @ other.T) / root / f
        bound = SIGMAS * np.sqrt(np.maximum(0, 1 - f**2)) / f / math.sqrt(max(self.dims - 1, 1))
        return estimate + bound + step[None, :] * (root / 2) / f + np.float32(1e-4)


def blocks(left: Codes, right: Codes, same: bool, threshold: float):
    """(first left row, which pairs may reach the threshold) of blocks of left rows; with `same` both sides are one, and pairs count once."""
    signs, other = left.signs(), right.vectors()
    step = max(1, BLOCK // max(1, len(other)))
    for a in range(0, len(signs), step):
        may = left.upper(signs, slice(a, a + step), other, right.step) >= threshold
        if same:
            may &= np.arange(len(other))[None, :] > np.arange(a, a + len(may))[:, None]
        yield a, may


def involved(left: Codes, right: Codes, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of either side may have a partner on the other."""
    one, two = np.zeros(len(left.factor), bool), np.zeros(len(right.factor), bool)
    for a, may in blocks(left, right, same, threshold):
        one[a : a + len(may)] = may.any(1)
        two |= may.any(0)
    return (one | two, one | two) if same else (one, two)


def links(x: np.ndarray, left: Codes, y: np.ndarray, right: Codes, same: bool, threshold: float):
    """Pairs (i, j) of unit vectors with cosine >= threshold, a block at a time."""
    for a, may in blocks(left, right, same, threshold):
        i, j = np.nonzero(may)
        i += a
        exact = np.zeros(len(i), bool)
        for k in range(0, len(i), EXACT):
            exact[k : k + EXACT] = np.einsum("ij,ij->i", x[i[k : k + EXACT]], y[j[k : k + EXACT]]) >= threshold
        if exact.any():
            yield i[exact], j[exact]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is linked to, over any number of steps."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _linked(rep, mult, x, codes, every, table, left, right, same, threshold):
    """For one pair of parts of a bucket, rows (number, links, number of the root) that have links; left and right are row numbers."""
    n = np.zeros(len(rep))
    order = np.argsort(rep, kind="stable")
    place = np.empty(len(rep), np.int64)
    place[order] = np.arange(len(rep))
    root = np.arange(len(rep))
    for i, j in links(x[left], codes.take(left), x[right], codes.take(right), same, threshold):
        i, j = left[i], right[j]
        if table:
            new = np.ones(len(i), bool)
            for t in range(table):
                new &= every[i, t] != every[j, t]
            i, j = i[new], j[new]
        n += np.bincount(i, mult[j], len(rep)) + np.bincount(j, mult[i], len(rep))
        root = _roots(len(rep), np.concatenate([np.arange(len(rep)), place[i]]), np.concatenate([root, place[j]]))
    keep = np.flatnonzero(n > 0)
    return keep, n[keep].astype(np.int64), order[root][place][keep]


def _tiles(batches, names):
    """Whole tiles, as tables of the rows that have equal values in the columns `names`, of batches sorted by these."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([np.asarray(b.column(b.schema.get_field_index(c))).astype(np.int64) for c in names], 1)
        edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
        for x, y in zip(edges[:-1], edges[1:]):
            cut = tuple(at[x].tolist())
            if held and cut != last:
                yield pa.Table.from_batches(held)
                held = []
            last = cut
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _bytes(column, width: int) -> np.ndarray:
    """A binary column of one width as rows of bytes."""
    return text_buffers(column)[0].reshape(-1, width)


def near_duplicates(rows: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each row of rows: vec_id, n_links, component_id, kept.

    Links are between rows with cosine >= threshold in double precision.  A
    vector that is null, empty, zero or holds a null or non-finite component
    links with nothing, nor do vectors of other lengths with each other; it is a
    component of its own.  A row without vec_id links with nothing and has
    neither component nor `kept`.  Rows that repeat count each; other columns
    are not read; no rows give no rows.
    """
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.coalesce(F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    base = base.withColumn("v", F.when(fine, F.col("v"))).withColumn("h", F.xxhash64("v"))
    base = common.written(base, "vectors")
    classes = base.where("v IS NOT NULL").groupBy("h", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("cid", F.monotonically_increasing_id())
    classes = common.written(classes, "vector-classes")
    bits, tables = plan(classes.count(), threshold)
    kind = "<f4" if "float" in base.schema["v"].dataType.simpleString() else "<f8"

    def coded(batches):
        for b in batches:
            v = b.column(0)
            sizes = np.asarray(v.value_lengths()).astype(np.int64) if len(v) else np.zeros(0, np.int64)
            for size in np.unique(sizes).tolist():
                for part in np.array_split(np.flatnonzero(sizes == size), -(-int((sizes == size).sum()) // 2048)):
                    own = v.take(pa.array(part))
                    x = units(own, np.array([size]))
                    k = keys(x, bits, tables)
                    bucket = mix(k.astype(U) + (np.arange(tables).astype(U) + U(size << 20)) * U(0x9E3779B97F4A7C15)).view(np.int64)
                    ends = np.arange(len(part) + 1, dtype=np.int32) * tables
                    raw = [r.tobytes() for r in np.asarray(own.flatten()).astype(kind).reshape(len(part), -1)]
                    cols = [pa.array(np.full(len(part), size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(bucket.ravel()))]
                    cols += [pa.array([r.tobytes() for r in y], pa.binary()) for y in (Codes.of(x).packed(), k)]
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(part)) for i in (1, 2, 3)), *cols, pa.array(raw, pa.binary())], ["cid", "rep", "mult", "size", "buckets", "code", "every", "raw"])

    codes = classes.select("v", "cid", "rep", "mult").mapInArrow(coded, "cid long, rep long, mult long, size int, buckets array<long>, code binary, every binary, raw binary")
    codes = common.written(codes, "vector-codes")
    spread = codes.select("cid", "size", "code", F.posexplode("buckets").alias("t", "bucket"))
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n"))
    hot = common.written(counts.where(F.col("n") > SPLIT), "vector-hot")
    whole = spread.withColumn("own", F.lit(0)).withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    if hot.take(1):
        parts = F.ceil(F.col("n") / SPLIT).cast("int")
        dealt = spread.join(hot, "bucket").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
        whole = whole.join(hot, "bucket", "left_anti").unionByName(dealt.select(whole.columns))
    tile = ["bucket", "size", "p", "q"]
    first = whole.select(*tile, "t", "own", "cid", "code").repartition("bucket", "p", "q").sortWithinPartitions(*tile, "own")

    def sides(t):
        own = np.asarray(t.column("own").combine_chunks())
        p, q, size = (t.column(c)[0].as_py() for c in ("p", "q", "size"))
        return np.flatnonzero(own == p), np.flatnonzero(own == q), p == q, size

    def met(batches):
        """The rows of each tile that may have a partner in it."""
        for t in _tiles(batches, tile):
            left, right, same, size = sides(t)
            if t.num_rows < 2 or not len(left) or not len(right):
                continue
            own = Codes.unpacked(_bytes(t.column("code"), 8 + -(-size // 8) + size), size)
            one, two = involved(own.take(left), own.take(right), same, threshold)
            at = np.union1d(left[one], right[two])
            if len(at):
                yield from t.select([*tile, "t", "own", "cid"]).take(pa.array(at)).combine_chunks().to_batches()

    found = first.mapInArrow(met, "bucket long, size int, p int, q int, t int, own int, cid long")
    found = common.written(found, "vector-met")
    exact = found.drop("size").join(codes.select("cid", "rep", "mult", "size", "code", "every", "raw"), "cid").repartition("bucket", "p", "q").sortWithinPartitions(*tile, "own")

    def compared(batches):
        held, have = [], 0
        for t in _tiles(batches, tile):
            left, right, same, size = sides(t)
            cid, rep, mult = (np.asarray(t.column(c).combine_chunks()) for c in ("cid", "rep", "mult"))
            x = _bytes(t.column("raw"), size * int(kind[2])).view(kind).astype(np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            own = Codes.unpacked(_bytes(t.column("code"), 8 + -(-size // 8) + size), size)
            every = _bytes(t.column("every"), 4 * tables).view(np.uint32)
            keep, n, root = _linked(rep, mult, x, own, every, t.column("t")[0].as_py(), left, right, same, threshold)
            if len(keep):
                held.append((cid[keep], rep[keep], n, rep[root]))
                have += len(keep)
            if have > 50_000:
                yield out(held)
                held, have = [], 0
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["cid", "rep", "n", "root"])

    linked = common.written(exact.mapInArrow(compared, "cid long, rep long, n long, root long"), "vector-links")
    common.dropped(codes, hot, found)
    n = linked.groupBy("cid").agg(F.sum("n").alias("n"))
    of = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # The ids of a class are one component by its smallest; a repeated id joins its classes.
    same = base.where("v IS NOT NULL").join(classes, ["h", "v"]).select("vec_id", "cid", "rep", "mult")
    same = common.written(same, "vector-members")
    again = same.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    if again.take(1):
        moved = same.join(again.select("vec_id"), "vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
        of = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(moved))
    found = same.join(n, "cid", "left").join(of, F.col("rep") == F.col("node"), "left")
    found = found.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    alone = base.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: links at cosine 0.9 or more, and components."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


#: By all pairs.
OP9_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS z FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.z),
c AS (SELECT id, min(z) AS component_id FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON id = vec_id
"""
