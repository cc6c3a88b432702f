"""Packing along a space-filling curve.

Each document's ids are hashed into a signed count vector, projected to a few
dimensions and placed on a Hilbert curve; documents are range-sorted by that key
and laid end to end, so neighbours along the curve share sequences.  Sequences
are cut every `length` ids: only the very last one of a corpus is not full.

The order is settled on a table of keys and counts alone.  What the driver
holds is one key and one sum for each of a bounded number of ranges; ids are
shuffled once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesio import U, mix, stream
from .tok import encoder

#: Width of the hashed vector, dimensions of the curve and bits of each.
WIDTH, DIMS, BITS = 256, 4, 11
#: Low bits of a key that spread equal vectors (copies), by doc_id.
SPREAD = 19
#: Most ranges that the driver knows of.
MOST_RANGES = 8192


def vectors(ids: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Unit vectors of signed hashed id counts, damped by the square root; a text without ids is zero."""
    rows = len(counts)
    # One slot and sign for each id value that occurs here.
    table = stream(int(ids.max()) + 1 if len(ids) else 1, 77)
    slot = (table % U(width)).astype(np.int32)
    sign = np.where(table >> U(63), 1.0, -1.0).astype(np.float32)
    place = np.repeat(np.arange(rows, dtype=np.int64) * width, counts) + slot[ids]
    x = np.bincount(place, weights=sign[ids], minlength=rows * width).reshape(rows, width)
    x = np.sign(x) * np.sqrt(np.abs(x))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def projection(width: int = WIDTH, dims: int = DIMS) -> np.ndarray:
    """Orthonormal random directions, from a fixed seed."""
    u = (stream(2 * width * dims, 99) >> U(11)).astype(np.float64) / 2.0**53
    u1, u2 = u.reshape(2, width, dims)
    q, _ = np.linalg.qr(np.sqrt(-2 * np.log(1 - u1)) * np.cos(2 * np.pi * u2))
    return q


def cells(x: np.ndarray, directions: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Grid cells of vectors: coordinates go through a normal curve, so cells fill evenly for spread-out vectors."""
    z = (x @ directions) * np.sqrt(len(directions))
    # logistic approximation of the normal distribution function
    share = 1 / (1 + np.exp(-1.702 * z))
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each grid cell along the Hilbert curve through bits*dims space, after Skilling's transform, for all rows at once."""
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """doc_id, key (curve and spread), n_tokens, wide, ids as little-endian bytes of 2 (or, for vocabularies over 65,536, 4) each."""

    def run(batches):
        enc, directions = encoder(tokenizer, end), projection()
        kind = "<u2" if max(enc.size, end + 1) <= 1 << 16 else "<u4"
        for b in batches:
            doc, text = b.column(0), b.column(1)
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).tolist() if len(text) else []
            for x, y in common.slices(len(text), sizes, 1 << 20):
                ids, counts = enc.encode(text.slice(x, y - x))
                key = hilbert(cells(vectors(ids, counts), directions))
                own = np.asarray(doc.slice(x, y - x).fill_null(0)).astype(np.int64)
                key = (key << SPREAD) | (mix(own.view(U)) >> U(64 - SPREAD)).astype(np.int64)
                size = np.dtype(kind).itemsize
                at = np.concatenate([[0], np.cumsum(counts) * size]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([doc.slice(x, y - x), pa.array(key), pa.array(counts.astype(np.int64)), pa.array(np.full(len(counts), size, np.int32)), data], ["doc_id", "key", "n_tokens", "wide", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n_tokens long, wide int, ids binary")


def pack(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs docs(doc_id, text) into sequences of `length` ids; one row for each piece.

    A piece is the longest run of a document's ids inside one sequence: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the
    ids.  Null and empty texts are the end id alone; rows of one doc_id are
    packed each for itself; other columns are not read; no rows, no pieces.
    """
    spark = docs.sparkSession
    base = common.written(tokenised(docs, tokenizer, end), "packed-ids")
    ranges = min(MOST_RANGES, 4 * common.partitions_for(docs))
    cut = sorted(set(base.stat.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    cut_keys = spark.sparkContext.broadcast(np.array(cut, np.float64))  # at most MOST_RANGES numbers

    def ranged(batches):
        for b in batches:
            key = b.column(b.schema.get_field_index("key"))
            at = np.searchsorted(cut_keys.value, np.asarray(key).astype(np.float64), "right")
            yield b.append_column("range", pa.array(at.astype(np.int32)))

    fields = "doc_id long, key long, n_tokens long"
    sums = base.select("doc_id", "key", "n_tokens").mapInArrow(ranged, f"{fields}, range int").groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()
    totals = np.zeros(len(cut) + 2, np.int64)
    for r in sums:  # at most MOST_RANGES rows
        totals[r["range"] + 1] = r["n"]
    starts = spark.sparkContext.broadcast(np.cumsum(totals))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in out.split(", ")]

    def pieces(batches):
        at, last = 0, None
        for b in batches:
            doc, n, wide, ids, where = (b.column(b.schema.get_field_index(x)) for x in ("doc_id", "n_tokens", "wide", "ids", "range"))
            n, wide, where = (np.asarray(x).astype(np.int64) for x in (n, wide, where))
            rows, got = [], []
            for i in range(len(n)):
                if where[i] != last:
                    last, at = where[i], int(starts.value[where[i]])
                values = np.frombuffer(ids[i].as_buffer(), f"<u{wide[i]}").astype("<u4")
                done, count = 0, int(n[i])
                while done < count:
                    offset = at % length
                    take = min(length - offset, count - done)
                    piece = values[done : done + take]
                    rows.append((i, done, take, zlib.crc32(piece), count, at // length, offset))
                    if with_ids:
                        got.append(piece)
                    done, at = done + take, at + take
            if rows:
                table = np.array(rows, np.int64)
                cols = [doc.take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in range(1, 7))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(table[:, 2])]).astype(np.int32), pa.array(np.concatenate(got).astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names)

    dealt = base.mapInArrow(ranged, f"{fields}, wide int, ids binary, range int")
    dealt = dealt.repartition(common.partitions_for(docs), "range").sortWithinPartitions("range", "key", "doc_id", "n_tokens", "ids")
    return dealt.mapInArrow(pieces, out)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed to 2048 ids along the curve; one row for each piece."""
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
