"""Token-ID binary output: texts to ids to Simple-8b files, and back.

A file is a run of blocks, all numbers little-endian and of 64 bits:

    head   MAGIC, shard, block, documents, ids, words, parts
    parts  for each part of PART ids: the place of its first word   (vectorised or random decoding)
    docs   doc_id of each document; 1 where it is null; its count of ids
    words  Simple-8b, each part coded on its own
    tail   TAIL, eight bytes, written by Spark's text writer as its line end

Spark's own writer and committer write the files (a lost executor's task is run
again, and half-written files are never seen) and its binaryFile source reads
them, so any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, simple8b
from .tok import encoder

U = np.uint64
MAGIC = U(0x31304B4C42385351)
TAIL = "\nS8BEND\n"
HEAD = 7
#: Ids that are coded together.
PART = 16384
#: A block closes once it holds as many ids.
BLOCK_IDS = 1 << 18


def pack_block(shard: int, block: int, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block without its tail."""
    words, at, used = [], [], 0
    for a in range(0, len(ids), PART):
        w = simple8b.encode(ids[a : a + PART])
        at.append(used)
        used += len(w)
        words.append(w)
    head = np.array([MAGIC, shard, block, len(doc_ids), len(ids), used, len(at)], U)
    return b"".join(x.tobytes() for x in (head, np.array(at, U), doc_ids.astype("<i8"), nulls.astype(U), counts.astype(U), *words))


def blocks_of(content) -> list[tuple]:
    """(shard, block, doc_ids, nulls, counts, ids) of each block of a file's bytes."""
    data, at, out = np.frombuffer(content, np.uint8), 0, []
    while at < len(data):
        magic, shard, block, docs, n, words, parts = data[at : at + 8 * HEAD].view(U).tolist()
        if magic != int(MAGIC):
            raise ValueError("not a block of a token file")
        body = data[at + 8 * HEAD : at + 8 * (HEAD + parts + 3 * docs + words)].view(U)
        doc_ids, nulls, counts = body[parts : parts + 3 * docs].reshape(3, docs)
        ids = simple8b.decode(body[parts + 3 * docs :])
        if len(ids) != n or int(counts.sum()) != n:
            raise ValueError("a block does not hold the ids it names")
        out.append((shard, block, doc_ids.view(np.int64), nulls.astype(bool), counts.astype(np.int64), ids))
        at += 8 * (HEAD + parts + 3 * docs + words) + len(TAIL)
    return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = 1) -> None:
    """Writes the ids of docs(doc_id, text) to files under path, in ascending doc_id order over shards.

    Null texts are empty; a null doc_id sorts first; rows of one doc_id stay side
    by side, in text order.  Other columns are not read.  No row: no block.
    """
    n = common.partitions_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def coded(batches):
        enc, shard, block = encoder(tokenizer, end), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        have = 0

        def out():
            nonlocal held, have, block
            ids, nulls, counts, values = (np.concatenate(x) for x in zip(*held))
            row = pack_block(shard, block, ids, nulls, counts, values)
            held, have, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["value"])

        for b in batches:
            doc, text = b.column(0), b.column(1)
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).tolist() if len(text) else []
            for x, y in common.slices(len(text), sizes, 1 << 20):
                values, counts = enc.encode(text.slice(x, y - x))
                d = doc.slice(x, y - x)
                held.append((np.asarray(d.fill_null(0)), np.asarray(d.is_null()), counts, values))
                have += len(values)
                if have >= BLOCK_IDS:
                    yield out()
        if held:
            yield out()

    files = rows.mapInArrow(coded, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", TAIL).text(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, shard, at (ids of the shard before it), n_tokens, ids_crc32; with_ids adds ids."""
    schema = "doc_id long, shard long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def decoded(batches):
        for b in batches:
            for content in b.column(0):
                at = 0
                for shard, _, doc_ids, nulls, counts, ids in blocks_of(content.as_buffer()):
                    ids = ids.astype("<u4")
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(starts.tolist(), ends.tolist())]
                    cols = [pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(np.full(len(counts), shard), pa.int64()), pa.array(at + starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, names)
                    at += int(ends[-1]) if len(ends) else 0

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(decoded, schema)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """read() with `start`: the ids of all documents before each, over all shards in order."""
    rows = common.written(read(spark, path), "token-docs")
    # One row a shard: as many as files were written.
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to Simple-8b files and back; one row for each document, from the files."""
    path = common.scratch_path(spark, "token-files")
    write(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return documents_of(spark, path)
