"""Minimax contiguous partition of ordered atomic groups into shards.

Rows of equal text are one group, so copies never part.  Groups stand in the
order of their text's digest.  A binary search over the shard capacity checks
each candidate greedily: a shard takes groups while they fit.  The smallest
capacity that needs no more than the wanted shards is the bound; the cuts are
then placed under that bound, each as near as possible to an even share of what
is left, so one huge group doesn't leave other shards empty.

A greedy step needs the last group whose running total stays within a bound.
The driver holds totals of blocks of groups only (blocks of up to BLOCK groups,
joined across partitions where these are short) and reads the single block that a
step ends in, keeping a few; so the check is exact and driver memory stays bounded.  Cuts are digests: rows find their shard
by comparing, without a join.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Groups to a block; blocks that the driver keeps.
BLOCK, KEPT_BLOCKS = 1 << 16, 48


class Ordered:
    """Running totals over group sizes that stand in blocks; `load(b)` reads the sizes of block b."""

    def __init__(self, totals, load):
        self.ends = np.cumsum(np.asarray(totals, np.int64))
        self.total = int(self.ends[-1]) if len(self.ends) else 0
        self.load, self.kept = load, OrderedDict()

    def block(self, b: int) -> np.ndarray:
        """Totals up to and with each group of block b."""
        if b not in self.kept:
            before = int(self.ends[b - 1]) if b else 0
            self.kept[b] = before + np.cumsum(np.asarray(self.load(b), np.int64))
            if len(self.kept) > KEPT_BLOCKS:
                self.kept.popitem(last=False)
        self.kept.move_to_end(b)
        return self.kept[b]

    def floor(self, bound: int) -> int:
        """The largest running total (0 included) that isn't over bound."""
        if bound >= self.total:
            return self.total
        b = int(np.searchsorted(self.ends, bound, "right"))
        before = int(self.ends[b - 1]) if b else 0
        sums = self.block(b)
        i = int(np.searchsorted(sums, bound, "right"))
        return int(sums[i - 1]) if i else before

    def ceil(self, bound: int) -> int:
        """The smallest running total that isn't under bound."""
        if bound <= 0:
            return 0
        if bound >= self.total:
            return self.total
        b = int(np.searchsorted(self.ends, bound, "left"))
        sums = self.block(b)
        return int(sums[np.searchsorted(sums, bound, "left")])


def needed(sizes: Ordered, capacity: int, most: int) -> int:
    """Shards that a greedy pass needs at this capacity; most + 1 if more than most."""
    at, count = 0, 0
    while at < sizes.total and count <= most:
        at = sizes.floor(at + capacity)
        count += 1
    return count


def minimax(sizes: Ordered, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which `shards` contiguous shards hold all groups, and the running total at each cut."""
    low = max(-(-sizes.total // shards), largest)
    high = -(-sizes.total // shards) + largest  # a greedy shard but the last leaves less than `largest` free
    while low < high:
        mid = (low + high) // 2
        if needed(sizes, mid, shards) <= shards:
            high = mid
        else:
            low = mid + 1
    # From the right: the earliest place from which the last k shards can hold the rest.
    earliest = [sizes.total]
    for _ in range(shards - 1):
        earliest.append(sizes.ceil(earliest[-1] - low))
    cuts, at = [], 0
    for k in range(shards - 1):
        left = shards - k
        want = at + (sizes.total - at) / left
        under, over = sizes.floor(int(want)), sizes.ceil(int(-(-want // 1)))
        cut = under if want - under <= over - want else over
        at = min(max(cut, earliest[left - 1], at), sizes.floor(at + low))
        cuts.append(at)
    return low, cuts


def joined(blocks: list[dict], most: int = BLOCK) -> list[dict]:
    """Neighbouring blocks joined while they hold no more than `most` groups, so short partitions don't cost a read each."""
    out: list[dict] = []
    for b in blocks:
        if out and out[-1]["n"] + b["n"] <= most:
            a = out[-1]
            out[-1] = {"bytes": a["bytes"] + b["bytes"], "most": max(a["most"], b["most"]), "first": a["first"], "last": b["last"], "n": a["n"] + b["n"]}
        else:
            out.append(b)
    return out


def assign(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, digest, shard for each row of docs.

    Size is the text's UTF-8 bytes plus 8.  Null texts are empty and share a
    group with empty ones; rows of one doc_id are rows of their own; more shards
    than groups leave shards empty; other columns are not read.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"))
    rows = common.written(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    ordered = groups.repartitionByRange(common.partitions_for(docs, 1), "digest").sortWithinPartitions("digest").withColumn("rid", F.monotonically_increasing_id())
    ordered = common.written(ordered, "shard-groups")
    block = F.expr(f"shiftright(rid, 33) * {1 << 20} + (rid & {(1 << 33) - 1}) div {BLOCK}")
    blocks = ordered.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"), F.min("rid").alias("first"), F.max("rid").alias("last"), F.count("*").alias("n"))
    blocks = joined([b.asDict() for b in blocks.orderBy("block").collect()])

    def read(b: int, *cols: str):
        return ordered.where(F.col("rid").between(blocks[b]["first"], blocks[b]["last"])).select(*cols).toPandas().sort_values("rid")

    sizes = Ordered([b["bytes"] for b in blocks], lambda b: read(b, "rid", "bytes")["bytes"].to_numpy())
    _, cuts = minimax(sizes, max((b["most"] for b in blocks), default=0), shards)
    # The first digest of each shard after a cut; a cut at the very end has none.
    firsts, kept = [], {}
    for cut in cuts:
        if cut >= sizes.total:
            continue
        b = int(np.searchsorted(sizes.ends, cut, "right"))
        if b not in kept:
            kept[b] = (read(b, "rid", "digest")["digest"], sizes.block(b))
        digest, sums = kept[b]
        before = int(sizes.ends[b - 1]) if b else 0
        i = 0 if cut == before else int(np.searchsorted(sums, cut, "right"))
        firsts.append(bytes(digest.iloc[i]).hex())
    shard = F.lit(0)
    for x in firsts:
        shard = shard + (F.col("digest") >= F.unhex(F.lit(x))).cast("int")
    return rows.withColumn("shard", shard.cast("int"))


def slotted(rows: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """Adds slot: the place of each row in its shard, gapless from 0, by a range sort instead of one window for each shard."""
    sort = rows.repartitionByRange(partitions, "shard", *order).sortWithinPartitions("shard", *order)
    sort = common.written(sort.withColumn("rid", F.monotonically_increasing_id()), "shard-slots")
    part = F.shiftright("rid", 33)
    # One row for each partition and shard in it.
    sums = sort.groupBy("shard", part.alias("part")).agg(F.min("rid").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("shard").alias("s"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("base"))
    return sort.join(base, (sort["shard"] == base["s"]) & (part == base["p"])).withColumn("slot", F.col("rid") + F.col("base")).drop("s", "p", "base", "rid")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; copies share a shard."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = slotted(assign(docs, 24), ["doc_id", "text_crc32"], common.partitions_for(docs, 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
