"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of a benchmark's items.  A shift table over blocks of
two words tells how far a search may skip; where it allows no skip, the bucket
of patterns with that last block is compared word by word, and then byte by
byte.  All stretches of a text skip at the same time, in numpy.

The patterns are broadcast as a chunk of CHUNK_BYTES of item text at most (or one
item).  A larger benchmark is searched for chunk by chunk, each in a pass over the
texts that leaves the places it hits in a scratch table; so neither the driver nor
a worker ever holds more than one chunk, and its tables are built once a pass.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesio import LOWER, U, WORD, mix, prefix_sums, run_hashes, runs, text_buffers

#: Item text that is searched for at once.
CHUNK_BYTES = 16 << 20
TABLE_BITS = 18


def words_of(data: np.ndarray, rows: np.ndarray):
    """Lower-cased bytes, starts and ends of words, first word of each row (one more at the end) and word hashes."""
    low = LOWER[data]
    starts, ends, at = runs(WORD[low], rows)
    return low, starts, ends, at, run_hashes(prefix_sums(low), starts, ends)


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word with the one before it; the first stands alone."""
    out = np.zeros(len(hashes), U)
    out[1:] = mix(hashes[:-1] * U(0x9E3779B97F4A7C15) + hashes[1:])
    return out


class Searcher:
    """Wu-Manber search for patterns of one length in words."""

    def __init__(self, patterns: list[tuple[bytes, ...]], owners: list[set[int]], hashes: np.ndarray):
        self.m = m = hashes.shape[1]
        self.block = min(2, m)
        blocks = hashes if self.block == 1 else mix(hashes[:, :-1] * U(0x9E3779B97F4A7C15) + hashes[:, 1:])
        self.skip = m - self.block + 1
        self.mask = U((1 << TABLE_BITS) - 1)
        self.shift = np.full(1 << TABLE_BITS, self.skip, np.int8)
        for j in range(blocks.shape[1]):
            slot = (blocks[:, j] & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slot, np.int8(blocks.shape[1] - 1 - j))
        order = np.argsort(blocks[:, -1], kind="stable")
        self.patterns = [patterns[i] for i in order]
        self.owners = [owners[i] for i in order]
        self.hashes = hashes[order]
        self.keys, self.first, self.count = np.unique(blocks[order, -1], return_index=True, return_counts=True)

    def candidates(self, blocks: np.ndarray) -> np.ndarray:
        """Ends of places where no skip is allowed."""
        n, found = len(blocks), []
        at = np.arange(self.m - 1, n, self.skip)
        limit = np.minimum(at + self.skip, n)
        while len(at):
            shift = self.shift[(blocks[at] & self.mask).astype(np.int64)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < limit
            at, limit = at[on], limit[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, low, starts, ends, row_first, hashes, pairs):
        """(end word, pattern) of each occurrence; none crosses rows."""
        blocks = hashes if self.block == 1 else pairs
        at = self.candidates(blocks)
        slot = np.searchsorted(self.keys, blocks[at])
        ok = slot < len(self.keys)
        ok[ok] = self.keys[slot[ok]] == blocks[at[ok]]
        at, slot = at[ok], slot[ok]
        inside = at - self.m + 1 >= row_first[at]
        at, slot = at[inside], slot[inside]
        got_at, got_p = [], []
        k = 0
        while len(at):
            p = self.first[slot] + k
            same = (hashes[at[:, None] + np.arange(1 - self.m, 1)] == self.hashes[p]).all(1)
            got_at.append(at[same])
            got_p.append(p[same])
            k += 1
            more = self.count[slot] > k
            at, slot = at[more], slot[more]
        if not got_at:
            return []
        out = []
        for e, p in zip(np.concatenate(got_at).tolist(), np.concatenate(got_p).tolist()):
            words = self.patterns[p]
            if all(low[starts[i] : ends[i]].tobytes() == w for i, w in zip(range(e - self.m + 1, e + 1), words)):
                out.append((e, p))
        return out


class Patterns:
    """All windows of some items, one searcher for each length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        column = pa.array([x for _, x in items], pa.string())
        self.names = [i for i, _ in items]
        low, starts, ends, at, hashes = words_of(*text_buffers(column))
        words = [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        by: dict[tuple[bytes, ...], tuple[set[int], int]] = {}
        for i in range(len(items)):
            a, b = int(at[i]), int(at[i + 1])
            size = min(window, b - a)
            for j in range(a, b - size + 1 if size else a):
                by.setdefault(tuple(words[j : j + size]), (set(), j))[0].add(i)
        self.searchers = []
        for m in sorted({len(k) for k in by}):
            own = [(k, *v) for k, v in by.items() if len(k) == m]
            first = np.array([j for _, _, j in own])
            self.searchers.append(Searcher([k for k, _, _ in own], [o for _, o, _ in own], hashes[first[:, None] + np.arange(m)]))

    def find(self, data: np.ndarray, rows: np.ndarray):
        """Words of each row, which words are hit, and the (row, item name) pairs."""
        low, starts, ends, at, hashes = words_of(data, rows)
        row_of = np.repeat(np.arange(len(rows) - 1), np.diff(at))
        first = at[row_of]
        pairs = pairs_of(hashes)
        mark = np.zeros(len(starts) + 1, np.int32)
        items = set()
        for s in self.searchers:
            for e, p in s.search(low, starts, ends, first, hashes, pairs):
                mark[e - s.m + 1] += 1
                mark[e + 1] -= 1
                items.update((int(row_of[e]), self.names[i]) for i in s.owners[p])
        return np.diff(at), np.cumsum(mark[:-1]) > 0, at, items


def chunks(benchmark: DataFrame):
    """Lists of (item id as text, text), each of CHUNK_BYTES at most or one item; the driver holds one at a time."""
    held, size = [], 0
    text = F.col("text").cast("string")
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), text.alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n")).toLocalIterator():
        if held and size + r["n"] > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += r["n"]
    if held:
        yield held


_built: dict[tuple, Patterns] = {}


def _patterns(part, key: tuple) -> Patterns:
    """The patterns of a broadcast chunk, built once in a worker and kept until another chunk comes; a key is the search and the window."""
    if key not in _built:
        _built.clear()
        _built[key] = Patterns(part.value, key[-1])
    return _built[key]


def _slices(text):
    """(start, end, bytes, row starts) of slices of a text column of about a megabyte."""
    sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).tolist() if len(text) else []
    for x, y in common.slices(len(text), sizes, 1 << 20):
        yield x, y, *text_buffers(text.slice(x, y - x))


def _judged(n, n_hit, items: list[list[str]]) -> list:
    """The result columns of rows from their words, hit words and items."""
    sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
    return [pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(n_hit, np.int64)), pa.array([len(i) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array(np.asarray(n_hit) > 0)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Columns of docs with n_words, n_hit, n_items, items_sha256 and contaminated for each row.

    A word is hit if it lies in an occurrence of a window of an item: `window`
    consecutive words, or all of an item that has fewer.  Texts and items that
    are null or have no words hit nothing; an item id that is null counts as the
    empty string; rows that repeat are judged each for itself; an empty
    benchmark leaves all clean.  Columns of docs with a result's name are
    replaced.
    """
    spark = docs.sparkSession
    added = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    names = [x.split()[0] for x in added.split(", ")]
    docs = docs.drop(*names)
    parts = chunks(benchmark)
    one, two = next(parts, []), next(parts, None)
    if two is not None:
        return _by_chunks(docs, [one, two], parts, window, names, added)
    held, key = spark.sparkContext.broadcast(one), (uuid.uuid4().hex, window)  # CHUNK_BYTES at most, or one item
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for x, y, data, rows in _slices(b.column(column).cast(pa.string())):
                n, hit, at, found = _patterns(held, key).find(data, rows)
                sums = np.concatenate([[0], np.cumsum(hit)])
                items: list[list[str]] = [[] for _ in range(y - x)]
                for r, i in found:
                    items[r].append(i)
                rest = b.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*rest.columns, *_judged(n, sums[at[1:]] - sums[at[:-1]], items)], [*rest.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + added
    return docs.mapInArrow(run, schema)


def _by_chunks(docs: DataFrame, first: list, rest, window: int, names: list[str], added: str) -> DataFrame:
    """contamination() for a benchmark of several chunks: a pass for each, then the union of the places they hit."""
    spark = docs.sparkSession
    docs = common.written(docs.drop("_row").withColumn("_row", F.monotonically_increasing_id()), "leak-docs")
    found = None
    for part in itertools.chain(first, rest):
        held = spark.sparkContext.broadcast(part)

        def run(batches, held=held, key=(uuid.uuid4().hex, window)):
            for b in batches:
                for x, y, data, rows in _slices(b.column(1)):
                    _, hit, at, pairs = _patterns(held, key).find(data, rows)
                    items: dict[int, list[str]] = {}
                    for r, i in pairs:
                        items.setdefault(r, []).append(i)
                    own = sorted(items)
                    places = [np.flatnonzero(hit[at[r] : at[r + 1]]) for r in own]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x).take(pa.array(own, pa.int64())), pa.array(places, pa.list_(pa.int64())), pa.array([items[r] for r in own], pa.list_(pa.string()))], ["_row", "places", "items"])

        one = docs.select("_row", F.col("text").cast("string").alias("text")).mapInArrow(run, "_row long, places array<long>, items array<string>")
        one = common.written(one, "leak-places")
        found = one if found is None else found.union(one)
        held.destroy()
    found = found.groupBy("_row").agg(F.flatten(F.collect_list("places")).alias("_places"), F.flatten(F.collect_list("items")).alias("_items"))
    both = docs.join(found, "_row", "left").select(*[c for c in docs.columns if c != "_row"], "_places", "_items")
    column, wide = both.columns.index("text"), len(both.columns) - 2

    def judged(batches):
        for b in batches:
            for x, y, data, rows in _slices(b.column(column).cast(pa.string())):
                _, _, _, at, _ = words_of(data, rows)
                own = b.slice(x, y - x)
                hits = [len(set(p)) if p else 0 for p in own.column(wide).to_pylist()]
                items = [sorted(set(i)) if i else [] for i in own.column(wide + 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns[:wide], *_judged(np.diff(at), hits, items)], [*own.schema.names[:wide], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields[:wide]) + ", " + added
    return both.mapInArrow(judged, schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched for windows of ten words of all benchmark items."""
    return contamination(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark")).drop("text")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
o AS (SELECT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM o) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
