"""Exact repeated-substring removal over all documents.

A byte goes if a string of `size` bytes that covers it also starts anywhere
else.  Positions are sampled first: in each window of `size` bytes the smallest
of its GRAM-byte hashes is its anchor, so equal windows have equal anchors at
equal places, and one anchor stands for a run of windows.  Anchors meet by hash:

* anchors whose whole contexts (all bytes of their windows) are equal settle all
  their windows without a look at the bytes;
* an anchor that no other shares settles them too;
* only contexts that share an anchor but differ are held against each other, one
  context for each distinct one: the contexts of some anchors make a shard, whose
  suffixes and common prefixes are sorted by induction (`induced`), and a window
  repeats if it shares `size` bytes with a neighbour.

Equal windows have one anchor, so they meet in one shard, however many shards a
corpus makes.  So no pairs are made, equal groups are counted before the shuffle,
and an anchor with more than HOT contexts is dealt out by window instead of
gathered.  Hashes are of 64 bits, two of them for each decision.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, induced
from .bytesio import U, mix, prefix_sums, run_hashes, runs, text_buffers

GRAM, PIECE, HOT = 32, 1 << 20, 50_000
#: Bytes of a shard that is sorted by induction (it takes some 150 times as much memory); the contexts of one anchor that are more are compared by the hashes of their windows.
SORTED = 2 << 20
#: ASCII white space, which cuts words.
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, U)
    full[:n] = x
    full = full.reshape(blocks, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(right[:m], left[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first and last window start (in the row), anchor hash and context hash,
    how many runs of equal contexts follow each other, and the window starts of those after the first.

    Among equal hashes in a window the last one is the anchor, so a text of one period has a run for each; they make one row.
    """
    gram = min(GRAM, max(1, size // 2))
    empty = np.zeros(0, np.int64)
    lengths = np.diff(rows)
    live = np.flatnonzero(lengths >= size)
    if not len(live):
        return empty, empty, empty, empty, empty, empty, empty
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    h = run_hashes(sums, at, at + gram)
    low = U(PIECE * 4 - 1)
    best = sliding_min((h & ~low) | (low - at.astype(U)), size - gram + 1)
    count = lengths[live] - size + 1
    ends = np.cumsum(count)
    row = np.repeat(live, count)
    s = np.arange(ends[-1]) - np.repeat(ends - count, count) + rows[row]
    p = (low - (best[s] & low)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    p, lo, hi, row = p[first], s[first], s[last], row[first]
    g = mix(run_hashes(sums, lo, hi + size) + (p - lo).astype(U))
    f = h[p]
    new = np.ones(len(p), bool)
    new[1:] = (row[1:] != row[:-1]) | (f[1:] != f[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(p))
    row, more = row[first], hi[end - 1] - hi[first]
    return row, lo[first] - rows[row], hi[first] - rows[row], f[first].view(np.int64), g[first].view(np.int64), end - first, more


def anchored(text, size: int):
    """anchors() over a text column, in pieces of bounded size; a long text is cut, with windows whole."""
    data, rows = text_buffers(text)
    a = 0
    while a < len(rows) - 1:
        b = max(a + 1, int(np.searchsorted(rows, rows[a] + PIECE, "right")) - 1)
        if rows[b] - rows[a] <= 2 * PIECE:
            row, *found = anchors(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a], size)
            yield row + a, *found
        else:
            for x in range(int(rows[a]), int(rows[b]) - size + 1, PIECE):
                part = data[x : min(x + PIECE + size - 1, int(rows[b]))]
                _, lo, hi, *found = anchors(part, np.array([0, len(part)]), size)
                shift = x - int(rows[a])
                yield np.full(len(lo), a), lo + shift, hi + shift, *found
        a = b


def covered(n: int, lo, hi, size: int) -> np.ndarray:
    """Which of n bytes lie in windows that start in lo..hi."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.asarray(lo, np.int64), 1)
    np.add.at(mark, np.minimum(np.asarray(hi, np.int64) + size, n), -1)
    return np.cumsum(mark[:n]) > 0


def intervals(docs: DataFrame, size: int) -> DataFrame:
    """row and at, a list of (lo, hi): starts lo..hi of windows of `size` bytes that repeat, of docs(row, text)."""
    def anchor_rows(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            for row, lo, hi, f, g, k, more in anchored(b.column(1), size):
                lo, hi, k, more = (pa.array(x.astype(np.int32)) for x in (lo, hi, k, more))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), lo, hi, pa.array(f), pa.array(g), k, more], ["row", "lo", "hi", "f", "g", "k", "more"])

    found = common.written(docs.mapInArrow(anchor_rows, "row long, lo int, hi int, f long, g long, k int, more int"), "anchors")
    one = F.min(F.struct("row", "lo", "hi")).alias("one")
    contexts = common.written(found.groupBy("f", "g").agg(F.sum("k").alias("n"), one), "anchor-contexts")
    shared = contexts.groupBy("f").agg(F.count("*").alias("m")).where("m > 1")
    ends = found.select("f", "g", "row", "lo", (F.col("hi") + F.col("more")).alias("hi"))
    equal = ends.join(contexts.where("n > 1").select("f", "g"), ["f", "g"]).select("row", "lo", "hi")
    fine = contexts.join(shared, "f").select("f", "m", "n", "one.row", "one.lo", "one.hi")
    fine = common.written(fine, "anchor-fine")
    wanted = fine.groupBy("row").agg(F.collect_list(F.struct("f", "n", "lo", "hi", "m")).alias("want"))
    texts = docs.join(wanted, "row")
    hot = bool(fine.where(F.col("m") > HOT).take(1))

    def cut_out(batches):
        names = ["f", "row", "lo", "n", "m", "context"]
        for b in batches:
            ids, want = b.column(0), b.column(2)
            data, rows = text_buffers(b.column(1))
            counts = np.asarray(want.value_lengths()).astype(np.int64)
            flat = want.flatten()
            f, n, lo, hi, m = (np.asarray(flat.field(i)) for i in range(5))
            row = np.repeat(np.arange(len(ids)), counts)
            start, stop = rows[row] + lo, rows[row] + hi + size
            for x in range(0, len(row), 4096):
                y = min(x + 4096, len(row))
                raw = [data[s:e].tobytes() for s, e in zip(start[x:y].tolist(), stop[x:y].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f[x:y]), ids.take(pa.array(row[x:y])), pa.array(lo[x:y].astype(np.int32)), pa.array(n[x:y].astype(np.int64)), pa.array(m[x:y].astype(np.int64)), pa.array(raw, pa.binary())], names)

    cut = texts.select("row", "text", "want").mapInArrow(cut_out, "f long, row long, lo int, n long, m long, context binary")
    if hot:
        cut = common.written(cut.dropDuplicates(["f", "row", "lo"]), "anchor-cuts")

    def windows(column):
        """Hash of each window of each context, its context, and its place in it."""
        data, rows = text_buffers(column)
        count = np.diff(rows) - size + 1
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = rows[row] + place
        return run_hashes(prefix_sums(data), at, at + size), row, place

    def runs_of(row, place, ids, lo):
        """Windows in order as rows (id, first start, last start)."""
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        own = row[first]
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array((lo[own] + place[first]).astype(np.int32)), pa.array((lo[own] + place[last]).astype(np.int32))], ["row", "lo", "hi"])

    def compared(batches):
        """Windows that two contexts of an anchor hold; the last anchor of a batch waits for the next."""
        def out(t):
            column = t.column("context").combine_chunks()
            f, ids, lo, n = (np.asarray(t.column(c).combine_chunks()) for c in ("f", "row", "lo", "n"))
            data, rows = text_buffers(column)
            for x, y in groups(f, np.diff(rows)):
                if rows[y] - rows[x] <= SORTED:
                    starts = induced.repeated_starts([data[a:b].tobytes() for a, b in zip(rows[x:y], rows[x + 1 : y + 1])], size)
                    row, place = np.repeat(np.arange(y - x), [len(p) for p in starts]), np.concatenate(starts)
                else:
                    h, row, place = windows(column.slice(x, y - x))
                    key = mix(h + f[x:y].view(U)[row] * U(0x9E3779B97F4A7C15))
                    order = np.argsort(key, kind="stable")
                    same = np.append(False, key[order[1:]] == key[order[:-1]])
                    hit = order[same | np.append(same[1:], False)]
                    hit.sort()
                    row, place = row[hit], place[hit]
                own = n[x:y][row] == 1  # others are settled
                if own.any():
                    yield runs_of(row[own], place[own], ids[x:y], lo[x:y])

        def groups(f, sizes):
            """Slices of whole anchors of about PIECE bytes."""
            edge = np.append(np.flatnonzero(np.append(True, f[1:] != f[:-1])), len(f))
            total = np.append(0, np.cumsum(sizes))
            x = 0
            for e, after in zip(edge[1:], [*edge[2:], None]):
                if after is None or total[after] - total[x] > PIECE:
                    yield x, int(e)
                    x = int(e)

        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if kept is None else pa.concat_tables([kept, t])
            f = np.asarray(t.column("f").combine_chunks())
            last = int(np.flatnonzero(f != f[-1])[-1]) + 1 if (f != f[-1]).any() else 0
            if last:
                yield from out(t.slice(0, last))
            kept = t.slice(last)
        if kept is not None:
            yield from out(kept)

    usual = cut.where(F.col("m") <= HOT) if hot else cut
    usual = usual.drop("m").repartition("f").sortWithinPartitions("f", "row", "lo")
    result = equal.union(usual.mapInArrow(compared, "row long, lo int, hi int"))
    if hot:

        def exploded(batches):
            for b in batches:
                f, ids, lo, n = (np.asarray(b.column(i)) for i in range(4))
                sizes = np.diff(text_buffers(b.column(4))[1]).tolist()
                for x, y in common.slices(len(f), sizes, PIECE // 8):
                    h, row, place = windows(b.column(4).slice(x, y - x))
                    s = (lo[x:y][row] + place).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(f[x:y][row]), pa.array(h.view(np.int64)), pa.array(ids[x:y][row]), pa.array(s), pa.array(n[x:y][row])], ["f", "h", "row", "s", "n"])

        every = cut.where(F.col("m") > HOT).drop("m").mapInArrow(exploded, "f long, h long, row long, s int, n long")
        again = every.groupBy("f", "h").agg(F.count("*").alias("c")).where("c > 1").select("f", "h")
        result = result.union(every.where("n = 1").join(again, ["f", "h"]).select("row", F.col("s").alias("lo"), F.col("s").alias("hi")))
    starts = common.written(result.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("at")), "repeat-spans")
    common.dropped(found, contexts, fine, *([cut] if hot else []))
    return starts


def passages(docs: DataFrame, words: int, size: int) -> DataFrame:
    """row and at, as of intervals(): passages of `words` words and under `size` bytes that repeat, each as one (lo, hi).

    Longer ones are strings of `size` bytes, so only those of short words are held against each other, whole.
    """

    def short(batches):
        for b in batches:
            ids, text = np.asarray(b.column(0)), b.column(1)
            for x, y in common.slices(len(text), np.diff(text_buffers(text)[1]).tolist(), PIECE):
                data, rows = text_buffers(text.slice(x, y - x))
                starts, ends, at = runs(~BLANK[data], rows)
                i = np.arange(max(0, len(starts) - words + 1))
                row = np.searchsorted(at, i, "right") - 1
                ok = (i + words <= at[row + 1]) & (ends[i + words - 1] - starts[i] < size)
                row, lo, end = row[ok], starts[i[ok]], ends[i[ok] + words - 1]
                digest = [hashlib.blake2b(data[p:q].tobytes(), digest_size=16).digest() for p, q in zip(lo.tolist(), end.tolist())]
                cols = [pa.array(ids[x:y][row]), pa.array((lo - rows[row]).astype(np.int32)), pa.array((end - rows[row] - size).astype(np.int32)), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["row", "lo", "hi", "passage"])

    found = common.written(docs.mapInArrow(short, "row long, lo int, hi int, passage binary"), "passages")
    # Stored before the join, which can then split a passage that very many texts hold.
    again = common.written(found.groupBy("passage").agg(F.count("*").alias("n")).where("n > 1").select("passage"), "passages-again")
    spans = found.join(again, "passage").groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("at"))
    spans = common.written(spans, "passage-spans")
    common.dropped(found, again)
    return spans


def remove_repeats(docs: DataFrame, size: int = 400, with_text: bool = False, words: int = 0) -> DataFrame:
    """Columns of docs with n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text); with_text adds
    kept, the text that is left (bytes of a character that was cut go too); with `words` the passages of so many
    words that repeat go too, however few their bytes are.

    Texts are UTF-8 bytes; null is empty; texts under `size` bytes stay whole.
    Matches lie inside a text; rows that repeat are texts of their own and so
    remove each other.  Without with_text the column text is dropped.  Columns
    of docs with a result's name are replaced.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*names, "kept", "_row", "_at")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # An id from content alone is the same whenever it is computed; equal rows share it, and their spans.
    docs = docs.withColumn("text", text).withColumn("_row", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    rows = docs.select(F.col("_row").alias("row"), "text")
    starts = intervals(rows, size)
    if words:
        starts = starts.union(passages(rows, words, size)).groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"))
    starts = starts.select(F.col("row").alias("_row"), F.col("at").alias("_at"))
    both = docs.join(starts, "_row", "left")
    others = [c for c in docs.columns if c not in ("_row", "text")]
    both = both.select(*others, "text", "_at")

    def cleaned(batches):
        for b in batches:
            data, rows = text_buffers(b.column(len(others)))
            at = b.column(len(others) + 1)
            cols = [[], [], [], [], []]
            for i in range(b.num_rows):
                raw = data[rows[i] : rows[i + 1]]
                spans = removed = 0
                if at[i].is_valid:
                    got = at[i].values
                    gone = covered(len(raw), got.field(0), got.field(1), size)
                    removed = int(gone.sum())
                    spans = int((gone[1:] & ~gone[:-1]).sum()) + int(bool(len(gone)) and bool(gone[0]))
                    raw = raw[~gone]
                raw = raw.tobytes()
                for c, v in zip(cols, (int(rows[i + 1] - rows[i]), removed, spans, hashlib.sha256(raw).hexdigest(), raw)):
                    c.append(v)
            made = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())]
            if with_text:
                made.append(pa.array([x.decode("utf-8", "ignore") for x in cols[4]], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *made], [*others, *names, *(["kept"] if with_text else [])])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return both.mapInArrow(cleaned, schema + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that strings of 400 bytes repeat."""
    return remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: By all windows, as hexadecimal text.
OP3_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT r, s, md5(h[2 * s + 1 : 2 * s + 800]) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400)),
hit AS (SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, s, sum(CASE WHEN s - was <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS g FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS was FROM hit)),
sp AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM g GROUP BY r, g),
pr AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM sp),
one AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(h[2 * last + 1 : 2 * a], '' ORDER BY a) || any_value(h)[2 * max(b) + 1 :] AS kept FROM pr JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN one USING (r)
"""
