"""Ranked lexical search by MaxScore, shard by shard.

Items (queries) are bags of terms; a document's score sums, over an item's terms,
repeats included, a weight that falls with the documents holding the term times
an integer impact that grows with the term's share of the document.

One pass over the texts keeps, of each document, its length and the items' terms
in it with their occurrences; all other words only count.  Documents, totals and
holders of each term come from that table.  A second pass cuts it into shards of
SHARD documents at most and turns each into posting lists.  A list's upper bound
in the shard is its best impact.  An item opens its lists by falling bound; once
the bounds of those left sum to less than the item's tenth best score, these are
non-essential: no document found only there can qualify, so they are probed for
the documents found so far, and only while such a document's score and the bounds
left can still reach the tenth.  The tenth best is carried from shard to shard of a
task; each task hands over the best of each item, and a window ranks these.

Terms are hashes of 64 bits.  Items are searched for CHUNK_TERMS terms (or one
item) at once, so neither the driver nor a worker holds more of them.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bytesio import U
from .decontaminate import _slices, words_of

#: Documents and postings of a shard; terms of items that are searched for at once.
SHARD, POSTINGS, CHUNK_TERMS = 8192, 1 << 20, 1 << 19
#: Slots of the table that tells most words from the items' terms.
TABLE_BITS = 20


def term_counts(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and occurrences of each term of each row, of the hashes of words of rows that begin at `at`."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    row, h = row[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


class Vocabulary:
    """The items' terms as sorted hashes, and a table by their low bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.mask = hashes, U((1 << TABLE_BITS) - 1)
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[(hashes & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and the terms' numbers."""
        at = np.flatnonzero(self.maybe[(h & self.mask).astype(np.int64)])
        number = np.searchsorted(self.hashes, h[at])
        ok = number < len(self.hashes)
        ok[ok] = self.hashes[number[ok]] == h[at[ok]]
        return at[ok], number[ok]


class Shard:
    """Posting lists of some documents: places of documents and impacts, and each list's upper bound."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, docs: int, total: int, weight: np.ndarray):
        self.doc = doc
        m = 25 + 75 * n * docs // max(total, 1)
        place = np.repeat(np.arange(len(doc)), sizes)
        order = np.argsort(term, kind="stable")
        self.place, term, tf = place[order], term[order], tf[order]
        self.impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.place]))
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.terms, self.first = term[first], np.append(first, len(term))
        self.bound = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.int64)

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the documents that score `least` or more and may be among the k best; those of score 0 aren't."""
        slot = np.searchsorted(self.terms, terms)
        have = slot < len(self.terms)
        have[have] = self.terms[slot[have]] == terms[have]
        slot, times = slot[have], repeats[have]
        bound = self.bound[slot] * times
        order = np.argsort(-bound, kind="stable")
        slot, times = slot[order].tolist(), times[order].tolist()
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0).tolist()
        score = np.zeros(len(self.doc), np.int64)
        i = 0
        # Essential lists: while a document of the rest alone could still qualify.
        while i < len(slot) and rest[i] >= max(least, 1):
            a, b = self.first[slot[i]], self.first[slot[i] + 1]
            score[self.place[a:b]] += times[i] * self.impact[a:b]
            i += 1
            if i < len(slot) and len(score) > k and rest[i] < score.max():
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
        found = np.flatnonzero(score)
        # The others are probed for documents that may still qualify.
        while i < len(slot) and len(found):
            found = found[score[found] + rest[i] >= least]
            a, b = self.first[slot[i]], self.first[slot[i] + 1]
            own = self.place[a:b]
            at = np.searchsorted(own, found)
            at[at == len(own)] = 0
            hit = own[at] == found
            score[found[hit]] += times[i] * self.impact[a:b][at[hit]]
            i += 1
        found = found[score[found] >= max(least, 1)]
        return score[found], found


class Ranking:
    """The k best documents so far of each item."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.items, self.k = items, k
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, shard: Shard) -> None:
        for i, (terms, repeats) in enumerate(self.items):
            old = self.kept.get(i)
            score, place = shard.best(terms, repeats, self.k, int(old[0][-1]) if old and len(old[0]) == self.k else 0)
            if not len(score):
                continue
            doc = shard.doc[place]
            if old:
                score, doc = np.concatenate([old[0], score]), np.concatenate([old[1], doc])
            order = np.lexsort((doc, -score))[: self.k]
            self.kept[i] = score[order], doc[order]


def chunks(terms: DataFrame, most: int = CHUNK_TERMS):
    """Lists of (item, hashes, repeats) from terms(item, h, q), each of `most` terms at most or one item; the driver holds one at a time."""
    held, size, item, h, q = [], 0, None, [], []

    def whole():
        order = np.argsort(np.array(h, np.int64).view(U))
        return item, np.array(h, np.int64).view(U)[order], np.array(q, np.int64)[order]

    for r in terms.orderBy("item").toLocalIterator():
        if h and r["item"] != item:
            held.append(whole())
            size += len(h)
            h, q = [], []
            if size >= most:
                yield held
                held, size = [], 0
        item = r["item"]
        h.append(r["h"])
        q.append(r["q"])
    if h:
        held.append(whole())
    if held:
        yield held


def _texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item, h, q: the terms of each item with their repeats; rows of one item_id are one item, rows without one are left out."""

    def read(batches):
        for b in batches:
            for x, y, data, rows in _slices(b.column(1)):
                _, _, _, at, hashes = words_of(data, rows)
                row, h, c = term_counts(hashes, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["item", "h", "q"])

    rows = _texts(items, item_id, text).where("id IS NOT NULL").mapInArrow(read, "item long, h long, q long")
    return rows.groupBy("item", "h").agg(F.sum("q").alias("q"))


_built: dict[str, Vocabulary] = {}


def _vocabulary(held, key: str) -> Vocabulary:
    """The vocabulary of a broadcast chunk, built once in a worker and kept until another chunk comes."""
    if key not in _built:
        _built.clear()
        _built[key] = Vocabulary(held.value)
    return _built[key]


def _forward(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """id, n, terms, tfs: each document's words, and the vocabulary's terms in it by number with their occurrences."""
    held, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex  # 8 bytes for each of a chunk's terms

    def read(batches):
        for b in batches:
            for x, y, data, rows in _slices(b.column(1)):
                _, _, _, at, hashes = words_of(data, rows)
                place, number = _vocabulary(held, key).find(hashes)
                inner = np.searchsorted(place, at)
                row, term, tf = term_counts(number, inner)
                ends = pa.array(np.searchsorted(row, np.arange(y - x + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))) for c in (term, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(np.diff(at)), *lists], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(read, "id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def _holders(forward: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term."""

    def count(batches):
        held = np.zeros(size, np.int64)
        for b in batches:
            held += np.bincount(np.asarray(b.column(0).flatten()), minlength=size)
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[own])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in forward.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def _shards(batches):
    """(doc, n, sizes, term, tf) of shards, from batches of the forward table."""
    held, docs, postings = [], 0, 0
    for b in batches:
        a = 0
        sizes = np.asarray(b.column(2).value_lengths()).astype(np.int64) if b.num_rows else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        while a < b.num_rows:
            before = int(ends[a - 1]) if a else 0
            z = min(a + SHARD - docs, int(np.searchsorted(ends, before + POSTINGS - postings, "right")), b.num_rows)
            z = max(z, a + (not held))
            if z > a:
                part = b.slice(a, z - a)
                # A document without id counts but isn't ranked.
                term, tf = (np.asarray(part.column(c).flatten()).astype(np.int64) for c in (2, 3))
                held.append((np.asarray(part.column(0)), np.asarray(part.column(1)), sizes[a:z], term, tf))
                docs, postings = docs + z - a, postings + int(sizes[a:z].sum())
            if z < b.num_rows:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, docs, postings = [], 0, 0
            a = z
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with score above 0, equal scores by doc_id.

    Null and empty texts have no terms: such documents count nowhere, such items
    find nothing.  Rows of one doc_id are documents of their own; a row without
    doc_id counts in the statistics but isn't ranked.  Rows of one item_id are one
    item of all their terms; rows without item_id are left out.  Other columns are
    not read; no documents or no items give no rows.  Integer steps are of 64
    bits: words of a document times documents must stay under 1.2e17.
    """
    spark = docs.sparkSession
    docs = _texts(docs, doc_id, text)
    terms = common.written(item_terms(items, item_id, text), "rank-items")
    found = None
    for part in chunks(terms):
        vocabulary = np.unique(np.concatenate([h for _, h, _ in part]))
        forward = common.written(_forward(docs, vocabulary), "rank-postings")
        count, total = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for df in _holders(forward, len(vocabulary)).tolist()], np.int64)
        held = spark.sparkContext.broadcast((weight, [i for i, _, _ in part], [(np.searchsorted(vocabulary, h), q) for _, h, q in part]))

        def ranked(batches, held=held, count=count, total=total):
            weight, names, own = held.value
            best = Ranking(own, k)
            for shard in _shards(batches):
                best.add(Shard(*shard, count, total, weight))
            for i, (score, doc) in best.kept.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), names[i], np.int64)), pa.array(doc), pa.array(score)], ["item_id", "doc_id", "score"])

        rows = forward.where("size(terms) > 0 AND id IS NOT NULL").select("id", "n", "terms", "tfs").mapInArrow(ranked, "item_id long, doc_id long, score long")
        rows = common.written(rows, "rank-best")
        found = rows if found is None else found.union(rows)
        common.dropped(forward)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"

#: By all postings.
OP11_SQL = f"""
WITH d AS (SELECT row, doc_id, t, count(*) AS tf FROM (SELECT row, doc_id, {_TERMS} AS t FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)) GROUP BY row, doc_id, t),
s AS (SELECT row, doc_id, sum(tf) AS n FROM d GROUP BY row, doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM s),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM d, a GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, {_TERMS} AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, t),
x AS (SELECT item_id, d.doc_id, d.row, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * CAST(n AS BIGINT) * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN d USING (t) JOIN s USING (row), a WHERE d.doc_id IS NOT NULL GROUP BY item_id, d.doc_id, d.row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""
