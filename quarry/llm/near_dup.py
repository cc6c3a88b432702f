"""Near-duplicate texts by Order MinHash and banded alignment.

A text is its words (A-Z lower-cased).  Two texts are alike if their edit
similarity, one less the word edits over the words of the longer, is 0.8 or more.

Candidates: a shingle is five words, labelled with its number among equal
shingles of the text.  Hash functions each sample the minimum shingle; every
TUPLE of them form a key, their shingles taken in text order, so a key is
shared only where order is kept.  As an edit destroys five shingles, most keys are
of shingles of three words, which find what edits spread over a text leave near
the threshold.  Texts of SHORT words at most have keys that miss
nothing: alike texts share 0.8 of the longer's labelled words, so the two rarest
that they share are among the few rarest of both, and each pair of those is a key.
Texts that share a key are candidates if their lengths allow the similarity and
samples of their labelled words agree: alike texts share 0.667 of these at least,
whatever the edits.  Candidates are verified by aligning their words inside the
band of edits that the similarity allows.

Texts of equal words are one class, compared once.  Classes are what links
leave connected, so not every pair is aligned.  First each part of a bucket (a
bucket beyond BLOCK texts has several) chooses leaders, the texts nearest to its
middle, and each text is aligned with the leader it agrees with best.  Then one
text of each class in a bucket stands for it, and these are compared alike.
Last, in the buckets that still hold several classes, the candidates of different
classes are aligned, in tiles of two blocks of the bucket.  There only the texts
outside its largest class ask, so the cost grows with the square of a bucket's
texts only where these are unlike each other.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesio import U, mix, stream, text_buffers
from .components import components
from .decontaminate import words_of

SHINGLE, SIMILAR = 5, 0.8
#: Words of a shingle and hash functions; minima of a key.
FAMILIES, TUPLE = ((SHINGLE, 16), (3, 80)), 2
KEYS = sum(n for _, n in FAMILIES) // TUPLE
#: Words up to which a text has keys of rare words, and from which it has sampled ones: of two alike texts both have the first or both the second.
SHORT, SAMPLED = 40, 32
#: Slots in which words of short texts are counted, by hash.
SLOTS = 1 << 18
#: Samples of labelled words; the share of equal ones from which a pair is aligned (at the least share that SIMILAR allows 0.3 % fall short, at 0.9 none of a million), and from which a text no longer leads.
SAMPLES, CANDIDATE, COVERED = 64, 0.5, 0.8
#: The finer sample of the texts that classes keep apart, and its share (at the least share that SIMILAR allows one in 200 falls short, at 0.82 none of 10,000).
FINE, FINE_CANDIDATE = 256, 0.59
#: Texts of a bucket that are compared in one task.
BLOCK = 1024
#: Occurrences of a word beyond which an alignment keeps its places as bits.
OFTEN = 64
_A = (stream(256, 31) | U(1)).astype(np.uint32)
_B = stream(256, 37).astype(np.uint32)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles of a text; a shorter text is one shingle."""
    k = max(1, min(k, len(words)))
    n = len(words) - k + 1
    h = mix(words[:n].astype(U) + U(0x9E3779B97F4A7C15))
    for i in range(1, k):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[i : n + i].astype(U))
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with their number among equal ones."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    label = np.empty(len(h), np.int64)
    label[order] = np.arange(len(s)) - start
    return np.where(label > 0, mix(h + label.astype(U) * U(0xA24BAED4963EE407)), h)


def sampled(h: np.ndarray, functions: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A byte of the minimum of each function after the first `skip`, and its place."""
    base = (h >> U(32)).astype(np.uint32)
    best = np.full(functions, 0xFFFFFFFF, np.uint32)
    where = np.zeros(functions, np.int64)
    rows, mult, flip = np.arange(functions), _A[skip : skip + functions, None], _B[skip : skip + functions, None]
    for a in range(0, len(base), 2048):
        x = (base[a : a + 2048][None, :] ^ flip) * mult
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        at = x.argmin(1)
        low = x[rows, at]
        new = low < best
        best[new], where[new] = low[new], at[new] + a
    return (best & np.uint32(255)).astype(np.uint8), where


def sampled_keys(words: np.ndarray) -> np.ndarray:
    """Keys of sampled shingles, of each of FAMILIES in turn."""
    out, skip = [], 0
    for size, functions in FAMILIES:
        h = labelled(shingles(words, size))
        place = np.sort(sampled(h, functions, skip)[1].reshape(-1, TUPLE), axis=1)
        keys = np.arange(len(place)).astype(U) + U(size << 20)
        for i in range(TUPLE):
            keys = mix(keys * U(0x9E3779B97F4A7C15) + h[place[:, i]])
        out.append(keys)
        skip += functions
    return np.concatenate(out)


def rare_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of pairs of the rarest labelled words of a short text, by counts of slots of words, then by hash."""
    h = labelled(shingles(words, 1))
    # So many words of an alike text, at least, are shared; all but these, and two more, hold two shared ones.
    most = len(h) - int(np.ceil(SIMILAR * len(h) - 1e-9)) + 2
    if len(h) < 4:
        return h[:0]
    first = np.sort(h[np.lexsort((h, counts[(h % U(SLOTS)).astype(np.int64)]))[:most]])
    i, j = np.triu_indices(len(first), 1)
    return mix(mix(first[i]) * U(0x9E3779B97F4A7C15) + first[j])


def near(x, y):
    """Whether lengths in words allow the similarity."""
    return np.minimum(x, y) >= SIMILAR * np.maximum(x, y)


def lead(sig: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """For each text of a part of a bucket that has one, the candidate (leader, text, agreement) it agrees with best; a text that agrees well with a leader doesn't lead."""
    n = len(sig)
    if n > 2:
        # Nearest to the middle first: by agreement with the commonest value of each sample.
        middle = np.array([np.bincount(c).argmax() for c in sig.T], np.uint8)
        order = np.argsort(-(sig == middle).sum(1), kind="stable")
    else:
        order = np.arange(n)
    most, leader = np.zeros(n), np.full(n, -1)
    while len(order) > 1:
        first, order = int(order[0]), order[1:]
        same = (sig[order] == sig[first]).mean(1)
        ok = near(size[order], size[first])
        better = ok & (same >= CANDIDATE) & (same > most[order])
        most[order[better]], leader[order[better]] = same[better], first
        order = order[~(ok & (same >= COVERED))]
    found = np.flatnonzero(leader >= 0)
    return list(zip(leader[found].tolist(), found.tolist(), most[found].tolist()))


def apart(part: dict, sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (i, j) between classes in a tile: i of the texts outside the bucket's largest class, j of the tile's own texts.

    A pair that meets in several buckets is looked at in the first of both only,
    by number of the key; classes that a link joins are one from then on.
    """
    label, n, keys, ids, out, t = part["root"].copy(), part["n"], part["keys"], part["a"], part["out"], int(part["t"][0])
    links, own = [], np.flatnonzero(part["own"])
    for i in np.flatnonzero(out).tolist():
        # Of two texts outside, the later one asks.
        at = own[(label[own] != label[i]) & near(n[own], n[i]) & (~out[own] | (ids[own] < ids[i]))]
        if not len(at):
            continue
        same = (sig[at] == sig[i]).mean(1)
        hit = same >= FINE_CANDIDATE
        if t:
            hit &= ~(keys[at, :t] == keys[i, :t]).any(1)
        at = at[hit][np.argsort(-same[hit], kind="stable")]
        for j in at.tolist():
            if label[j] != label[i] and similarity(part["words"][i], part["words"][j], least) >= least:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _common_ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words that two texts share at their beginnings, and behind these at their ends."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    n -= head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    return head, int(differ[0]) if len(differ) else n


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Fewest insertions, deletions and substitutions of words that turn a into b; None if more than `most`.

    Columns of the alignment's table as bit vectors of their differences, of
    which only the rows inside the band are kept: the band moves down a row with
    each column.
    """
    head, end = _common_ends(a, b)
    a, b = a[head : len(a) - end], b[head : len(b) - end]
    rows, columns = len(a), len(b)
    if abs(rows - columns) > most:
        return None
    if not rows or not columns:
        return max(rows, columns)
    spare = (most - abs(rows - columns)) // 2
    up, down = spare + max(0, columns - rows), spare + max(0, rows - columns)
    down = min(down, rows)
    width = up + down + 1
    full, last = (1 << width) - 1, width - 1
    places: dict[int, list[int]] = {}
    for i, w in enumerate(a.tolist(), 1):
        places.setdefault(w, []).append(i)
    bits = {}
    for w, at in places.items():
        if len(at) > OFTEN:
            mark = np.zeros(rows + 1, np.uint8)
            mark[at] = 1
            bits[w] = int.from_bytes(np.packbits(mark, bitorder="little").tobytes(), "little")
    # Before the first column, row i stands at bit i - 1 + up; rows under 1 are outside the table.
    plus, minus, cost = full & ~((1 << up) - 1), 0, down
    turn = rows - down  # from this column on the last row lies in the band
    for j, w in enumerate(b.tolist(), 1):
        top = j - up  # the row of bit 0
        if w in bits:
            same = (bits[w] >> top if top >= 0 else bits[w] << -top) & full
        else:
            at, same = places.get(w, ()), 0
            for k in range(bisect_left(at, top), len(at)):
                if at[k] > top + last:
                    break
                same |= 1 << (at[k] - top)
        diagonal = (((same & plus) + plus) ^ plus | same | minus) & full
        right_more = minus | full & ~(diagonal | plus)
        right_less = diagonal & plus
        if j <= turn:
            cost += not diagonal >> last & 1
        else:
            bit = rows - top
            cost += (right_more >> bit & 1) - (right_less >> bit & 1)
        if cost - (columns - max(j, turn)) > most:
            return None
        down_one = diagonal >> 1
        plus = right_less | full & ~(down_one | right_more)
        minus = down_one & right_more
    return cost if cost <= most else None


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """One less the word edits between two texts over the words of the longer; 0 if it is under `least`, or a text has no words."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if not min(len(a), len(b)) or longer - min(len(a), len(b)) > most:
        return 0.0
    if len(a) == len(b) and (a == b).all():
        return 1.0
    # Words that are no match cost an edit each.
    if longer - len(np.intersect1d(labelled(shingles(a, 1)), labelled(shingles(b, 1)), assume_unique=True)) > most:
        return 0.0
    found = edits(a, b, most)
    return 0.0 if found is None else 1 - found / longer


def _sizes(text):
    return np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).tolist() if len(text) else []


def near_duplicates(docs: DataFrame, least: float = SIMILAR, by_text: bool = False) -> DataFrame:
    """doc_id, class_id (the smallest doc_id reachable by links) and kept (whether it is that) for each row of docs(doc_id, text).

    Texts without words (null, empty) link with nothing; under four words an edit
    is more than the similarity allows.  A row without doc_id
    links with nothing, has no class and is kept.  Rows of one doc_id are one
    document, of all classes their texts fall in.  Other columns are not read;
    no rows give no rows.  by_text adds root, one for each class (null for rows
    that link with nothing), and key, the SHA-256 of the text.
    """
    more = ["key"] if by_text else []

    def read(batches):
        names = ["doc_id", "digest", "n", "words", *more]
        for b in batches:
            doc, text = b.column(0), b.column(1)
            for x, y in common.slices(len(text), _sizes(text), 1 << 20):
                _, _, _, at, h = words_of(*text_buffers(text.slice(x, y - x)))
                cut = [h[p:q] for p, q in zip(at[:-1].tolist(), at[1:].tolist())]
                digest = [hashlib.blake2b(c.tobytes(), digest_size=16).digest() if len(c) else None for c in cut]
                short = [(c >> U(32)).astype("<u4").tobytes() for c in cut]
                yield pa.RecordBatch.from_arrays([doc.slice(x, y - x), pa.array(digest, pa.binary()), pa.array(np.diff(at).astype(np.int64)), pa.array(short, pa.binary()), *(c.slice(x, y - x) for c in b.columns[2:])], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.sha2("text", 256).alias(k) for k in more])
    base = rows.mapInArrow(read, "doc_id long, digest binary, n long, words binary" + ", key string" * by_text)
    base = common.written(base.withColumn("rid", F.monotonically_increasing_id()), "near-words")
    live = base.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = live.groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("one"))
    classes = common.written(classes.select("digest", F.col("one.doc_id").alias("rep"), F.col("one.rid").alias("rid"), F.xxhash64("digest").alias("cid")), "near-classes")
    # Joined by the row, not by the digest, so copies of one text are spread.
    firsts = live.select("rid", "n", "words").join(classes.select("rid", "cid").hint("merge"), "rid").select("cid", "n", "words")
    # In a fixed order, so batches, leaders and with them the links are alike on every run.
    firsts = common.written(firsts.sortWithinPartitions("cid"), "near-firsts")
    ids = common.written(base.select("doc_id", "digest", *more), "near-ids")
    common.dropped(base)

    rarity = _rarity(firsts)

    def sketched(batches):
        for b in batches:
            cid, sizes = np.asarray(b.column(0)), np.asarray(b.column(1))
            keys, rare, sig = np.empty((b.num_rows, KEYS), U), [], []
            for i, (n, w) in enumerate(zip(sizes.tolist(), b.column(2))):
                words = np.frombuffer(w.as_buffer(), "<u4")
                # Texts without sampled keys hold values that no other has.
                keys[i] = sampled_keys(words) if n >= SAMPLED else mix(cid[i : i + 1].view(U) * U(KEYS) + np.arange(KEYS, dtype=U))
                rare.append(rare_keys(words, rarity.value) if n <= SHORT else keys[i, :0])
                sig.append(sampled(labelled(shingles(words, 1)), SAMPLES)[0].tobytes())
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * KEYS
            rare_ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            pairs = np.concatenate(rare) if rare else np.zeros(0, U)
            lists = [pa.ListArray.from_arrays(e, pa.array(v.reshape(-1).view(np.int64))) for e, v in ((ends, keys), (rare_ends, pairs))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(sig, pa.binary()), *lists], ["a", "n", "sig", "buckets", "rare"])

    sketches = common.written(firsts.mapInArrow(sketched, "a long, n int, sig binary, buckets array<long>, rare array<long>"), "near-sketches")
    every = sketches.where(F.col("n") >= SAMPLED).select("a", F.posexplode("buckets").alias("t", "bucket"))
    every = every.union(sketches.where(F.col("n") <= SHORT).select("a", F.lit(0), F.explode("rare")))
    shared = common.written(every.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "near-shared")
    members = common.written(every.join(shared.select("bucket").hint("merge"), "bucket"), "near-members")
    texts = sketches.select("a", "n", "sig")
    of = components(linked(led(members, shared, texts), firsts, least))

    def named():
        return members.join(of.hint("merge"), members["a"] == of["node"], "left").select("bucket", "t", "a", F.coalesce("root", "a").alias("root"))

    def split(rows):
        """Rows of buckets that hold several classes; the buckets are stored before the join, which can then split a large one."""
        several = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
        return rows.join(common.written(several, "near-several").hint("merge"), "bucket")

    stand = common.written(named().groupBy("bucket", "root").agg(F.min("a").alias("a")), "near-first")
    stand = common.written(split(stand).select("bucket", "a"), "near-stand")
    counts = common.written(stand.groupBy("bucket").agg(F.count("*").alias("k")), "near-shared")
    links = linked(led(stand, counts, texts), firsts, least)
    if links.take(1):
        of = components(links.union(of))
    common.dropped(stand, counts)
    rows = common.written(named(), "near-named")
    open_ = common.written(split(rows), "near-open")
    if open_.take(1):
        links = common.written(crossing(open_, sketches, firsts, least), "near-links")
        if links.take(1):
            of = components(links.union(of))
    common.dropped(rows, open_)
    common.dropped(firsts, sketches, shared, members)
    return classed(ids, classes, of, more)


def _rarity(firsts: DataFrame):
    """Broadcast counts of the labelled words of short texts, in SLOTS slots by hash: any order that all texts share will do, and rare words make small buckets."""

    def count(batches):
        held = np.zeros(SLOTS, np.int64)
        for b in batches:
            if b.num_rows:
                h = np.concatenate([labelled(shingles(np.frombuffer(w.as_buffer(), "<u4"), 1)) for w in b.column(0)])
                held += np.bincount((h % U(SLOTS)).astype(np.int64), minlength=SLOTS)
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[own])], ["slot", "k"])

    found = firsts.where(F.col("n") <= SHORT).select("words").mapInArrow(count, "slot long, k long").groupBy("slot").agg(F.sum("k").alias("k")).toPandas()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["k"].to_numpy(np.int64)
    return firsts.sparkSession.sparkContext.broadcast(out)


def _parts(batches, names):
    """Whole parts, as tables: rows that have equal values in the columns `names`, by which batches are sorted."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        edge = np.zeros(b.num_rows, bool)
        for c in names:
            x = np.asarray(b.column(b.schema.get_field_index(c)))
            edge[1:] |= x[1:] != x[:-1]
            edge[0] |= bool(held) and held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() != x[0]
        cuts = [0, *np.flatnonzero(edge).tolist(), b.num_rows]
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            if y > x:
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _columns(t, samples: int) -> tuple[dict, np.ndarray]:
    """Columns of a part as arrays, its keys and words among them, and its samples."""
    cols = {c: np.asarray(t.column(c).combine_chunks()) for c in t.column_names if c not in ("sig", "keys", "words")}
    if "keys" in t.column_names:
        cols["keys"] = text_buffers(t.column("keys"))[0].view(np.uint32).reshape(t.num_rows, -1)
    if "words" in t.column_names:
        cols["words"] = [np.frombuffer(w.as_buffer(), "<u4") for w in t.column("words").combine_chunks()]
    return cols, text_buffers(t.column("sig"))[0].reshape(-1, samples)


def _found(batches, names, samples: int, of):
    """Rows (a, b, same) that `of` finds in each part of two rows or more."""
    out, have = [], 0
    for t in _parts(batches, names):
        if t.num_rows > 1:
            part, sig = _columns(t, samples)
            got = of(part, sig)
            if got:
                i, j, same = (np.array(x) for x in zip(*got))
                out.append((part["a"][i], part["a"][j], same.astype(np.float64)))
                have += len(got)
        if have > 50_000:
            yield _batch(out)
            out, have = [], 0
    if out:
        yield _batch(out)


def _batch(out):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b", "same"])


def _blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with the block of each in its bucket, of counts(bucket, k)."""
    blocks = F.ceil(F.col("k") / BLOCK).cast("long")
    return rows.join(counts.withColumn("blocks", blocks).drop("k").hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")))


def led(members: DataFrame, counts: DataFrame, texts: DataFrame) -> DataFrame:
    """For each text the candidate (a, b) it agrees with best among leaders of the blocks that members(bucket, a) share."""
    tile = ("bucket", "block")
    rows = _blocks(members, counts).join(texts.hint("merge"), "a").select(*tile, "a", "n", "sig")
    rows = rows.repartition(*tile).sortWithinPartitions(*tile, "a")
    return _best(rows.mapInArrow(_leads, "a long, b long, same double"))


def _leads(batches):
    """lead() of each block of a bucket, of batches sorted by bucket and block; the many of two texts are compared a batch at a time."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            cols = [np.asarray(b.column(i)) for i in range(4)] + [text_buffers(b.column(4))[0].reshape(-1, SAMPLES)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if held is None or not len(held[0]):
            continue
        bucket, block, a, n, sig = held
        first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])))
        # The last block may go on in the next batch.
        end = len(bucket) if b is None else int(first[-1])
        first, size = first[first < end], np.diff(np.append(first[first < end], end))
        two = first[size == 2]
        same = (sig[two] == sig[two + 1]).mean(1)
        two, same = two[(same >= CANDIDATE) & near(n[two], n[two + 1])], same[(same >= CANDIDATE) & near(n[two], n[two + 1])]
        out = [(a[two], a[two + 1], same)]
        for x, k in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            got = lead(sig[x : x + k], n[x : x + k])
            if got:
                i, j, s = (np.array(v) for v in zip(*got))
                out.append((a[x + i], a[x + j], s.astype(np.float64)))
        yield _batch(out)
        held = [c[end:] for c in held]


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("b").agg(F.max(F.struct("same", F.negative("a").alias("a"))).alias("one")).select(F.negative("one.a").alias("a"), "b")


def crossing(rows: DataFrame, sketches: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between different classes that meet in a bucket of rows(bucket, t, a, root).

    Texts outside a bucket's largest class are held against all of the bucket, in
    tiles of a block of either; they are aligned there, so no pair leaves a task
    that isn't a link.
    """

    def finer(batches):
        for b in batches:
            keys = np.asarray(b.column(3).flatten()).astype(np.int64).view(U).reshape(b.num_rows, -1)
            short = [x.tobytes() for x in (keys >> U(32)).astype(np.uint32)]
            sig = [sampled(labelled(shingles(np.frombuffer(w.as_buffer(), "<u4"), 1)), FINE)[0].tobytes() for w in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sig, pa.binary()), pa.array(short, pa.binary())], ["a", "n", "words", "sig", "keys"])

    def of(part, sig):
        return [(i, j, 1.0) for i, j in apart(part, sig, least)]

    live = rows.select("a").distinct()
    texts = sketches.select("a", "n", "buckets").join(live.hint("merge"), "a").join(firsts.select(F.col("cid").alias("a"), "words").hint("merge"), "a")
    texts = texts.select("a", "n", "words", "buckets").mapInArrow(finer, "a long, n int, words binary, sig binary, keys binary")
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    per = sizes.groupBy("bucket").agg(F.sum("k").alias("k"), F.max(F.struct("k", "root")).alias("most"))
    per = per.select("bucket", "k", F.col("most.root").alias("largest"), F.ceil((F.col("k") - F.col("most.k")) / BLOCK).cast("long").alias("others"))
    rows = _blocks(rows, per).withColumn("out", F.col("root") != F.col("largest")).withColumn("other", F.pmod(F.xxhash64("a", F.lit(1)), F.col("others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    tile = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    asked = F.transform(upto("others"), lambda q: tile(F.col("block"), q))
    asking = F.when(F.col("out"), F.transform(upto("blocks"), lambda p: tile(p, F.col("other")))).otherwise(F.slice(asked, 1, 0))
    rows = rows.withColumn("tile", F.explode(F.array_union(asked, asking))).select("bucket", "tile.p", "tile.q", "t", "a", "root", (F.col("tile.p") == F.col("block")).alias("own"), (F.col("out") & (F.col("tile.q") == F.col("other"))).alias("out"))
    names = ("bucket", "p", "q")
    rows = rows.join(texts.hint("merge"), "a").repartition(*names).sortWithinPartitions(*names, "a")
    return rows.mapInArrow(lambda batches: _found(batches, names, FINE, of), "a long, b long, same double").select("a", "b")


def linked(found: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """The pairs of found(a, b) whose words, in firsts(cid, words), are alike."""

    def verified(batches):
        for b in batches:
            ok = [similarity(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), least) >= least for x, y in zip(b.column(2), b.column(3))]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    found = common.written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    # Only the words of texts in a pair are moved.
    asked = common.written(found.select(F.col("a").alias("cid")).union(found.select("b")).distinct(), "near-asked")
    words = common.written(firsts.select("cid", "words").join(asked.hint("merge"), "cid"), "near-asked-words")
    left = words.select(F.col("cid").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("cid").alias("b"), F.col("words").alias("wb"))
    links = common.written(found.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "wa", "wb").mapInArrow(verified, "a long, b long"), "near-links")
    common.dropped(found, asked, words)
    return links


def classed(base: DataFrame, classes: DataFrame, of: DataFrame, more: list[str]) -> DataFrame:
    """Classes of all rows from the components (node, root) of text classes."""
    roots = classes.join(of.hint("merge"), classes["cid"] == of["node"], "left").select("digest", "rep", F.coalesce("root", "cid").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = roots.join(least.hint("merge"), "root").select("digest", "class_id", "root")
    named = named if more else named.drop("root")
    own = ["root", *more] if more else []
    ids = base.select("doc_id", "digest", *more).where("digest IS NOT NULL AND doc_id IS NOT NULL").join(named.hint("merge"), "digest").select("doc_id", "class_id", *own)
    alone = base.where("digest IS NULL OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), *([F.lit(None).cast("long").alias("root"), *more] if more else []))
    return ids.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of near copies each belongs to."""
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
