"""LM scoring by the marginal likelihood of a subword lattice.

The pieces are those of an existing sentencepiece vocabulary, single bytes, so every
word has a path, and each training word as a piece that spans it whole.  A word's own
piece has its uses less a discount, which is estimated from the words used once and
twice; the discounted share of all words is what the other pieces are fitted to.  The
vocabulary's scores give their first probabilities, and ROUNDS of
expectation-maximisation replace them.  All pieces and the end share one distribution.
A text is words at ASCII white space, each with the vocabulary's word mark before it,
and an end; the probability of a word is the sum over all its segmentations, by
a forward recursion in log space, for many words of one length at once.  Since
no piece crosses words, a text's log probability is the sum over its words.

All counts are over all training texts.  Each distinct word is scored once.  The
at most COMMON of the most frequent words are broadcast; the rarer rest is joined by hash, so
nothing that grows with the corpus is sent to every worker or to the driver.
Words are known by a 64-bit hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesio import BASE, BYTE, INVERSE, LOWER, U, mix, powers, prefix_sums, run_hashes, runs, text_buffers

COMMON, ROUNDS, MOST_BYTES = 300_000, 4, 48
#: Pseudo-count of a piece, and the end of a text as a piece of its own.
PRIOR = 1e-3
MARK = 0x20  # stands for the vocabulary's word mark; no word holds it
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Bits of a hash that a first look at a small table takes; most spans are no piece and go no further.
LOOK = 20
_LENGTH = np.arange(1 << 12).astype(U) * U(0xD6E8FEB86659FD93)


class Pieces:
    """Sorted hashes of the pieces of a vocabulary, lengths in bytes, and starting probabilities from its scores."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
        found: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
                continue
            raw = LOWER[np.frombuffer(model.id_to_piece(i).replace("▁", " ").encode(), np.uint8)].tobytes()
            if raw and raw.rfind(b" ") <= 0:
                # Scores of such vocabularies are minus a rank: a share that falls with the rank.
                found[raw] = found.get(raw, 0.0) + 1.0 / (100.0 - model.get_score(i))
        names = list(found)
        lengths = np.array([len(x) for x in names])
        ends = np.cumsum(lengths)
        hashes = run_hashes(prefix_sums(np.frombuffer(b"".join(names), np.uint8)), ends - lengths, ends)
        order = np.argsort(hashes)
        self.hashes, self.lengths = hashes[order], lengths[order]
        self.longest = int(lengths.max())
        slot = (self.hashes >> U(64 - LOOK)).astype(np.int64)
        self.look = np.zeros(1 << LOOK, bool)
        self.look[slot] = True
        self.first = np.searchsorted(slot, np.arange(1 << LOOK)).astype(np.int32)
        self.crowd = int(np.bincount(slot).max())
        # A span that begins no longer piece need not be stretched.
        begins = {x[:k] for x in names for k in range(1, len(x))}
        ends = np.cumsum([len(x) for x in begins])
        begun = run_hashes(prefix_sums(np.frombuffer(b"".join(begins), np.uint8)), ends - [len(x) for x in begins], ends)
        self.longer = np.zeros(1 << LOOK, bool)
        self.longer[(begun >> U(64 - LOOK)).astype(np.int64)] = True
        share = np.array([found[names[i]] for i in order])
        self.share = share

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and the piece each of these is."""
        slot = (h >> U(64 - LOOK)).astype(np.int64)
        own = np.flatnonzero(self.look[slot])
        at, h = self.first[slot[own]].astype(np.int64), h[own]
        for _ in range(self.crowd - 1):
            other = np.flatnonzero(self.hashes[at] != h)
            at[other] = np.minimum(at[other] + 1, len(self.hashes) - 1)
        same = self.hashes[at] == h
        return own[same], at[same]

    def probabilities(self, counts: np.ndarray | None, ends: float, training: float, words: float = 0.0) -> tuple[np.ndarray, float, float]:
        """Log probabilities of pieces and of the end, from expected counts or from the vocabulary's scores, and the log of all counts, `words` of which are of pieces that are whole words."""
        if counts is None:
            # With the scores alone: three pieces for each end is as good a guess as any.
            counts, ends = self.share / self.share.sum() * max(training, 1.0), max(ends, 0.1)
        total = counts.sum() + ends + words + PRIOR * (len(counts) + 1)
        return np.log((counts + PRIOR) / total), float(np.log((ends + PRIOR) / total)), float(np.log(total))


def discount(once: int, twice: int) -> float:
    """What a word's own piece leaves to the others, from the words used once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


_pieces: dict[str | None, Pieces] = {}


def pieces(path: str | None = None) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def lattice(words: np.ndarray, p: Pieces, logp: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Log marginal probabilities of words of one length, rows of bytes with the mark first.

    With counts, the expected uses of each piece are added to `expected`.
    """
    n, size = words.shape
    sums = np.zeros((size + 1, n), U)
    np.cumsum((BYTE[words] * powers(BASE, size)).T, axis=0, out=sums[1:])
    inverse = powers(INVERSE, size + 1)
    alpha = np.full((size + 1, n), -np.inf)
    alpha[0] = 0
    arcs = []
    for start in range(size):
        live = np.arange(n)
        for length in range(1, min(p.longest, size - start) + 1):
            h = mix((sums[start + length, live] - sums[start, live]) * inverse[start] + _LENGTH[length])
            own, at = p.find(h)
            hit = live[own]
            if len(hit):
                end = start + length
                alpha[end, hit] = np.logaddexp(alpha[end, hit], alpha[start, hit] + logp[at])
                if counts is not None:
                    arcs.append((start, end, hit, at))
            live = live[p.longer[(h >> U(64 - LOOK)).astype(np.int64)]]
            if not len(live):
                break
    if counts is not None:
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0
        for start, end, hit, at in reversed(arcs):
            # Arcs come by ascending start, so in reverse every later arc is done.
            beta[start, hit] = np.logaddexp(beta[start, hit], beta[end, hit] + logp[at])
            share = np.exp(alpha[start, hit] + logp[at] + beta[end, hit] - alpha[size, hit])
            expected += np.bincount(at, share * counts[hit], len(expected))
    return alpha[size]


def each_length(column, most: int = 1 << 14):
    """(rows, words as a matrix with the mark first) for words of a length."""
    data, at = text_buffers(column)
    lengths = np.diff(at)
    for size in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == size)
        step = max(1, most // max(1, size // 16))
        for a in range(0, len(own), step):
            part = own[a : a + step]
            out = np.full((len(part), size + 1), MARK, np.uint8)
            out[:, 1:] = data[at[part][:, None] + np.arange(size)]
            yield part, out


def _arcs(word: np.ndarray, p: Pieces, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece of the arcs of a word that end behind place a and up to place z, by end."""
    low = max(0, a - p.longest)
    sums, inverse, found = prefix_sums(word[low:z]), powers(INVERSE, z - low + 1), []
    for length in range(1, min(p.longest, z - low) + 1):
        h = mix((sums[length:] - sums[:-length]) * inverse[: z - low - length + 1] + _LENGTH[length : length + 1])
        start, at = p.find(h)
        own = start + length > a - low
        found.append((start[own] + low, start[own] + low + length, at[own]))
    start, end, at = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], at[order]


def long_lattice(word: np.ndarray, p: Pieces, logp: np.ndarray, count: float | None = None, expected: np.ndarray | None = None, block: int = 1 << 15) -> float:
    """lattice() for one long word, the arcs of a block of places at a time: beside them a number a place, or two, is held."""
    size = len(word)
    alpha = np.full(size + 1, -np.inf)
    alpha[0] = 0.0
    for a in range(0, size, block):
        z, low = min(size, a + block), max(0, a - p.longest)
        start, end, at = _arcs(word, p, a, z)
        held = alpha[low : z + 1].tolist()
        for s, e, x in zip((start - low).tolist(), (end - low).tolist(), logp[at].tolist()):
            held[e] = _logadd(held[e], held[s] + x)
        alpha[low : z + 1] = held
    if count is not None:
        beta = np.full(size + 1, -np.inf)
        beta[size] = 0.0
        for a in reversed(range(0, size, block)):
            z, low = min(size, a + block), max(0, a - p.longest)
            start, end, at = _arcs(word, p, a, z)
            held = beta[low : z + 1].tolist()
            for s, e, x in zip((start - low)[::-1].tolist(), (end - low)[::-1].tolist(), logp[at][::-1].tolist()):
                held[s] = _logadd(held[s], held[e] + x)
            beta[low : z + 1] = held
            # What an arc's end stands for is complete: arcs from there end in this block or a later one.
            np.add.at(expected, at, np.exp(alpha[start] + logp[at] + beta[end] - alpha[size]) * count)
    return float(alpha[size])


def _logadd(x: float, y: float) -> float:
    x, y = (x, y) if x > y else (y, x)
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def long_marginal(words: np.ndarray, p: Pieces, logp: np.ndarray, counts=None, expected=None) -> np.ndarray:
    """lattice() for words of any length; those beyond 4*MOST_BYTES one by one, as their places outnumber them."""
    if words.shape[1] <= 4 * MOST_BYTES:
        return lattice(words, p, logp, counts, expected)
    return np.array([long_lattice(w, p, logp, None if counts is None else counts[i], expected) for i, w in enumerate(words)])


def tokens(column):
    """Lower-cased bytes, starts and ends of words, and where each row's words begin."""
    data, rows = text_buffers(column)
    low = LOWER[data]
    return low, *runs(~SPACE[low], rows)


def _chunks(text, most=1 << 20):
    sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).tolist() if len(text) else []
    return common.slices(len(text), sizes, most)


def vocabulary(docs: DataFrame, trains: str) -> DataFrame:
    """h, word, c (uses in training texts), total (in all) of each distinct word of docs(text, and the boolean column `trains`)."""

    def counted(batches):
        for b in batches:
            text, every = b.column(0), np.asarray(b.column(1)).astype(np.int64)
            for x, y in _chunks(text, 8 << 20):
                low, starts, ends, at = tokens(text.slice(x, y - x))
                if not len(starts):
                    continue
                use = every[x:y]
                h = run_hashes_blocks(low, starts, ends)
                fresh, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                c = np.bincount(inverse, np.repeat(use, np.diff(at)), len(fresh)).astype(np.int64)
                raw = low.tobytes()
                words = pa.array([raw[a:e] for a, e in zip(starts[first].tolist(), ends[first].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(fresh.view(np.int64)), words, pa.array(c), pa.array(n.astype(np.int64))], ["h", "word", "c", "total"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(trains))
    return rows.mapInArrow(counted, "h long, word binary, c long, total long").groupBy("h").agg(F.first("word").alias("word"), F.sum("c").alias("c"), F.sum("total").alias("total"))


def run_hashes_blocks(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """run_hashes over long data, a block of runs at a time."""
    out, i = np.zeros(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        a = int(starts[i])
        out[i:j] = run_hashes(prefix_sums(low[a : int(ends[j - 1])]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def score(docs: DataFrame, trains: str, path: str | None = None, rounds: int = ROUNDS, common_words: int = COMMON) -> DataFrame:
    """Columns of docs with n_tokens, n_known, train_tokens, base_score and score for each row.

    docs has text and the boolean column `trains`.  Null and empty texts are the
    end alone.  base_score is the add-one unigram of training tokens, score the
    lattice model, both log10.  Without training rows N and V are 0 and the
    vocabulary's scores are used.  Words of any length are scored over their whole
    lattice.  Rows that repeat count each; columns of the results'
    names are replaced.
    """
    spark = docs.sparkSession
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*names)
    words = common.written(vocabulary(docs, trains), "lm-words")
    ends = docs.where(F.col(trains)).count()
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n, v = seen[0] + ends, seen[1] + (ends > 0)
    p = pieces(path)
    less = discount(seen[2], seen[3])
    whole = seen[0] - less * seen[1]  # uses of words' own pieces
    logs = p.probabilities(None, ends, 3.0 * less * seen[1], whole)
    size = len(p.hashes)
    for _ in range(rounds if seen[0] else 0):
        held = spark.sparkContext.broadcast(logs[0])  # one number a piece

        def expectation(batches):
            own, total = pieces(path), np.zeros(size)
            for b in batches:
                for part, rows in each_length(b.column(0)):
                    long_marginal(rows, own, held.value, np.full(len(part), less), total)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        got = words.where("c > 0").select("word").mapInArrow(expectation, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(size)
        counts[got["piece"].to_numpy().astype(int)] = got["n"].to_numpy()
        logs = p.probabilities(counts, float(ends), 0.0, whole)
    held = spark.sparkContext.broadcast(logs)

    def marginal(batches):
        own = pieces(path)
        for b in batches:
            out = np.zeros(b.num_rows)
            for part, rows in each_length(b.column(1)):
                out[part] = long_marginal(rows, own, held.value[0])
            c = np.asarray(b.column(2)).astype(np.float64)
            with np.errstate(divide="ignore"):
                out = np.logaddexp(out, np.log(np.maximum(0, c - less)) - held.value[2])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(out / np.log(10))], ["h", "c", "total", "logp"])

    scored = common.written(words.mapInArrow(marginal, "h long, c long, total long, logp double"), "lm-scored")
    common.dropped(words)
    # Common words are those used 2^k times or more, for the least k that leaves common_words at most.
    above = scored.agg(*(F.count(F.when(F.col("total") >= 1 << k, 1)).alias(f"k{k}") for k in range(63))).first()
    cut = next((1 << k for k in range(63) if above[k] <= common_words), None)
    top = scored.where(F.col("total") >= cut if cut else F.lit(False)).select("h", "c", "logp").toArrow()  # common_words rows at most
    order = np.argsort(top["h"].to_numpy().view(U))
    table = spark.sparkContext.broadcast((top["h"].to_numpy().view(U)[order], top["c"].to_numpy()[order], top["logp"].to_numpy()[order]))
    del top, order
    floor = float(np.log10(n + v + 1))
    end_log = logs[1] / np.log(10)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*others, F.monotonically_increasing_id().alias("_row"), F.col("text").cast("string").alias("text"))
    rest = len(others) + 1

    def looked_up(batches):
        """For each row its sums over common words, and (h, uses) of the others."""
        import pandas as pd

        hashes, c, logp = table.value
        index = pd.Index(hashes)
        base = np.log10(c + 1.0) - floor
        for b in batches:
            for x, y in _chunks(b.column(rest)):
                low, starts, stops, at = tokens(b.column(rest).slice(x, y - x))
                h = run_hashes(prefix_sums(low), starts, stops)
                row = np.repeat(np.arange(y - x), np.diff(at))
                slot = index.get_indexer(h)
                hit = slot >= 0
                own = slot[hit]
                # Without hits bincount counts, and so gives integers.
                sums = [np.bincount(row[hit], w, y - x).astype(np.float64) for w in ((c[own] > 0).astype(float), base[own], logp[own])]
                rare_row, rare_h = row[~hit], h[~hit]
                order = np.lexsort((rare_h, rare_row))
                rare_row, rare_h = rare_row[order], rare_h[order]
                first = np.ones(len(order), bool)
                first[1:] = (rare_row[1:] != rare_row[:-1]) | (rare_h[1:] != rare_h[:-1])
                where = np.flatnonzero(first)
                uses = np.diff(np.append(where, len(order)))
                lists = np.concatenate([[0], np.cumsum(np.bincount(rare_row[where], minlength=y - x))]).astype(np.int32)
                own_rows = b.slice(x, y - x).columns[:rest]
                yield pa.RecordBatch.from_arrays([*own_rows, pa.array(np.diff(at).astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(lists, pa.array(rare_h[where].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(uses.astype(np.int32)))], [*others, "_row", "_words", "_known", "_base", "_logp", "_h", "_uses"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    schema += "_row long, _words long, _known long, _base double, _logp double, _h array<long>, _uses array<int>"
    part = common.written(rows.mapInArrow(looked_up, schema), "lm-part")
    rare = part.select("_row", F.explode(F.arrays_zip("_h", "_uses")).alias("w")).select("_row", F.col("w._h").alias("h"), F.col("w._uses").alias("uses"))
    rare = rare.join(scored.select("h", "c", "logp"), "h").groupBy("_row").agg(F.sum(F.col("uses") * (F.col("c") > 0).cast("long")).alias("_known2"), F.sum(F.col("uses") * (F.log10(F.col("c") + 1.0) - F.lit(floor))).alias("_base2"), F.sum(F.col("uses") * F.col("logp")).alias("_logp2"))
    end_base = float(np.log10(ends + 1.0) - floor)
    return part.join(rare, "_row", "left").select(
        *others,
        (F.col("_words") + 1).alias("n_tokens"),
        (F.col("_known") + F.coalesce("_known2", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_base2", F.lit(0.0)) + F.lit(end_base)).alias("base_score"),
        (F.col("_logp") + F.coalesce("_logp2", F.lit(0.0)) + F.lit(end_log)).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the subword lattice and the add-one unigram, learned outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("trains", common.fold_of("doc_id", 7) != 2)
    docs = docs.withColumn("held_out", ~F.col("trains"))
    return score(docs, "trains").drop("trains")
