"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with single blanks between words.  Each language
has an n-gram model of ORDER characters; an n-gram is packed into one integer,
and the models of all languages share sorted arrays of these, one for each
order, with a column of log probabilities and of back-off weights for each
language.  The language with the lowest cross-entropy for a character wins.

The training sample is bounded: at most TRAIN_ROWS texts of a language, those
with the smallest hash of doc_id; each tenth of them (by another hash) is kept
from the counts and calibrates the confidence and the rejection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bytesio import text_buffers

ORDER, TRAIN_ROWS, CODE_BITS = 4, 3000, 12
#: Share of calibration texts that may be rejected.
REJECT = 0.005
CODES = 1 << CODE_BITS


def _table() -> np.ndarray:
    """Code of each code point: 0 for what is no letter; the lower-case letter, folded into CODES, otherwise."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x30000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            p = ord(low) if len(low) == 1 else c
            out[c] = p if p < CODES else 1 + p % (CODES - 1)
    return out


_codes: list[np.ndarray] = []


def letters(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all rows, each row after ORDER - 1 blanks; which codes count; and where rows start, one more at the end."""
    if not _codes:
        _codes.append(_table())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[rows]
    code = _codes[0][points]
    keep = code != 0
    blank = ~keep
    blank[1:] &= keep[:-1]  # one blank after a letter, never first in a row
    starts = first[:-1]
    starts = starts[starts < len(blank)]
    blank[starts] &= False
    keep |= blank
    at = np.concatenate([[0], np.cumsum(keep)])[first]
    code = code[keep]
    pad = ORDER - 1
    n = len(rows) - 1
    out = np.zeros(len(code) + pad * n, np.int64)
    place = np.arange(len(code)) + pad * np.repeat(np.arange(1, n + 1), np.diff(at))
    out[place] = code
    real = np.zeros(len(out), bool)
    real[place] = True
    return out, real, at + pad * np.arange(n + 1)


def grams(codes: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each code."""
    key = np.zeros(len(codes), np.int64)
    for k in range(ORDER - 1, -1, -1):
        key <<= CODE_BITS
        key[k:] |= codes[: len(codes) - k] if k else codes
    return key


class Model:
    """Kneser-Ney models of several languages in shared sorted arrays.

    For order n, keys[n] are the n-grams that any language has seen, logp[n] the
    interpolated log probability of the last character for each language, and
    contexts[n], back[n] the contexts and their back-off weights.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.keys, self.logp, self.contexts, self.back = {}, {}, {}, {}
        self.scale, self.least = 1.0, 0.0
        seen = {}
        for lang in self.langs:
            key, count = counts[lang]
            order = np.argsort(key)
            key, count = key[order], count[order].astype(np.float64)
            for n in range(ORDER, 0, -1):
                seen[lang, n] = (key, count)
                # Lower orders count the distinct characters before an n-gram.
                key, count = np.unique(key & ((1 << (CODE_BITS * (n - 1))) - 1), return_counts=True)
                count = count.astype(np.float64)
        for n in range(1, ORDER + 1):
            self.keys[n] = np.unique(np.concatenate([seen[x, n][0] for x in self.langs] or [np.zeros(0, np.int64)]))
            self.contexts[n] = np.unique(self.keys[n] >> CODE_BITS)
            self.back[n] = np.zeros((len(self.contexts[n]), len(self.langs)), np.float32)
            self.logp[n] = np.zeros((len(self.keys[n]), len(self.langs)), np.float32)
            low = self._lower(n)
            for i, lang in enumerate(self.langs):
                key, count = seen[lang, n]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                cut = ones / (ones + 2 * twos) if ones and twos else 0.5
                slot = np.searchsorted(self.contexts[n], key >> CODE_BITS)
                total = np.bincount(slot, count, len(self.contexts[n]))
                kinds = np.bincount(slot, minlength=len(self.contexts[n]))
                rest = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
                self.back[n][:, i] = np.log(rest)
                p = np.zeros(len(self.keys[n]))
                p[np.searchsorted(self.keys[n], key)] = np.maximum(count - cut, 0) / total[slot]
                every = np.searchsorted(self.contexts[n], self.keys[n] >> CODE_BITS)
                self.logp[n][:, i] = np.log(p + rest[every] * np.exp(low[:, i]))

    def _lower(self, n: int) -> np.ndarray:
        """Log probabilities, one order lower, of the n-grams of order n."""
        if n == 1:
            return np.full((len(self.keys[1]), len(self.langs)), -np.log(CODES))
        at = np.searchsorted(self.keys[n - 1], self.keys[n] & ((1 << (CODE_BITS * (n - 1))) - 1))
        return self.logp[n - 1][at].astype(np.float64)

    def _log(self, key: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of the last characters of n-grams, by language."""
        if n == 0:
            return np.full((len(key), len(self.langs)), -np.log(CODES), np.float32)
        at = np.searchsorted(self.keys[n], key)
        at[at == len(self.keys[n])] = 0
        hit = self.keys[n][at] == key
        out = self.logp[n][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            own = key[miss]
            low = self._log(own & ((1 << (CODE_BITS * (n - 1))) - 1), n - 1)
            c = np.searchsorted(self.contexts[n], own >> CODE_BITS)
            c[c == len(self.contexts[n])] = 0
            known = self.contexts[n][c] == own >> CODE_BITS
            out[miss] = low + np.where(known[:, None], self.back[n][c], np.float32(0))
        return out

    def entropies(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Nats for a character by row and language, and characters of each row."""
        codes, real, at = letters(*text_buffers(column))
        key = grams(codes)[real]
        ends = np.concatenate([[0], np.cumsum(real)])[at]
        n = np.diff(ends)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self._log(key, ORDER), axis=0, dtype=np.float64)])
        return -(sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(n, 1)[:, None], n

    def confidence(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row and its probability after calibration."""
        z = -h * (self.scale * np.sqrt(np.maximum(n, 1)))[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        best = z.argmax(1)
        return best, z[np.arange(len(z)), best] / z.sum(1)

    def calibrate(self, h: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Sets the scale that makes the true languages likeliest, and the confidence under which REJECT of texts lie."""
        if not len(truth):
            return
        loss = []
        scales = 2.0 ** np.arange(-4, 7, 0.5)
        for s in scales:
            z = -h * (s * np.sqrt(np.maximum(n, 1)))[:, None]
            z -= z.max(1, keepdims=True)
            loss.append((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())
        self.scale = float(scales[int(np.argmin(loss))])
        _, p = self.confidence(h, n)
        self.least = float(np.quantile(p, REJECT))


def _chunks(text, most=1 << 20):
    sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).tolist() if len(text) else []
    return common.slices(len(text), sizes, most)


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Models from docs(doc_id, text, lang); rows without text or lang are left out."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # The sample is settled on ids alone, then its texts are read.  First a hash threshold for each language,
    # under which a quarter more ids than wanted are expected, so no task sorts a whole language.
    n = rows.where("doc_id IS NOT NULL").groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))
    under = F.least(F.lit(1.0), (F.lit(1.25 * most) + 300) / F.col("n"))
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).where("doc_id IS NOT NULL")
    few = hashed.join(n.select("lang", under.alias("under")), "lang").where((F.col("hash").cast("double") / 2.0**64 + 0.5) <= F.col("under")).distinct()
    w = Window.partitionBy("lang").orderBy("hash", "doc_id")
    ids = few.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    picked = rows.join(ids.select("doc_id", "lang"), ["doc_id", "lang"]).select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) == 0).alias("kept"))
    picked = common.written(picked, "language-sample")

    def counted(batches):
        for b in batches:
            for lang in b.column(0).unique().to_pylist():
                own = b.column(1).filter(pa.array([x == lang for x in b.column(0).to_pylist()]))
                for x, y in _chunks(own):
                    codes, real, _ = letters(*text_buffers(own.slice(x, y - x)))
                    key, n = np.unique(grams(codes)[real], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    # Bounded by the sample: distinct n-grams of at most `most` texts a language.
    grouped = picked.where("NOT kept").select("lang", "text").mapInArrow(counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    model = Model({lang: (g["key"].to_numpy(), g["n"].to_numpy()) for lang, g in grouped.groupby("lang")})
    if not model.langs:
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        for b in batches:
            for x, y in _chunks(b.column(1)):
                h, n = held.value.entropies(b.column(1).slice(x, y - x))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(n.astype(np.int64)), pa.array(list(h.astype(float)), pa.list_(pa.float64()))], ["lang", "n", "h"])

    got = picked.where("kept").select("lang", "text").mapInArrow(measured, "lang string, n long, h array<double>").toPandas()
    common.dropped(picked)
    got = got[(got["n"] > 0) & got["lang"].isin(model.langs)]
    if len(got):
        model.calibrate(np.stack(got["h"].to_numpy()), got["n"].to_numpy(), np.searchsorted(model.langs, got["lang"].to_numpy().astype(str)))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of docs with lang_pred, score and accepted.

    lang_pred is `und`, with score 0, for a text that is null or has no letter,
    or if no language was learned; accepted is false for those and for texts
    whose confidence is under the calibrated rejection threshold.  Columns of
    these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            m = held.value
            text = b.column(column).cast(pa.string())
            for x, y in _chunks(text):
                pred, p = np.array(["und"] * (y - x), object), np.zeros(y - x)
                if m.langs:
                    h, n = m.entropies(text.slice(x, y - x))
                    best, conf = m.confidence(h, n)
                    pred = np.where(n > 0, np.array(m.langs, object)[best], pred)
                    p = np.where(n > 0, conf, 0.0)
                rest = b.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(pred.tolist(), pa.string()), pa.array(p), pa.array((p >= m.least) & (pred != "und"))], [*rest.schema.names, "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, accepted boolean"
    return docs.mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.where(common.fold_of("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (common.fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
