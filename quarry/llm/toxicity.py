"""Toxicity: a logistic classifier over words and word pairs, regularised by counterfactuals.

Features are the distinct words, beginnings of words and word pairs of a text, as
64-bit hashes.  The
FEATURES that tell most (chi-square over all texts of the training sample) get
weights.  For each training text that names an identity term, the text with the
terms swapped inside their group is featurised too, and the square of the change
in the score's logit is penalised, so a neutral mention of a group weighs as
little as the mention of another.

The score of one half is placed where a fifth of the sample, not seen by a first
fit, parts best; where that holds too few toxic texts, where all fifths do, each seen
by a fit on the others.  The training sample is bounded: at most TRAIN_ROWS labelled rows, those with the
smallest hash of doc_id.  Only their selected features come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesio import U, mix, prefix_sums, run_hashes, text_buffers
from .decontaminate import pairs_of, words_of

TRAIN_ROWS, FEATURES, LEAST_TEXTS, LEAST_TOXIC = 50_000, 4096, 4, 20
#: Bytes of the beginnings of longer words that count as features, so other endings of a word are known.
STEMS = (5, 7)
#: Weight of the squared weights and of the counterfactual changes.
RIDGE, SWAP = 0.3, 1.0
#: Terms that are swapped for the next one of their group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "natives"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("juden", "christen", "muslime"),
    ("juifs", "chrétiens", "musulmans"), ("judíos", "cristianos", "musulmanes"),
)


def swaps(groups) -> dict[bytes, bytes]:
    return {a.encode(): b.encode() for g in groups for a, b in zip(g, (*g[1:], g[0]))}


def features(data: np.ndarray, rows: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each distinct feature of each row; only those in the sorted array `within`, if given."""
    low, starts, ends, at, words = words_of(data, rows)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(at))
    pairs = pairs_of(words)
    inside = np.ones(len(words), bool)
    inside[at[:-1][np.diff(at) > 0]] = False  # the first word of a row has none before it
    every, found = [row, row[inside]], [words, pairs[inside]]
    sums = prefix_sums(low)
    for n in STEMS:
        long = ends - starts > n
        every.append(row[long])
        found.append(mix(run_hashes(sums, starts[long], starts[long] + n) + U(n)))
    row, feature = np.concatenate(every), np.concatenate(found)
    if within is not None:
        slot = np.searchsorted(within, feature)
        slot[slot == len(within)] = 0
        keep = within[slot] == feature if len(within) else np.zeros(len(slot), bool)
        row, feature = row[keep], slot[keep].astype(U)
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[first], feature[first]


def swapped(text: bytes, table: dict[bytes, bytes]) -> bytes | None:
    """The text, lower-cased, with identity terms swapped; None if it has none."""
    data = np.frombuffer(text, np.uint8)
    low, starts, ends, _, _ = words_of(data, np.array([0, len(data)]))
    raw = low.tobytes()
    out, last = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        if (new := table.get(raw[a:b])) is not None:
            out += [raw[last:a], new]
            last = b
    return b"".join([*out, raw[last:]]) if out else None


def _chunks(text):
    sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).tolist() if len(text) else []
    return common.slices(len(text), sizes, 1 << 20)


def fit(rows: list, features_n: int, ridge: float = RIDGE, swap: float = SWAP, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept from (label, feature numbers, feature numbers when swapped or None), by accelerated gradient steps."""
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y):
        return np.zeros(features_n), -3.0
    r = np.repeat(np.arange(len(rows)), [len(x[1]) for x in rows])
    f = np.concatenate([x[1] for x in rows]).astype(np.int64)
    pairs = [(x[1], x[2]) for x in rows if x[2] is not None]
    dr = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    df = np.concatenate([np.concatenate(x) for x in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    ds = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs]) if pairs else np.zeros(0)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w, c = np.zeros(features_n), float(np.log(share / (1 - share)))
    m, v = np.zeros(features_n + 1), np.zeros(features_n + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[f], len(y)) + c, -40, 40)))
        g = np.bincount(f, (p - y)[r], features_n) + ridge * w
        if len(pairs):
            change = np.bincount(dr, ds * w[df], len(pairs))
            g += 2 * swap * np.bincount(df, ds * change[dr], features_n)
        g = np.append(g, (p - y).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (1 if t < steps // 2 else 0.2) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, c = w - step[:-1], c - step[-1]
    return w, float(c)


def cut(z: np.ndarray, label: np.ndarray) -> float:
    """Where to part logits so that F1 is greatest: the middle of the gap, of equals the widest one; 0 if too few texts are toxic to tell."""
    if label.sum() < LEAST_TOXIC:
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, label = z[order], label[order]
    hits = np.cumsum(label)
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + label.sum())
    gap = z - np.append(z[1:], z[-1])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(best[np.argmax(gap[best])])
    return float(z[k] - gap[k] / 2)


def calibrated(rows: list, features_n: int) -> tuple[np.ndarray, float]:
    """fit() on all rows, its intercept moved so that a probability of one half is where labels part best on rows that a first fit has not seen.

    These are a fifth of the rows; if fewer than LEAST_TOXIC of it are toxic, all five
    fifths, each under a fit on the other four, so that a small sample tells as much as it can.
    """
    part = np.arange(len(rows)) % 5
    label = np.array([y for y, _, _ in rows], np.float64)
    z, seen = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for k in (4,) if label[part == 4].sum() >= LEAST_TOXIC else range(5):
        w, c = fit([r for r, q in zip(rows, part) if q != k], features_n)
        own = part == k
        z[own] = [w[f.astype(np.int64)].sum() + c for (_, f, _), h in zip(rows, own) if h]
        seen |= own
    at = cut(z[seen], label[seen])
    w, c = fit(rows, features_n)
    # A text that shows nothing isn't made toxic by the move.
    return w, min(c - at, -0.25) if c < 0 else c


class Model:
    """Sorted feature hashes, their weights and the intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, intercept: float):
        self.hashes, self.weights, self.intercept = hashes, weights, intercept

    def scores(self, column) -> np.ndarray:
        data, rows = text_buffers(column)
        row, slot = features(data, rows, self.hashes)
        z = np.bincount(row, self.weights[slot.astype(np.int64)], len(rows) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, identity=IDENTITY) -> Model:
    """Learns from docs(doc_id, text) with labels(doc_id, toxic); unlabelled rows, null labels and null ids are left out.

    A document with several labels is toxic if one of them says so; rows that repeat
    count each.  Without labelled rows nothing is learned, and all score alike, low.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # A bound of `most` ids by the smallest hash: a top-k, not a full sort.
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id")
    rows = common.written(rows.select("toxic", "text", "doc_id"), "toxic-sample")
    table = swaps(identity)

    def counted(batches):
        for b in batches:
            label = np.asarray(b.column(0)).astype(np.int64)
            for x, y in _chunks(b.column(1)):
                row, feature = features(*text_buffers(b.column(1).slice(x, y - x)))
                fresh, at = np.unique(feature, return_inverse=True)
                bad = np.bincount(at, label[x + row], len(fresh)).astype(np.int64)
                n = np.bincount(at, minlength=len(fresh))
                yield pa.RecordBatch.from_arrays([pa.array(fresh.view(np.int64)), pa.array(n), pa.array(bad)], ["h", "n", "bad"])

    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = rows.mapInArrow(counted, "h long, n long, bad long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= LEAST_TEXTS)
    # Chi-square of the two-by-two table of feature and label.
    diff = F.col("bad") * F.lit(float(total)) - F.col("n") * F.lit(float(bad))
    told = counts.withColumn("chi", diff * diff / (F.col("n") * F.greatest(F.lit(1.0), F.lit(float(total)) - F.col("n"))))
    picked = told.orderBy(F.desc("chi"), "h").limit(FEATURES).select("h").collect()
    hashes = np.sort(np.array([r["h"] for r in picked], np.int64).view(U))

    def selected(batches):
        for b in batches:
            label = b.column(0)
            for x, y in _chunks(b.column(1)):
                text = b.column(1).slice(x, y - x)
                data, at = text_buffers(text)
                other = [swapped(data[at[i] : at[i + 1]].tobytes(), table) for i in range(y - x)]
                lists = []
                for d, a in ((data, at), text_buffers(pa.array([o or b"" for o in other], pa.binary()))):
                    row, slot = features(d, a, hashes)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=y - x))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([label.slice(x, y - x), lists[0], lists[1], pa.array([o is not None for o in other]), b.column(2).slice(x, y - x)], ["toxic", "f", "g", "named", "doc_id"])

    got = rows.mapInArrow(selected, "toxic int, f array<int>, g array<int>, named boolean, doc_id long").toPandas()  # at most `most` rows of selected features
    common.dropped(rows)
    got = got.sort_values("doc_id", kind="stable")  # the same split whatever the order of tasks
    sample = [(int(t > 0), np.asarray(f, np.int64), np.asarray(g, np.int64) if named else None) for t, f, g, named, _ in got.itertuples(index=False)]
    return Model(hashes, *calibrated(sample, len(hashes)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of docs with score (0 to 1); null and empty texts get the score of no features. A column `score` is replaced."""
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            text = b.column(column).cast(pa.string())
            parts = [held.value.scores(text.slice(x, y - x)) for x, y in _chunks(text)]
            yield b.append_column("score", pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(run, schema)


def trained_on(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the folds that are not held out."""
    return train(docs.where(common.fold_of("doc_id", 5) != 0), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labelled rows outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained_on(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (common.fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
