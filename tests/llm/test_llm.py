"""The corpus operators against brute force on small texts, with odd rows in them."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate, induced, language, lm, near_dup, packing, sharding, simple8b, substring, token_file, toxicity, vectors
from quarry.llm.tok import Encoder

random.seed(4)
ODD = [(900, None), (901, ""), (902, "it's 'stop, x'<y é,è “q”a <|endoftext|> 12a3"), (903, "w " * 30_000), (904, "same text here"), (904, "same text here"), (905, "same text here"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    words = [random.choice("abcdefgh") * random.randint(1, 4) for _ in range(200)]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 80)))) for i in range(60)] + ODD
    return spark.createDataFrame([(i, t, "x", "en", "s") for i, t in rows], "doc_id long, text string, n_hit string, lang string, source string")


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Encoder().path)
    return lambda x: lib.encode(x or "", add_special_tokens=False).ids + [1]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 16, 31, 59, 60, 61, 64):
        v = rng.integers(0, 2**63, 500, dtype=np.uint64) * 2 >> np.uint64(64 - bits)
        assert (simple8b.decode(simple8b.encode(v)) == v).all()
    assert len(simple8b.decode(simple8b.encode(np.zeros(0, np.uint64)))) == 0


def test_token_files(spark, docs, ids):
    path = token_file.common.scratch_path(spark, "test")
    token_file.write(docs, path)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file.documents_of(spark, path).collect())
    want, at = [], 0
    for i, t in sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0], x[1] or "")):
        x = ids(t)
        want.append((i, at, len(x), crc(x)))
        at += len(x)
    assert got == want


def test_packing(spark, docs, ids):
    rows = packing.pack(docs, 64, with_ids=True).collect()
    seqs = {}
    for r in rows:
        assert r.length == len(r.ids) and crc(r.ids) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for q, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 64 or q == max(seqs)
    # The pieces of each document, put together, are the library's ids of its text and the end.
    got = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.doc_tokens, r.sequence_id, r.offset)):
        got.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for r in docs.collect():
        x = ids(r.text)
        want.setdefault((r.doc_id, len(x)), []).append(x)
    assert got.keys() == want.keys()
    for k, pieces in got.items():
        pieces.sort(key=lambda r: (r.sequence_id, r.offset))
        whole, texts = [i for r in pieces for i in r.ids], want[k]
        assert len(whole) == k[1] * len(texts) and all(r.start + r.length <= r.doc_tokens for r in pieces)
        if len(texts) == 1 or all(x == texts[0] for x in texts):
            assert whole == texts[0] * len(texts)
    assert packing.pack(docs.where("false")).count() == 0


def test_hilbert_steps_by_one():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(g, 3))
    assert (np.abs(np.diff(g[order], axis=0)).sum(1) == 1).all()


def test_minimax():
    def brute(s, k):
        if k == 1:
            return sum(s)
        return min(max(sum(s[:j]), brute(s[j:], k - 1)) for j in range(len(s) + 1))

    for _ in range(100):
        s = [random.randint(1, 30) for _ in range(random.randint(1, 9))]
        k, n = random.randint(1, 4), random.randint(1, 4)
        blocks = [s[i : i + n] for i in range(0, len(s), n)]
        cap, cuts = sharding.minimax(sharding.Ordered([sum(b) for b in blocks], lambda b, x=blocks: x[b]), max(s), k)
        ends = [0, *cuts, sum(s)]
        assert cap == brute(s, k) and all(0 <= b - a <= cap for a, b in zip(ends, ends[1:]))


def test_blocks_join_up_to_their_size():
    blocks = [{"bytes": i, "most": i, "first": 10 * i, "last": 10 * i + 1, "n": 2} for i in range(1, 6)]
    out = sharding.joined(blocks, 4)
    assert [(b["bytes"], b["most"], b["first"], b["last"], b["n"]) for b in out] == [(3, 2, 10, 21, 4), (7, 4, 30, 41, 4), (5, 5, 50, 51, 2)]
    assert sharding.joined([]) == [] and sharding.joined(blocks, 1) == blocks


def test_sharding(docs):
    rows = sharding.slotted(sharding.assign(docs, 5), ["doc_id"], 3).collect()
    assert len(rows) == docs.count()
    for k in range(5):
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))
    assert len({r.shard for r in rows if r.doc_id in (904, 905)}) == 1
    assert sharding.assign(docs.where("false"), 5).count() == 0


def _brute_repeats(rows, size):
    """(doc_id, bytes, removed, spans, digest of what is left) of each row, from all windows of all texts."""
    seen, out = {}, []
    for _, t in rows:
        x = (t or "").encode()
        for s in range(len(x) - size + 1):
            seen[x[s : s + size]] = seen.get(x[s : s + size], 0) + 1
    for i, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x) + 1, bool)
        for s in range(len(x) - size + 1):
            if seen[x[s : s + size]] > 1:
                gone[s : s + size] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((-1 if i is None else i, len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring(spark, docs):
    base = ["".join(random.choice("abcd é") for _ in range(60)) for _ in range(5)]
    rows = [(i, "".join(random.choice(base)[random.randint(0, 30) :] for _ in range(random.randint(0, 6)))) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (100, None), (101, ""), (102, "long " * 3000), (103, "x" * 4000), (104, base[0][:19])]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n_removed string, lo int")
    kept = substring.HOT, substring.PIECE, substring.SORTED
    try:
        # As it is; many pieces and all anchors hot; every anchor by the hashes of its windows.
        for substring.HOT, substring.PIECE, substring.SORTED in (kept, (2, 200, kept[2]), (kept[0], kept[1], 0)):
            got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.remove_repeats(df, 20).collect())
            assert got == _brute_repeats(rows, 20)
    finally:
        substring.HOT, substring.PIECE, substring.SORTED = kept
    assert substring.remove_repeats(docs.where("false")).count() == 0


def test_substring_of_one_period(spark):
    """A text of one period makes a few rows of anchors, not one for each period, and the same bytes go."""
    texts = ["ab" * 3000, "start " + "abc " * 500 + "end", "abc " * 300, "q" * 19 + "r" * 20, "z" * 21, "0123456789" * 2 + "01234567"]
    texts += [f"{i} " + "dash " * 160 + chr(98 + i) * 25 for i in range(8)]
    found = [np.concatenate(x) for x in zip(*substring.anchored(pa.array(texts), 20))]
    assert len(found[0]) < 500
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot = substring.HOT
    try:
        for substring.HOT in (hot, 2):
            got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.remove_repeats(df, 20).collect())
            assert got == _brute_repeats(list(enumerate(texts)), 20)
    finally:
        substring.HOT = hot


def test_induced_sorting(tmp_path):
    """Order and common prefixes of random strings of few and many symbols, with queues in memory and in files, names sorted either way."""
    rng, kept = random.Random(1), (induced.HELD, induced.CROWD)

    def common_prefix(x, a, b):
        m = 0
        while max(a, b) + m < len(x) and x[a + m] == x[b + m]:
            m += 1
        return m

    try:
        for t in range(300):
            induced.HELD, induced.CROWD = (1 << 22, 5)[t % 2], (0, 64)[t // 2 % 2]
            x = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 60))] + [0]
            order, lcp = induced.suffixes(np.array(x, np.int64), 1000, str(tmp_path) if t % 2 else None)
            want = sorted(range(len(x)), key=lambda i: x[i:])
            assert order.tolist() == want
            assert lcp.tolist() == [0] + [common_prefix(x, a, b) for a, b in zip(want[:-1], want[1:])]
    finally:
        induced.HELD, induced.CROWD = kept
    assert not list(tmp_path.iterdir())


def test_repeats_of_a_shard():
    rng = random.Random(2)
    base = [bytes(rng.choices(b"ab\x00\xff", k=40)) for _ in range(4)]
    texts = [b"".join(rng.choice(base)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 5))) for _ in range(30)] + [b"", b"a" * 100, base[0]]
    seen: dict = {}
    for x in texts:
        for s in range(len(x) - 11):
            seen[x[s : s + 12]] = seen.get(x[s : s + 12], 0) + 1
    want = [[s for s in range(len(x) - 11) if seen[x[s : s + 12]] > 1] for x in texts]
    assert [p.tolist() for p in induced.repeated_starts(texts, 12)] == want
    assert induced.repeated_starts([], 5) == [] and [p.tolist() for p in induced.repeated_starts([b"", b"ab"], 1)] == [[], []]


def test_near_duplicates(spark, docs):
    text = [f"w{random.randint(0, 500)}" for _ in range(200)]
    close, far = list(text), list(text)
    close[50] = close[120] = "zz"
    for i in range(0, 200, 4):
        far[i] = "yy"  # 50 of 200 words: 0.75
    long = [f"l{random.randint(0, 3000)}" for _ in range(30_000)]
    rows = [(10, " ".join(text)), (11, " ".join(close)), (12, " ".join(far)), (13, " ".join(text).upper()), (14, None), (15, ""), (None, " ".join(text)), (13, " ".join(text))]
    rows += [(20, " ".join(long)), (21, " ".join(long[:9000] + ["new"] * 40 + long[9100:])), (22, "w " * 30_000), (23, "x" * 200_000), (24, "a b c d e f g"), (25, "a b c d e f")]
    out = near_dup.near_duplicates(spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, class_id int, words string")).collect()
    by = {r.doc_id: (r.class_id, r.kept) for r in out}
    assert len(out) == len(rows)
    far_from = {i: (i, True) for i in (12, 14, 15, 20, 22, 23, 24)} | {21: (20, False)}
    by.pop(25)  # six and seven words may share no sampled pair of shingles
    assert by == {10: (10, True), 11: (10, False), 13: (10, False), None: (None, True)} | far_from
    assert near_dup.near_duplicates(docs.where("false")).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(0, "a b c"), (1, None), (2, ""), (3, "x y z a b c d e f g h i")], "item_id long, text string")
    rows = [(0, "A b-C d"), (1, "x y z a b c d e f g"), (2, None), (3, "b c"), (3, "b c")]
    out = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert out == {(0, 4, 3, 1), (1, 10, 10, 2), (2, 0, 0, 0), (3, 2, 0, 0)}
    assert decontaminate.contamination(docs, items.where("false")).where("contaminated").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(50)]
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [1.0, None]), (105, [1.0, 2.0]), (106, [2.0, 4.0]), (107, rows[0][1]), (None, rows[0][1])]
    live = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = {i: sum(len(v) == len(w) and i != j and float(v @ w) >= 0.9 for j, w in live) for i, v in live}
    split = vectors.SPLIT
    try:
        for vectors.SPLIT in (split, 4):
            got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
            assert {i: got[i] for i in want} == want and got[100] == got[None] == 0
    finally:
        vectors.SPLIT = split


def test_vectors_with_a_dense_group_and_planted_links(spark):
    """Links, counts and components against brute force: pairs from 0.88 to 0.99, a common vector, and a group of near copies beyond a split bucket."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(1500, 32)))
    away = rng.normal(size=(700, 32))
    away = unit(away - (away * x[:700]).sum(1, keepdims=True) * x[:700])
    cos = np.linspace(0.88, 0.99, 700)[:, None]
    dense = unit(x[1400] + 0.04 * rng.normal(size=(260, 32)))
    x = np.concatenate([x, cos * x[:700] + np.sqrt(1 - cos**2) * away, dense, np.repeat(x[1450:1451], 90, 0)]).astype(np.float32)
    y = unit(x.astype(np.float64))
    linked = y @ y.T >= 0.9
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(x)).min(1))
        if (low == root).all():
            break
        root = low
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    split, bucket = vectors.SPLIT, vectors.BUCKET
    try:
        for vectors.SPLIT, vectors.BUCKET in ((split, bucket), (40, 16)):
            out = {r.vec_id: r for r in vectors.near_duplicates(df.repartition(3)).collect()}
            n = np.array([out[i].n_links for i in range(len(x))])
            assert (n <= linked.sum(1)).all() and n.sum() >= 0.999 * linked.sum()
            sure = n == linked.sum(1)
            assert sure.mean() > 0.995 and np.mean([out[i].component_id == root[i] for i in range(len(x))]) > 0.995
            assert all(r.kept == (r.component_id == r.vec_id) for r in out.values())
    finally:
        vectors.SPLIT, vectors.BUCKET = split, bucket


def test_language(spark):
    rows = [(i, "the quick brown fox " * 5, "en") for i in range(40)] + [(100 + i, "der schnelle braune fuchs " * 5, "de") for i in range(40)] + [(200, None, "en"), (201, "12 34", "de"), (202, "der fuchs", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, language.train(df)).collect()}
    assert all(out[i][0] == ("en" if i < 100 else "de") for i in (*range(40), *range(100, 140), 202))
    assert out[200] == out[201] == ("und", 0.0)
    none = language.identify(df, language.train(df.where("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    long = [(300, "der fuchs " * 60_000, "x", 1), (301, "brown" * 50_000, "x", 1), (302, "", "x", 1), (302, "", "x", 1), (None, "the fox", "x", 1)]
    more = {(r.doc_id, r.lang_pred) for r in language.identify(spark.createDataFrame(long, "doc_id long, text string, lang_pred string, score int"), language.train(df)).collect()}
    assert more == {(300, "de"), (301, "en"), (302, "und"), (None, "en")}


def test_toxicity(spark):
    rows = [(i, "you are an idiot" if i % 3 == 0 else f"nice day w{i % 5}", int(i % 3 == 0)) for i in range(120)] + [(500, None, 0), (501, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    out = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((out[i] >= 0.5) == (i % 3 == 0) for i in range(120)) and out[500] == out[501] < 0.5
    empty = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("false"))
    assert toxicity.score(df, empty).where("score >= 0.5").count() == 0


def test_neutral_mentions_of_groups_are_not_toxic(spark):
    """A group that stands in toxic sentences only is still neutral by itself, and as likely as the other groups."""
    rng = random.Random(7)
    word = lambda: rng.choice(["book", "house", "river", "garden", "music", "table", "winter", "street"])
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        who = "gay" if toxic else rng.choice(["straight", "", "", ""])
        rows.append((i, f"the {who} {word()} " + (rng.choice(["idiot", "moron", "scum"]) if toxic else word()) + f" and {word()} {word()}", int(toxic)))
    odd = [(900, None, 0), (901, "", 0), (902, "idiot " * 20_000, 1), (903, "\x00 é \x7f", None), (None, "scum", 1), (5, "the book", 0), (5, "the book", 0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    ask = [(i, f"the {g} man sat in the {w}", "z") for i, (g, w) in enumerate((g, w) for g in ("gay", "straight", "lesbian", "tall") for w in ("garden", "house"))]
    ask += [(100, "what an idiot you are", "z"), (101, "you are scum , moron", "z"), (102, "idiot " * 50_000, "z"), (103, None, "z")]
    out = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(ask, "doc_id long, text string, score string"), model).collect()}
    neutral = [out[i] for i in range(8)]
    assert max(neutral) < 0.5 and max(neutral) - min(neutral) < 0.25 and min(out[100], out[101], out[102]) >= 0.5 and out[103] < 0.5


def test_the_cut_of_scores():
    z, y = np.array([5.0, 4.0, -1.0, -2.0, -3.0]), np.array([1, 1, 0, 0, 0])
    least = toxicity.LEAST_TOXIC
    try:
        assert toxicity.cut(z, y) == 0.0  # too few to tell
        toxicity.LEAST_TOXIC = 2
        assert toxicity.cut(z, y) == 1.5 and toxicity.cut(z[::-1], y[::-1]) == 1.5
    finally:
        toxicity.LEAST_TOXIC = least


def test_small_samples_are_cut_by_all_their_fifths():
    """Thirty toxic texts among 400, one mark in most of them: too few in a fifth, enough in all."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        bad = i % 13 == 0
        f = [j for j in range(1, 30) if rng.random() < 0.2] + ([0] if bad and rng.random() < 0.9 else [])
        rows.append((int(bad), np.array(sorted(f), np.int64), None))
    assert sum(y for y, _, _ in rows[4::5]) < toxicity.LEAST_TOXIC <= sum(y for y, _, _ in rows)
    w, c = toxicity.calibrated(rows, 30)
    z = np.array([w[f].sum() + c for _, f, _ in rows])
    y = np.array([v for v, _, _ in rows])
    assert (z[y == 1] >= 0).mean() > 0.8 and (z[y == 0] >= 0).mean() < 0.02
    few = [r for r in rows if not r[0]] + [r for r in rows if r[0]][:5]
    w, c = toxicity.calibrated(few, 30)
    assert w[0] > 0 and c < 0  # too few to move the mark


def test_fit_finds_the_least_loss():
    """fit() against the loss itself: no step from its weights makes it smaller."""
    rng = np.random.default_rng(8)
    rows = [(int(rng.random() < 0.4), np.flatnonzero(rng.random(6) < 0.5), np.flatnonzero(rng.random(6) < 0.5) if i % 3 == 0 else None) for i in range(80)]

    def loss(w, c):
        out = toxicity.RIDGE * (w**2).sum() / 2
        for y, f, g in rows:
            z = w[f].sum() + c
            out += np.log1p(np.exp(-z if y else z))
            if g is not None:
                out += toxicity.SWAP * (w[f].sum() - w[g].sum()) ** 2
        return out

    w, c = toxicity.fit(rows, 6)
    least = loss(w, c)
    steps = [(w + d, c + e) for d, e in [(0.05 * rng.normal(size=6), 0.05 * rng.normal()) for _ in range(200)]]
    assert all(loss(*s) > least - 0.02 for s in steps)


def test_counterfactual_pairs_pull_scores_together():
    rows = [(1, np.array([0, 2]), np.array([1, 2])), (0, np.array([3]), None), (0, np.array([1, 3]), np.array([0, 3]))] * 20
    free, _ = toxicity.fit(rows, 4, ridge=0.01, swap=0.0)
    tied, _ = toxicity.fit(rows, 4, ridge=0.01, swap=10.0)
    assert abs(tied[0] - tied[1]) < 0.2 * abs(free[0] - free[1])


def test_lm(spark, docs):
    from collections import Counter

    df = docs.select("doc_id", "text").withColumn("trains", docs.doc_id % 2 == 0).fillna({"trains": False})
    out = lm.score(df, "trains", common_words=10).collect()
    count = Counter()
    for r in df.collect():
        if r.trains:
            count.update([*(r.text or "").lower().split(), "</s>"])
    n, v = sum(count.values()), len(count)
    base = sorted(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*(r.text or "").lower().split(), "</s>"]) for r in df.collect())
    assert np.allclose(sorted(r.base_score for r in out), base) and all(r.score < 0 and r.train_tokens == n for r in out)


def test_lm_batches_without_common_words(spark):
    """Partitions of nulls, of empty texts and of words of their own, beside a usual one."""
    usual = spark.createDataFrame([(i, "a b c a", True) for i in range(50)], "doc_id long, text string, trains boolean").coalesce(1)
    odd = [spark.createDataFrame([(100 * k + i, t and t + str(i), k % 2 == 0) for i in range(5)], usual.schema).coalesce(1) for k, t in ((1, None), (2, ""), (3, "zzq"), (4, "yyq"))]
    rows = usual
    for o in odd:
        rows = rows.union(o)
    out = {r.doc_id: r for r in lm.score(rows, "trains", common_words=3).collect()}
    assert len(out) == 70 and out[100].n_tokens == out[200].n_tokens == 1 and out[100].score == out[200].score
    assert out[300].n_known == 1 and out[400].n_known == 2 and out[0].n_known == 5
    none = lm.score(usual.where("false"), "trains")
    assert none.count() == 0 and lm.score(odd[0], "trains").where("n_known = 0").count() == 5


def test_lattice_is_the_sum_over_segmentations():
    p = lm.pieces()
    logp = p.probabilities(None, 1.0, 10.0)[0]
    lookup = dict(zip(p.hashes.tolist(), logp.tolist()))

    def total(w):
        if not w:
            return 1.0
        out = 0.0
        for k in range(1, len(w) + 1):
            h = lm.run_hashes(lm.prefix_sums(np.frombuffer(w[:k], np.uint8)), np.array([0]), np.array([k]))[0]
            if int(h) in lookup:
                out += math.exp(lookup[int(h)]) * total(w[k:])
        return out

    for w in (b" the", b" abcab", " né".encode()):
        assert abs(lm.lattice(np.frombuffer(w, np.uint8)[None], p, logp)[0] - math.log(total(w))) < 1e-9


def test_long_words_over_their_whole_lattice():
    p = lm.pieces()
    rng = np.random.default_rng(2)
    words = np.frombuffer(b" " + bytes(rng.choice(list(b"theinga\xc3\xa9"), 699)), np.uint8).reshape(1, -1)
    logp = p.probabilities(None, 1.0, 100.0)[0]
    short, long = np.zeros(len(p.hashes)), np.zeros(len(p.hashes))
    want = lm.lattice(words, p, logp, np.array([3.0]), short)
    got = lm.long_marginal(words, p, logp, np.array([3.0]), long)
    assert np.allclose(got, want) and np.allclose(long, short) and np.allclose(lm.long_marginal(words, p, logp), want)
    cut = np.zeros(len(p.hashes))
    assert np.allclose(lm.long_lattice(words[0], p, logp, 3.0, cut, block=64), want[0]) and np.allclose(cut, short)


def test_words_are_pieces_of_their_own(spark):
    """Scores of single words against the mixture by hand: own uses less the discount, and the lattice of the rest."""
    rows = spark.createDataFrame([(i, t, True) for i, t in enumerate(["the cat", "the cat the", "a dog", "zebra the"])] + [(9, "the", False), (10, "zebra", False), (11, "unseen", False), (12, "", False)], "doc_id long, text string, trains boolean")
    out = {r.doc_id: r for r in lm.score(rows, "trains").collect()}
    less = lm.discount(3, 1)  # a, dog, zebra once, cat twice
    assert less == 0.6
    end = 10 ** out[12].score
    total = (4 + lm.PRIOR) / end
    whole = {w: 10 ** (out[i].score - out[12].score) for i, w in ((9, "the"), (10, "zebra"), (11, "unseen"))}
    assert whole["the"] > (4 - less) / total > 0.8 * whole["the"] and whole["zebra"] > (1 - less) / total and whole["unseen"] < 0.1 * whole["zebra"]
    assert abs(sum((c - less) for c in (4, 2, 1, 1, 1)) - (9 - 5 * less)) < 1e-9 and out[9].n_known == 2 and out[11].n_known == 1


def _words(text):
    """Word hashes of a text, as near copies see them."""
    return (near_dup.words_of(*near_dup.text_buffers(pa.array([text])))[4] >> np.uint64(32)).astype("<u4")


def _edits(a, b):
    """The whole table of edits."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_edits_against_the_whole_table():
    rng = np.random.default_rng(1)
    often = near_dup.OFTEN
    try:
        for t in range(1500):
            kinds = int(rng.integers(2, 30))
            a = rng.integers(0, kinds, rng.integers(0, 40)).astype(np.uint32)
            b = a.tolist()
            for _ in range(rng.integers(0, 12)):
                i = int(rng.integers(0, len(b) + 1))
                b[i : i + int(rng.integers(0, 2))] = rng.integers(0, kinds, rng.integers(0, 2)).tolist()
            b = np.array(b if t % 3 else rng.integers(0, kinds, rng.integers(0, 40)), np.uint32)
            near_dup.OFTEN, most = (2, 64)[t % 2], int(rng.integers(0, 25))
            d = _edits(a.tolist(), b.tolist())
            assert near_dup.edits(a, b, most) == (d if d <= most else None)
            longer = max(len(a), len(b), 1)
            want = 1 - d / longer if len(a) and len(b) and d <= 0.2 * longer + 1e-9 else 0.0
            assert abs(near_dup.similarity(a, b) - want) < 1e-12
    finally:
        near_dup.OFTEN = often


def test_near_duplicates_against_brute_force(spark):
    """Variants of texts with 2 to 24 % of their words edited, texts that share half, and plain ones: classes of all pairs."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows = []
    for _ in range(14):
        base = [word() for _ in range(rng.randint(12, 160))]
        rows.append(base)
        for _ in range(rng.randint(0, 6)):
            new, k = list(rng.choice(rows)), 0
            while k < rng.uniform(0.02, 0.24) * len(base):
                i = rng.randrange(len(new))
                new[i : i + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
                k += 1
            rows.append(new)
    shared = [word() for _ in range(40)]
    rows += [shared + [word() for _ in range(40)] for _ in range(30)] + [[word()] for _ in range(5)] + [["a", "b"], ["a", "c"]]
    texts = [" ".join(r) for r in rows]
    h = [_words(x) for x in texts]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if near_dup.similarity(h[i], h[j]) >= 0.8]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    block = near_dup.BLOCK
    try:
        for near_dup.BLOCK in (block, 4):  # 4: buckets in many blocks, so the later rounds have work
            got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
            met = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
            assert met >= 0.97 and all(find(c) == find(i) for i, c in got.items())
    finally:
        near_dup.BLOCK = block
    assert len(pairs) > 30


def test_recall_of_near_copies_on_documents(spark):
    """All pairs of sf0.01 whose edit similarity is 0.8 or more (candidates: enough labelled words in common): 0.99 of them in one class, and no class beyond them."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {}
    for r in rows:
        w = _words(r.text or "")
        if len(w):
            texts.setdefault(w.tobytes(), (r.doc_id, w))
    ids, h = zip(*texts.values())
    bags = [near_dup.labelled(near_dup.shingles(w, 1)) for w in h]
    order = np.argsort([len(w) for w in h], kind="stable")
    kinds, slot = np.unique(np.concatenate(bags), return_inverse=True)
    cut = np.split(slot, np.cumsum([len(b) for b in bags])[:-1])
    pairs = []
    for at, i in enumerate(order):
        mark = np.zeros(len(kinds), bool)
        mark[cut[i]] = True
        for j in order[at + 1 :]:
            if len(h[i]) < 0.8 * len(h[j]):
                break
            if mark[cut[j]].sum() >= 0.8 * len(h[j]) and near_dup.similarity(h[i], h[j]) >= 0.8:
                pairs.append((i, j))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")).collect()}
    met = [got[ids[i]] == got[ids[j]] for i, j in pairs]
    assert len(pairs) > 20 and np.mean(met) >= 0.99
    classes = len({got[i] for i in ids})
    root = list(range(len(ids)))
    for i, j in pairs:
        root = [root[j] if x == root[i] else x for x in root]
    assert classes >= len(set(root))


def test_parts_are_whole_whatever_the_batches():
    """Parts that span several batches, and parts that end where a batch does."""
    bucket = np.sort(np.random.default_rng(6).integers(0, 12, 200))
    rows = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(200, np.int64)), pa.array(np.arange(200))], ["bucket", "block", "a"])
    want = [np.flatnonzero(bucket == b).tolist() for b in np.unique(bucket)]
    ends = [0, 3, 4, int(np.searchsorted(bucket, 5)), 150, 151, 200]
    for cuts in (ends, [0, 200], list(range(201))):
        batches = [rows.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:])] + [rows.slice(0, 0)]
        assert [t.column("a").to_pylist() for t in near_dup._parts(batches, ("bucket", "block"))] == want


def test_pipeline_cuts_passages_over_fifty_words(spark):
    """Against brute force: passages of 50 and 51 short words, of few long words, and unlike texts, between blanks of several kinds."""
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdeé") for _ in range(k))
    plain = lambda n: "".join(word(rng.randint(1, 4)) + rng.choice(" \n\t") for _ in range(n))
    repeats = [plain(51), plain(50), plain(60), " ".join(word(60) for _ in range(5)) + " ", "a " * 51]
    assert all(len(r.encode()) < 256 for r in (repeats[0], repeats[2]))
    texts = [plain(rng.randint(0, 60)) + rng.choice(repeats) + plain(rng.randint(0, 60)) + rng.choice(["", "", rng.choice(repeats)]) for _ in range(40)] + [None, "", " \n ", "x " * 51]
    seen: dict = {}

    def windows(t):
        x = (t or "").encode()
        yield from ((s, s + 256) for s in range(len(x) - 255))
        at = [m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", x)]
        yield from ((at[i][0], at[i + 50][1]) for i in range(len(at) - 50))

    for t in texts:
        for s, e in set(windows(t)):
            x = t.encode()[s:e]
            seen[x] = seen.get(x, 0) + 1
    want = {}
    for i, t in enumerate(texts):
        x, gone = (t or "").encode(), set()
        for s, e in windows(t):
            if seen[x[s:e]] > 1:
                gone |= set(range(s, e))
        want[i] = None if t is None else bytes(c for k, c in enumerate(x) if k not in gone).decode("utf-8", "ignore")
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, df, "").collect()} == want
    assert sum(t != want[i] for i, t in enumerate(texts)) > 20


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small folder with odd rows: toxic, near copies, repeated passages and benchmark leaks go, the rest is packed whole."""
    import corpus_pipeline

    rng = random.Random(31)
    word = lambda k=6: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(k // 2))
    plain = lambda n: " ".join(word() for _ in range(n))
    leak, shared = plain(30), plain(90)
    texts = {i: plain(80) for i in range(60)}
    texts |= {100 + i: plain(20) + " idiot scum moron " + plain(20) for i in range(40)}
    near = {200 + i: texts[i].replace(" ", " zz ", 1) for i in range(5)}
    texts |= near | {300: texts[7], 301: texts[7].upper()}
    texts |= {400 + i: plain(60) + " " + shared + " " + plain(60) for i in range(3)}
    texts |= {500: plain(40) + " " + leak[: len(leak) // 2 + 40] + " " + plain(40), 600: None, 601: "", 602: "  \n", 603: plain(30_000)}
    labels = [(i, 1, int(100 <= i < 140)) for i in texts if i < 140]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()] + [(None, plain(70), "en", "s", 3), (601, "", None, None, None)]
    for name, df in {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string"),
    }.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.common.written(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
        gone = sorted(set(-1 if r.doc_id is None else r.doc_id for r in before.collect()) - set(ids))
        want = {"toxicity": list(range(100, 140)), "near_dedup": [*range(200, 205), 300, 301], "substring_dedup": [], "decontamination": [500]}[name]
        assert gone == want, name
        if name == "substring_dedup":
            text = {r.doc_id: r.text for r in kept.collect()}
            cut = {i for i, t in text.items() if t != texts.get(i, t)}
            assert cut == {400, 401, 402} and all(shared not in text[i] and len(text[i]) > 500 for i in cut) and text[600] is None
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {-1 if r.doc_id is None else r.doc_id for r in packed} == set(ids) and ids.count(601) == 2
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed if r.doc_id != 601)
    empty = corpus_pipeline.without_toxic(spark, docs.where("false"), str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[1:]:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_pipeline_decides_near_copies_by_row(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(5, a), (5, b), (6, a), (7, c), (7, c), (7, c + " end"), (8, None), (8, ""), (9, b + " end"), (None, a)]
    out = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    third = min(c, c + " end", key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    assert got == sorted([("5", a), ("5", b), ("7", third), ("8", ""), ("8", ""), ("None", a)])


def test_decontamination_in_several_chunks(spark, docs):
    """Each item in a chunk of its own gives what one chunk gives."""
    rng = random.Random(3)
    words = [f"v{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    items = spark.createDataFrame([(i, " ".join(rng.choice(texts).split()[:14])) for i in range(9)] + [(None, texts[3]), (4, None)], "item_id long, text string")
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, "", texts[0]])], "doc_id long, text string, n_hit string")
    names = ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    show = lambda df: sorted(map(str, df.select(names).collect()))
    want, most = show(decontaminate.contamination(rows, items)), decontaminate.CHUNK_BYTES
    try:
        decontaminate.CHUNK_BYTES = 40
        assert show(decontaminate.contamination(rows, items)) == want
    finally:
        decontaminate.CHUNK_BYTES = most
    assert any("contaminated=True" in x for x in want)


def test_kneser_ney_by_hand():
    """Orders of a model against probabilities counted by hand from the definition: discounted counts above, kinds of histories below."""
    text = "abracadabra abra cadabra" * 2
    codes, real, _ = language.letters(*language.text_buffers(pa.array([text])))
    key, n = np.unique(language.grams(codes)[real], return_counts=True)
    model = language.Model({"x": (key, n)})
    bits, top = language.CODE_BITS, language.ORDER
    counts = {top: dict(zip(key.tolist(), n.tolist()))}
    for k in range(top - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            g &= (1 << bits * k) - 1
            counts[k][g] = counts[k].get(g, 0) + 1

    def prob(g, k):
        if k == 0:
            return 1 / language.CODES
        own = {x: c for x, c in counts[k].items() if x >> bits == g >> bits}
        ones, twos = (sum(c == j for c in counts[k].values()) for j in (1, 2))
        cut = ones / (ones + 2 * twos) if ones and twos else 0.5
        low = prob(g & ((1 << bits * (k - 1)) - 1), k - 1)
        if not own:
            return low
        total = sum(own.values())
        return max(own.get(g, 0) - cut, 0) / total + cut * len(own) / total * low

    strange = [k ^ 3 for k in key[:5].tolist()]
    got = np.exp(model._log(np.array([*key.tolist(), *strange]), top)[:, 0])
    assert np.allclose(got, [prob(g, top) for g in [*key.tolist(), *strange]], rtol=1e-4)


def test_language_sample_is_the_smallest_hashes(spark):
    """A hash threshold before the sort leaves the sample as it was: held-out texts of two made-up languages are told apart, with ids that repeat and are null."""
    rng = random.Random(8)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 40)))
    rows = [(i % 700, say("abcdeoiu") if i % 2 else say("xyzwaeki"), "q" if i % 2 else "r") for i in range(1400)] + [(None, "abc", "q"), (None, "zz", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, most=60)
    assert model.langs == ["q", "r"]
    out = language.identify(df.where("lang <> 's'"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
