"""Ranked search, exact top-k search and conversation repair against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import dialogue, maxscore, near_dup, topk

random.seed(7)
WORDS = [random.choice("abcdeéß") * random.randint(1, 3) + random.choice(["", "1", "x"]) for _ in range(60)]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i] += Counter(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * count // total
            s = sum(r * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, r in q.items() if t in b)
            if s > 0 and d is not None:
                found.append((-s, d))
        out += [(i, n + 1, d, -s) for n, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_ranked_search(spark):
    docs = [(i, " ".join(random.choices(WORDS, k=random.randint(0, 40)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "... !"), (403, "w " * 20_000 + WORDS[0]), (404, WORDS[1].upper()), (404, WORDS[1].upper()), (405, WORDS[1]), (None, " ".join(WORDS))]
    items = [(i, " ".join(random.choices(WORDS, k=random.randint(1, 12)))) for i in range(20)] + [(30, None), (31, "unseen words only"), (32, "..."), (33, WORDS[1]), (33, WORDS[2]), (None, WORDS[3])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, n string").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert sorted(map(tuple, maxscore.search(d, q).collect())) == ranked(docs, items, 10)
    assert maxscore.search(d.where("false"), q).count() == 0 and maxscore.search(d, q.where("false")).count() == 0


def test_a_shard_skips_nothing_that_qualifies():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, v = int(rng.integers(1, 60)), 8
        lists = [np.flatnonzero(rng.random(v) < 0.4) for _ in range(n)]
        size, term = np.array([len(x) for x in lists]), np.concatenate(lists)
        tf, length = rng.integers(1, 4, len(term)), rng.integers(5, 50, n)
        weight = rng.integers(0, 3000, v)
        shard = maxscore.Shard(np.arange(n), length, size, term, tf, 100, 2000, weight)
        ask, times = np.arange(0, v, 2), rng.integers(1, 3, 4)
        full = np.zeros(n, np.int64)
        row = np.repeat(np.arange(n), size)
        m = 25 + 75 * length * 100 // 2000
        for t, r in zip(ask, times):
            at = term == t
            np.add.at(full, row[at], r * weight[t] * (1_000_000_000 * tf[at] // (1000 * tf[at] + 8 * m[row[at]])))
        least = int(np.median(full))
        score, place = shard.best(ask, times, 3, least)
        want = [i for i in np.argsort(-full, kind="stable")[:3] if full[i] >= max(least, 1)]
        assert set(want) <= set(place.tolist()) and (full[place] == score).all()


def test_items_come_in_chunks_whole(spark):
    rows = spark.createDataFrame([(i, h, 1) for i in range(6) for h in range(5)], "item long, h long, q long")
    got = list(maxscore.chunks(rows, most=8))
    assert [[i for i, _, _ in part] for part in got] == [[0, 1], [2, 3], [4, 5]] and all(len(h) == 5 for part in got for _, h, _ in part)


def top(vectors, every, k):
    got = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        got[i] = w
    out = []
    for q in got:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(got[q], got[x])), x) for x in got if x != q)[:k]
            out += [(q, n + 1, x, -s) for n, (s, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_top_k(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 20)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 6))
    rows = [(i, [float(np.float32(x)) for x in middle[rng.integers(12)] + spread * rng.normal(size=6)]) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(800, 860)]  # ties, and more of one vector than a list holds
    rows += [(900, None), (901, []), (902, [0.1, None]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0, -1.0]), (906, [0.0] * 6), (None, [1.0] * 6), (920, [0.0] * 6)]
    rows += [rows[3]]  # a row that repeats
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(4)
    assert sorted(map(tuple, topk.search(df, every=10, k=15).collect())) == top(rows, 10, 15)
    assert topk.search(df.where("false")).count() == 0 and topk.search(df.where("vec_id % 20 = 1")).count() == 0


def test_annuli_skip_far_ones():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(scale=0.5, size=(50, 4)) for c in np.eye(4) * 40])
    n = (x * x).sum(1)
    y = topk.lifted(x, n.max())
    pivots = topk.centres(y, 4)
    d = topk.distances(y, pivots)
    cell = d.argmin(1)
    r = d[np.arange(len(y)), cell]
    shape = topk.Annuli(pivots, n.max(), np.arange(4), *(np.array([f(r[cell == c]) for c in range(4)]) for f in (min, max)), np.bincount(cell))
    s = x[:5] @ x.T
    row, annulus = shape.opened(x[:5], np.sort(s, axis=1)[:, -10], 0, None)
    assert len(row) < 20
    for q in range(5):
        best = np.argsort(-s[q])[:10]
        assert set(cell[best].tolist()) <= set(annulus[row == q].tolist())


def test_scores_beyond_doubles_are_exact_and_held():
    big = np.array([[2.0**40, 1.0], [2.0**62, 0.0]])
    assert topk.scores(big, big).tolist() == [[min(a, 2**63 - 1) for a in r] for r in ([2**80 + 1, 2**102], [2**102, 2**124])]
    assert topk.scores(np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**60 + 3]]


def harmed(rows):
    """Rows after damage, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


DUE = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Cost, audit and repaired lines, by the least (cost, audit) of each state."""
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", [])}

    def put(into, s, x):
        if s not in into or x[:2] < into[s][:2]:
            into[s] = x

    def opened(states):
        for _ in range(3):
            for s, (c, e, said) in list(states.items()):
                put(states, DUE[s], (c + 2, e + "I", [*said, f"{name[DUE[s]]}:"]))
        return states

    for role, text, fault in rows:
        after = {}
        for s, (c, e, said) in opened(best).items():
            put(after, s, (c + 3, e + "D", said))
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                if role[:1] == DUE[s] or (role[:1] == "s" and s == ""):
                    put(after, role[:1], (c, e + "K", [*said, f"{role}:{text}"]))
                put(after, DUE[s], (c + 2, e + "R", [*said, f"{name[DUE[s]]}:{text}"]))
        best = after
    return min((x for s, x in opened(best).items() if s in ("", "a")), key=lambda x: x[:2])


def judged(rows, tie):
    out = {}
    for conv, own in harmed(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1:]], r[1:]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        n = Counter(faults)
        cost, audit, said = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    return {c: out.get(c, none) for c in {r[0] for r in rows}}


def test_structure_repair(spark, tmp_path):
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "no", "", " \t", "what?", None, "so! ", "é…", "x.\n", "a" * 50 + "."]
    rows = [(c, None if random.random() < 0.1 else random.randint(0, 6) if c % 3 else t, random.choice(roles), random.choice(texts)) for c in range(120) for t in range(random.randint(1, 9))]
    rows += [(200, t, "user" if t % 2 else "assistant", random.choice(["Yes.", "no", f"text {t}."])) for t in range(9000)]  # over LONG
    rows += [(201, None, "user", "same.")] * 30 + [(None, t, "user", f"t{t}.") for t in range(5)] + [(202, 0, "user", "z " * 200_000 + "."), (203, 10, "s", "Hi."), (204, 3, "system", "only.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    said = spark.createDataFrame(sorted({r[1:] for own in harmed(rows).values() for r in own}), "role string, text string")
    tie = {(r.role, r.text): r.h for r in said.selectExpr("role", "text", "xxhash64(role, text) AS h").collect()}
    want = judged(rows, tie)
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.op12_structure_repair(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c
    df.where("false").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert dialogue.op12_structure_repair(spark, f"{tmp_path}/none").count() == 0


def test_repair_costs_are_least():
    """Stored costs against all edits of short conversations."""
    for size in (1, 2, 3, 4):
        for roles in itertools.product("sua?", repeat=size):
            gone, cut = np.array([random.random() < 0.2 for _ in roles]), np.array([random.random() < 0.3 for _ in roles])
            cut &= ~gone
            e = dialogue.Edits(np.array([dialogue.CODES.get(r, 3) for r in roles]), gone, cut, np.array([0]), np.array([size]))
            fault = ["blank" if g else "truncated" if c else "" for g, c in zip(gone, cut)]
            cost, audit, _ = cheapest(list(zip(roles, roles, fault)))
            said = "".join("I" * n + chr(x) for n, x in zip(e.inserted, e.edit)) + "I" * dialogue.last_inserts(int(e.last[0]))
            assert (int(e.cost[0]), said) == (cost, audit), (roles, fault)


def planted(rng, n: int, least: float, kind: str):
    """A text of n words and a copy with as many word edits as `least` allows: at random places, or evenly spread ones."""
    words = [f"w{x}" for x in np.minimum(rng.zipf(1.3, n), 20_000)]
    edits = int((1 - least) * n + 1e-9)
    copy = list(words)
    places = sorted(rng.choice(n, edits, replace=False).tolist() if kind == "random" else [int((i + 0.5) * n / edits) for i in range(edits)], reverse=True)
    for p in places:
        how = rng.integers(3) if kind == "random" else 0
        if how == 1:
            del copy[p]
        else:
            copy[p : p + (how == 0)] = [f"v{rng.integers(1 << 40)}"]
    return " ".join(words), " ".join(copy)


def test_recall_of_near_duplicates_by_length_and_similarity(spark):
    rng = np.random.default_rng(2)
    cells = [(n, s, k) for n in (4, 5, 6, 8, 10, 12, 15, 20, 24, 26, 30, 31, 40, 60, 100, 200) for s in (0.8, 0.82, 0.85, 0.9) for k in ("random", "even") if int((1 - s) * n + 1e-9)]
    rows, pairs = [], []
    for c in cells:
        for _ in range(40):
            a, b = planted(rng, *c)
            one, two = ([int(w[1:]) + (w[0] == "v") * (1 << 50) for w in t.split()] for t in (a, b))
            if near_dup.similarity(np.array(one, np.uint64), np.array(two, np.uint64)) >= 0.8:
                pairs.append((c, len(rows), len(rows) + 1))
                rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, every = Counter(c for c, i, j in pairs if got[i] == got[j]), Counter(c for c, _, _ in pairs)
    low = {c: (found[c], n) for c, n in every.items() if n > 20 and found[c] < (0.9 if c[2] == "random" else 0.8) * n}
    print({c: round(found[c] / n, 3) for c, n in every.items() if found[c] < n}, sum(found.values()) / len(pairs))
    assert not low and sum(found.values()) >= 0.97 * len(pairs)
    assert all(found[c] == n for c, n in every.items() if c[0] <= 24)
