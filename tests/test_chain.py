"""Chains of decisions in parallel stretches against a row at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chain, eventlog, runs

random.seed(21)


def limited(t, limit, gap):
    start, n, out = None, 0, []
    for x in t:
        if start is None or x - start >= gap:
            start, n = x, 0
        n += 1
        out.append((max(0, limit - n), n <= limit))
    return out


def broken(t, good, failures, rest):
    is_open, bad, since, out = False, 0, 0, []
    for x, ok in zip(t, good):
        if is_open and x < since + rest:
            out.append((False, "open"))
            continue
        bad = 0 if ok else bad + 1
        is_open = not ok and (is_open or bad >= failures)
        since = x if is_open else since
        out.append((True, "open" if is_open else "closed"))
    return out


@pytest.mark.parametrize("seed", range(150))
def test_stretches_compose(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    t = np.cumsum(rng.choice([0, 1, 1, 3, 12, 30], n))
    good = rng.random(n) < rng.choice([0.2, 0.5, 0.8])
    cuts = [0, *sorted(set(rng.integers(1, n, int(rng.integers(0, 5))).tolist()) if n > 1 else []), n]
    for rule, cols, want in (
        (chain.Limit(3, 10), (t,), limited(t.tolist(), 3, 10)),
        (chain.Break(int(rng.integers(1, 4)), int(rng.choice([1, 5, 20])), runs.settled), (t, good), None),
    ):
        if want is None:
            want = broken(t.tolist(), good.tolist(), rule.failures, rule.rest)
        state, got = rule.begin, []
        for a, z in zip(cuts[:-1], cuts[1:]):
            part = [c[a:z] for c in cols]
            made, after = rule.run(*part, state)
            summed = rule.summary(*part)(state)
            # The state by summary leads to the same decisions; a breaker's count doesn't matter while it is open.
            assert summed[0] == after[0] and (summed[1:] == tuple(after[1:]) if isinstance(rule, chain.Limit) else summed[2] == after[2] if after[0] else summed[1] == after[1])
            got += list(zip(*(v.tolist() for v in made.values())))
            state = summed
        assert got == want


def test_a_busy_key_is_spread(spark):
    rows, at = [], 0
    for i in range(4000):
        at += random.choice([0, 1, 1, 5])
        rows.append((random.choice(["hot"] * 20 + ["a", "b", None]), at, random.random() < 0.5))
    df = spark.createDataFrame(rows, "k string, secs long, ok boolean").withColumn("ts", F.timestamp_seconds("secs"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so partitions stay as many as asked for
    try:
        _spread(spark, df, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _spread(spark, df, rows):
    for name, want in (("l", lambda x: limited([s for s, _ in x], 4, 9)), ("b", lambda x: broken([s for s, _ in x], [o for _, o in x], 3, 7))):
        out = eventlog.rate_limited(df, "k", "ts", 4, 9) if name == "l" else runs.breaker(df, "k", "ts", "ok", 3, 7.0)
        got, every = {}, {}
        for r in out.collect():
            got.setdefault(r.k, []).append((int(r.ts.timestamp()), *tuple(r)[2:]))
        for k, s, o in sorted(rows, key=lambda x: (x[1], x[2])):
            every.setdefault(k, []).append((s, o))
        for k, x in every.items():
            own = [(s, *((o,) if name == "b" else ()), *w) for (s, o), w in zip(x, want(x))]
            assert sorted(own) == sorted(got[k]), k
    assert runs.breaker(df.where("false"), "k", "ts", "ok").count() == 0
