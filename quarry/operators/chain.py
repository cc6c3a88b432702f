"""Chains of decisions by key, cut at any place and decided in parallel.

What is decided on a row depends on the state that all earlier rows of its key leave
behind, so a busy key seems to need one task.  But what a stretch of rows makes of a
state is a function with few cases: a step function of times, and a value for each of a
few counts.  So rows are dealt out by ranges of (key, time), each partition sums up what
it does to whatever state its first key may bring along, a pass over these summaries, one
row a partition, gives every partition the state it begins with, and all partitions
decide their rows at the same time.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered


def ends_of(following: np.ndarray) -> np.ndarray:
    """Where the way from each place ends, if `following` is a later place or the place itself: by doubling steps."""
    at = following
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


@dataclass
class Steps:
    """A function of a time: the state of the first bound that isn't before it; None beyond all bounds."""

    bounds: np.ndarray
    states: list

    @classmethod
    def of(cls, bounds: np.ndarray, marks: np.ndarray, state) -> Steps:
        """From bounds in order and a mark for each; neighbours of one mark are one step, whose state is state(place)."""
        last = np.flatnonzero(np.append(marks[1:] != marks[:-1], True)) if len(marks) else np.zeros(0, np.int64)
        return cls(bounds[last], [state(int(i)) for i in last])

    def __call__(self, time: int):
        i = int(np.searchsorted(self.bounds, time, "left"))
        return self.states[i] if i < len(self.states) else None


class Limit:
    """A window of `gap` opens at the first request and at the first one after it has passed; a state is (start, requests in it)."""

    def __init__(self, limit: int, gap: int):
        self.limit, self.gap, self.begin = limit, gap, None

    def summary(self, t: np.ndarray):
        n = len(t)
        following = np.minimum(np.searchsorted(t, t + self.gap, "left"), n)
        last = ends_of(np.append(np.where(following == n, np.arange(n), following), n))[:n]
        # A window that came along ends before the first one that these rows could have opened does.
        upto = min(n, int(np.searchsorted(t, t[0] + self.gap, "left")) + 1)
        steps = Steps.of(t[:upto], last[:upto], lambda i: (int(t[last[i]]), int(n - last[i])))
        return Went(self.gap, n, steps, (int(t[last[0]]), int(n - last[0])))

    def run(self, t: np.ndarray, state):
        start, count = state or (None, 0)
        number, i = np.zeros(len(t), np.int64), 0
        while i < len(t):
            if start is None or t[i] - start >= self.gap:
                start, count = int(t[i]), 0
            end = max(i + 1, int(np.searchsorted(t, start + self.gap, "left")))
            number[i:end] = count + 1 + np.arange(end - i)
            count, i = count + end - i, end
        return {"remaining": np.maximum(0, self.limit - number), "allowed": number <= self.limit}, (start, count)


@dataclass
class Went:
    """What rows make of a limiter's state."""

    gap: int
    n: int
    steps: Steps
    fresh: tuple

    def __call__(self, state):
        if state is None:
            return self.fresh
        return self.steps(state[0] + self.gap) or (state[0], state[1] + self.n)


class Break:
    """A circuit breaker; a state is (open, failures in a row, time of the last failure that opened it)."""

    begin = (False, 0, 0)

    def __init__(self, failures: int, rest: int, settle):
        self.failures, self.rest, self.settle = failures, rest, settle

    def summary(self, t: np.ndarray, good: np.ndarray):
        n, place = len(t), np.arange(len(t))
        # Failures in a row from each place on, and where a closed breaker that has seen none opens.
        stop = np.append(np.where(good, place, n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        trips = np.append(np.where(stop[:n] - place >= self.failures, place + self.failures - 1, n), n)
        # From a place in too short a row, the next one that is long enough: the least over all later places.
        trips = np.minimum.accumulate(trips[::-1])[::-1]
        probe_after = lambda k: np.where(k < n, np.searchsorted(t, t[np.minimum(k, n - 1)] + self.rest, "left"), n)
        opened = np.where(good, trips[np.minimum(place + 1, n)], place)  # where a probe leads to an open breaker, at once or later
        following = np.maximum(np.minimum(probe_after(opened), n), 0)
        last = ends_of(np.append(np.where(following >= n, place, following), n))[:n]
        tail = n - 1 - int(np.flatnonzero(good)[-1]) if good.any() else n

        def after_probe(j: int):
            k = int(opened[last[j]])
            # Closed to the end: failures since the last success, or since the probe.
            return (True, self.failures, int(t[k])) if k < n else (False, min(tail, n - 1 - int(last[j])), 0)

        upto = min(n, int(np.searchsorted(t, t[0] + self.rest, "left")) + 1)
        return Broke(self.rest, n, Steps.of(t[:upto], last[:upto], after_probe), [self._closed(t, good, b) for b in range(self.failures)])

    def _closed(self, t, good, bad):
        return self.settle(t, good, np.ones(len(t), bool), np.zeros(len(t), bool), False, bad, 0, self.failures, self.rest)

    def run(self, t: np.ndarray, good: np.ndarray, state):
        allowed, opened = np.ones(len(t), bool), np.zeros(len(t), bool)
        state = self.settle(t, good, allowed, opened, *state, self.failures, self.rest)
        return {"allowed": allowed, "state": np.where(opened, "open", "closed")}, state


@dataclass
class Broke:
    """What rows make of a breaker's state."""

    rest: int
    n: int
    steps: Steps
    closed: list

    def __call__(self, state):
        if not state[0]:
            return self.closed[min(state[1], len(self.closed) - 1)]
        return self.steps(state[2] + self.rest) or state


def decided(rows: DataFrame, key: str, ts: str, rule, out: str, *more: str) -> DataFrame:
    """rows(key, ts, more) with what `rule` decides on each, in order of ts and more; `out` are the columns it adds."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.select(key, ts, *more, F.struct(ts, *more).alias("_at"))
    stored = ordered.ranged(rows, key, "_at").withColumn("_p", F.shiftright("_i", 33))
    dealt = lambda df: df.repartition("_p").sortWithinPartitions("_p", "_i")

    def columns(pdf):
        return [pdf[ts].astype("datetime64[ns]").to_numpy().astype(np.int64), *(pdf[c].to_numpy(dtype=bool) for c in more)]

    def edges(pdf):
        """Where another partition or key begins, and the end."""
        k, p = pd.factorize(pdf[key])[0], pdf["_p"].to_numpy()
        return [0, *(np.flatnonzero((p[1:] != p[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), len(k)]

    def alike(x, y) -> bool:
        return x == y or (pd.isna(x) and pd.isna(y))

    def summed(batches):
        """Of each partition its first and last key, what it makes of the first one's state, and the state its last one has if it began there."""
        at, held, ends = None, [], []  # (partition, key) and columns of the stretch at hand; first and last stretch of the partition

        def close():
            cols = [np.concatenate(x) for x in zip(*held)]
            ends[1:] = [(at[1], rule.run(*cols, rule.begin)[1] if ends else rule.summary(*cols))]

        def out():
            (one, step), (two, end) = ends[0], ends[-1]
            return pd.DataFrame({"_p": [at[0]], "one": [one], "two": [two], "made": [pickle.dumps((step, None if len(ends) == 1 else end))]})

        for pdf in batches:
            cut = edges(pdf) if len(pdf) else [0]
            cols = columns(pdf)
            for a, z in zip(cut[:-1], cut[1:]):
                now = (int(pdf["_p"].iloc[a]), pdf[key].iloc[a])
                if at is not None and not (now[0] == at[0] and alike(now[1], at[1])):
                    close()
                    held = []
                    if now[0] != at[0]:
                        yield out()
                        ends = []
                at = now
                held.append([c[a:z] for c in cols])
        if held:
            close()
            yield out()

    def scanned(batches):
        """The state that each partition begins with."""
        last, state = None, None
        for pdf in batches:
            out = []
            for q, one, two, made in zip(pdf["_p"], pdf["one"], pdf["two"], pdf["made"]):
                step, end = pickle.loads(made)
                begin = state if last is not None and alike(last[0], one) else rule.begin
                out.append((q, pickle.dumps(begin)))
                state = step(begin) if end is None else end
                last = (two,)
            yield pd.DataFrame(out, columns=["_p", "begin"])

    sums = dealt(stored.select(key, ts, *more, "_i", "_p")).mapInPandas(summed, f"_p long, one {kind[key]}, two {kind[key]}, made binary")
    begins = sums.repartition(1).sortWithinPartitions("_p").mapInPandas(scanned, "_p long, begin binary")  # a row for each partition

    def run(batches):
        last, state = None, None
        for pdf in batches:
            parts, cut = [], edges(pdf) if len(pdf) else [0]
            cols = columns(pdf)
            for a, z in zip(cut[:-1], cut[1:]):
                q, k = int(pdf["_p"].iloc[a]), pdf[key].iloc[a]
                if last is None or q != last[0]:
                    state = pickle.loads(pdf["begin"].iloc[a])
                elif not alike(k, last[1]):
                    state = rule.begin
                got, state = rule.run(*[c[a:z] for c in cols], state)
                last = (q, k)
                parts.append(pd.DataFrame(got))
            if parts:
                yield pd.concat([pdf[[key, ts, *more]].reset_index(drop=True), pd.concat(parts, ignore_index=True)], axis=1)

    schema = ", ".join(f"`{c}` {kind[c]}" for c in (key, ts, *more)) + ", " + out
    return dealt(stored.join(begins, "_p").select(key, ts, *more, "_i", "_p", "begin")).mapInPandas(run, schema)
