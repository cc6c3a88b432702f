"""Suffixes and common prefixes of one shard by external induced sorting.

The text, its types and runs may be files mapped into memory; what waits for its
bucket stands in queues that go to files beyond HELD entries, so memory is bounded
by the largest bucket.  The left-most suffixes of rising runs are sorted by their
substrings (an induction from their first symbols), named, and, where names
repeat, sorted by the same routine on the string of names, or by doubling where
most buckets of that string would hold a few suffixes only.  From their order two
passes induce that of all others: falling ones in rising order, then rising ones
in falling order.  A bucket is settled as a whole: what it induces in itself comes
in rounds, one for each length of a run, and what it induces elsewhere is appended
to the queues in order.  Common prefixes go along: those of two neighbours in a
queue are one more than the least between the suffixes that induced them.

This sorts a shard in sequence, and every match must lie in one shard; `substring`
holds the way that is used for a corpus, and the README the figures of both.
"""

from __future__ import annotations

import os

import numpy as np

from .bytesio import U, mix

#: Entries of all queues that stay in memory, and suffixes to a symbol under which names are sorted by doubling.
HELD, CROWD = 1 << 22, 64


class Queues:
    """For each symbol the positions that wait for its bucket, in order, with their common prefixes; in files of `folder` beyond HELD entries."""

    def __init__(self, folder: str | None, label: str):
        self.folder, self.label = folder, label
        self.parts: dict[int, list] = {}
        self.held = self.files = 0

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray | None) -> None:
        self.parts.setdefault(symbol, []).append((at, lcp))
        self.held += len(at)
        if self.folder and self.held > HELD:
            for s, parts in self.parts.items():
                live = [p for p in parts if not isinstance(p, str)]
                if not live:
                    continue
                self.files += 1
                name = os.path.join(self.folder, f"{self.label}-{self.files}.npy")
                two = [np.concatenate([a for a, _ in live])]
                if live[0][1] is not None:
                    two.append(np.concatenate([x for _, x in live]))
                np.save(name, np.stack(two))
                self.parts[s] = [p for p in parts if isinstance(p, str)] + [name]
            self.held = 0

    def waits(self, symbol: int) -> bool:
        return symbol in self.parts

    def take(self, symbol: int, with_lcp: bool) -> tuple[np.ndarray, np.ndarray | None]:
        at, lcp = [], []
        for p in self.parts.pop(symbol, ()):
            if isinstance(p, str):
                rows = np.load(p)
                os.remove(p)
                p = (rows[0], rows[1] if with_lcp else None)
            else:
                self.held -= len(p[0])
            at.append(p[0])
            lcp.append(p[1])
        none = np.zeros(0, np.int64)
        return (np.concatenate(at) if at else none), ((np.concatenate(lcp) if at else none) if with_lcp else None)


def rising(x: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is less than the next one; the last is."""
    n = len(x)
    out = np.ones(n, bool)
    step = np.flatnonzero(np.append(x[:-1] != x[1:], True))  # the last place of each run of equal symbols
    last = np.searchsorted(step, np.arange(n))
    ends = step[last]
    inner = ends < n - 1
    out[inner] = x[ends[inner]] < x[ends[inner] + 1]
    return out


def run_lengths(x: np.ndarray) -> np.ndarray:
    step = np.flatnonzero(np.append(x[:-1] != x[1:], True))
    place = np.arange(len(x))
    return step[np.searchsorted(step, place)] - place + 1


def _between(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of lcp[a+1..b] for each pair a < b."""
    if not len(a):
        return np.zeros(0, np.int64)
    ends = np.stack([a + 1, np.minimum(b + 1, len(lcp) - 1)], 1).ravel()
    out = np.minimum.reduceat(lcp, ends)[::2]
    # The end is left out by reduceat, except that the last place can't be named as one.
    return np.where(b + 1 > len(lcp) - 1, np.minimum(out, lcp[-1]), out)


def _settle(symbol, x, up, queue, other, other_lcp, runs):
    """One bucket of a pass: the suffixes it takes from its queue and from itself, then `other`; pushes what they induce elsewhere and returns the first kind."""
    with_lcp = other_lcp is not None
    at, lcp = queue.take(symbol, with_lcp)
    mine, mine_lcp, k = [at], [lcp], 1
    while len(at):
        before = at - 1
        same = np.flatnonzero((at > 0) & (x[np.maximum(before, 0)] == symbol))
        if not len(same):
            break
        if with_lcp:
            # A run one longer than those of the round before; between neighbours, one more than their inducers.
            nxt = np.empty(len(same), np.int64)
            nxt[0], nxt[1:] = k, 1 + _between(lcp, same[:-1], same[1:])
            lcp = nxt
            mine_lcp.append(lcp)
        at, k = before[same], k + 1
        mine.append(at)
    own = np.concatenate(mine)
    own_lcp = None
    every = np.concatenate([own, other])
    if with_lcp:
        own_lcp = np.concatenate(mine_lcp)
        if len(own_lcp):
            own_lcp[0] = 0
        rest = other_lcp.copy()
        if len(rest):
            rest[0] = min(runs[own[-1]], runs[other[0]]) if len(own) else 0
        lcps = np.concatenate([own_lcp, rest])
    before = every - 1
    c = x[np.maximum(before, 0)]
    push = np.flatnonzero((every > 0) & ((c < symbol) if up else (c > symbol)))
    if len(push):
        order = push[np.argsort(c[push], kind="stable")]
        c = c[order]
        cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        if with_lcp:
            got = np.empty(len(order), np.int64)
            inside = np.ones(len(order), bool)
            inside[cut] = False
            i = np.flatnonzero(inside)
            got[i] = 1 + _between(lcps, order[i - 1], order[i])
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            s = int(c[a])
            if with_lcp:
                got[a] = 1 if queue.waits(s) else 0  # from another bucket: only the symbol itself is shared
            queue.put(s, before[order[a:b]], got[a:b] if with_lcp else None)
    return own, own_lcp


def induce(x: np.ndarray, is_up: np.ndarray, stars: np.ndarray, star_lcp: np.ndarray | None, runs: np.ndarray | None, folder: str | None, label: str):
    """All suffixes in order (and the common prefix of each with the one before) from the first ones of rising runs in theirs."""
    symbols = np.unique(x).tolist()
    with_lcp = star_lcp is not None
    first = x[stars]
    edge = np.searchsorted(first, symbols + [symbols[-1] + 1])
    falling, down = Queues(folder, f"{label}-l"), {}
    empty = np.zeros(0, np.int64)
    for i, s in enumerate(symbols):
        own = slice(edge[i], edge[i + 1])
        if falling.waits(s) or edge[i] < edge[i + 1]:
            down[s] = _settle(s, x, False, falling, stars[own], star_lcp[own] if with_lcp else None, runs)
    up, out, lcps = Queues(folder, f"{label}-s"), [], []
    up.put(symbols[0], np.array([len(x) - 1]), np.zeros(1, np.int64) if with_lcp else None)
    for s in reversed(symbols):
        low, low_lcp = down.get(s, (empty, empty if with_lcp else None))
        back = low[::-1]
        back_lcp = np.append(0, low_lcp[:0:-1]) if with_lcp and len(low) else (empty if with_lcp else None)
        high, high_lcp = _settle(s, x, True, up, back, back_lcp, runs)
        out.append(np.concatenate([low, high[::-1]]))
        if with_lcp:
            mid = empty
            if len(high):
                mid = np.append(min(runs[low[-1]], runs[high[-1]]) if len(low) else 0, high_lcp[:0:-1])
            lcps.append(np.concatenate([low_lcp, mid]))
    return np.concatenate(out[::-1]), (np.concatenate(lcps[::-1]) if with_lcp else None)


def _hashes(x: np.ndarray) -> np.ndarray:
    """Running sums by which substrings are compared; a sum's weight is its place's power of an odd number."""
    power = np.cumprod(np.full(len(x), 0x9E3779B97F4A7C15, U))
    return np.append(U(0), np.cumsum(mix(x.astype(U) + U(7)) * power))


def _same(sums: np.ndarray, inverse: np.ndarray, a, b, n) -> np.ndarray:
    return (sums[a + n] - sums[a]) * inverse[a] == (sums[b + n] - sums[b]) * inverse[b]


def _inverse(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), U))


def suffixes(x: np.ndarray, cap: int = 0, folder: str | None = None, level: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffixes of x in order and, with cap, their common prefixes (right up to cap); the last symbol must be the only least one."""
    n = len(x)
    if n == 1:
        return np.zeros(1, np.int64), (np.zeros(1, np.int64) if cap else None)
    up = rising(x)
    star = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    sums, inverse = _hashes(x), _inverse(n + 1)
    if len(star) > 1:
        rough = star[np.argsort(x[star], kind="stable")]
        order, _ = induce(x, up, rough, None, None, folder, f"{level}-names")
        is_star = np.zeros(n, bool)
        is_star[star] = True
        order = order[is_star[order]]
        size = np.zeros(n, np.int64)
        size[star] = np.append(np.diff(star) + 1, 1)
        a, b = order[:-1], order[1:]
        equal = (size[a] == size[b]) & _same(sums, inverse, a, b, np.minimum(size[b], n - np.maximum(a, b)))
        name = np.empty(n, np.int64)
        name[order] = np.append(0, np.cumsum(~equal))
        names = name[star]
        if names.max() + 1 < len(star):
            few = len(star) < CROWD * int(names.max() + 1)
            rank = doubled(names) if few else suffixes(names, 0, folder, level + 1)[0]
            star = star[rank]
        else:
            star = order
    if not cap:
        return induce(x, up, star, None, None, folder, f"{level}")
    # Common prefixes of neighbours among these, up to cap, by halving the length that is compared.
    low, high = np.zeros(max(0, len(star) - 1), np.int64), np.minimum(cap, n - np.maximum(star[:-1], star[1:]))
    while (low < high).any():
        mid = (low + high + 1) // 2
        ok = _same(sums, inverse, star[:-1], star[1:], mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return induce(x, up, star, np.append(0, low), run_lengths(x), folder, f"{level}")


def doubled(x: np.ndarray) -> np.ndarray:
    """Suffixes of x in order, by ranks of prefixes of doubled length; only ranks that are shared are sorted again."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    first = np.append(True, x[order[1:]] != x[order[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    k = 1
    open_ = order[~(first & np.append(first[1:], True))]
    while len(open_):
        after = rank[np.minimum(open_ + k, n)]
        sort = np.lexsort((after, rank[open_]))
        at, after = open_[sort], after[sort]
        group = rank[at]
        new_group = np.append(True, group[1:] != group[:-1])
        new = new_group | np.append(True, after[1:] != after[:-1])
        place = np.arange(len(at))
        start = place[new_group][np.cumsum(new_group) - 1]
        rank[at] = group + place[new][np.cumsum(new) - 1] - start
        open_ = at[~(new & np.append(new[1:], True))]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def repeated_starts(texts: list[bytes], size: int, folder: str | None = None) -> list[np.ndarray]:
    """For each text the places where a string of `size` bytes starts that also starts anywhere else in them."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    # Texts end in 1, all in 0; bytes follow.
    x = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 2
    x[ends - 1] = 1
    x = np.append(x, 0)
    order, lcp = suffixes(x, size, folder)
    near = lcp >= size
    hit = near | np.append(near[1:], False)
    flag = np.zeros(len(x), bool)
    flag[order[hit]] = True
    out, a = [], 0
    for e in ends.tolist():
        # A string inside a text holds no end, so its equals hold none.
        own = flag[a : e - 1]
        own[max(0, len(own) - size + 1) :] = False
        out.append(np.flatnonzero(own))
        a = e
    return out
