"""Simple-8b: ids in 64-bit words, as many to a word as their width lets in.

The low four bits of a word select how the other sixty are used:

    0        escape: the next word is one value, raw (for values of 2**60 and more)
    1        reserved
    2 .. 15  60x1 30x2 20x3 15x4 12x5 10x6 8x7 7x8 6x10 5x12 4x15 3x20 2x30 1x60 bits

A coded run holds no padding: near its end a selector that fits what is left is
taken, so the count of values follows from the words alone.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Values to a word and bits to a value, by selector from 2.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([1, 0] + [n for n, _ in LAYOUT], np.int64)
_BITS = np.array([b for _, b in LAYOUT])


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; at least 1."""
    w = np.ones(len(values), np.int8)
    for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        over = values >= U(1 << b)
        if not over.any():
            break
        w[over] = b + 1
    return w


def encode(values: np.ndarray) -> np.ndarray:
    """The words of a run of unsigned values of any width up to 64 bits."""
    values = np.ascontiguousarray(values, U)
    n = len(values)
    if not n:
        return np.zeros(0, U)
    w = widths(values)
    pick = np.where(w > 60, 0, 15).astype(np.int64)  # selector 15 takes one value, 0 escapes
    for s in range(14, 1, -1):
        count, bits = LAYOUT[s - 2]
        if count > n:
            break
        over = w > bits
        if over.all():
            break
        c = np.zeros(n + 1, np.int32)
        np.cumsum(over, out=c[1:])
        fits = np.flatnonzero(c[count:] == c[: n + 1 - count])
        if not len(fits):
            break  # a wider count needs smaller values still
        pick[fits] = s
    step = (np.arange(n) + _COUNT[pick]).tolist()
    at, starts = 0, []
    push = starts.append
    while at < n:
        push(at)
        at = step[at]
    starts = np.array(starts)
    chosen = pick[starts]
    place = np.arange(len(starts)) + np.cumsum(chosen == 0) - (chosen == 0)
    words = np.zeros(len(starts) + int((chosen == 0).sum()), U)
    for s in np.unique(chosen).tolist():
        own = chosen == s
        if s == 0:
            words[place[own] + 1] = values[starts[own]]
            continue
        count, bits = LAYOUT[s - 2]
        block = values[starts[own][:, None] + np.arange(count)]
        shifts = (4 + bits * np.arange(count)).astype(U)
        words[place[own]] = np.bitwise_or.reduce(block << shifts, axis=1) | U(s)
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """The values of coded words; all words of a selector are unpacked at once."""
    words = np.ascontiguousarray(words, U)
    sel = (words & U(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escape = np.flatnonzero(sel == 0)
    if len(escape):
        # In a stretch of zero selectors each second word is raw, and so is the word after an odd stretch.
        new = np.diff(escape, prepend=-2) != 1
        start = np.maximum.accumulate(np.where(new, np.arange(len(escape)), 0))
        marks = escape[(np.arange(len(escape)) - start) % 2 == 0]
        raw[marks + 1] = True
    count = np.where(raw, 0, _COUNT[sel])
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, U)
    at = ends - count
    for s in np.unique(sel[~raw]).tolist():
        own = np.flatnonzero((sel == s) & ~raw)
        if s == 0:
            out[at[own]] = words[own + 1]
            continue
        if s == 1:
            raise ValueError("selector 1 is reserved")
        n, bits = LAYOUT[s - 2]
        shifts = (4 + bits * np.arange(n)).astype(U)
        out[at[own][:, None] + np.arange(n)] = (words[own][:, None] >> shifts) & U((1 << bits) - 1)
    return out
