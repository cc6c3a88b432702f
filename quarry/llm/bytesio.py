"""Vectorised work on the bytes of Arrow text columns: hashes of runs without a loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random words from a seed, alike in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: A random odd word for each byte, and the base of the polynomial.
BYTE = stream(256, 11) | U(1)
BASE = int(stream(1, 5)[0] | U(1))
INVERSE = pow(BASE, -1, 1 << 64)

_powers = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled when more are asked for."""
    p = _powers[base]
    with np.errstate(over="ignore"):
        while len(p) < n:
            p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
    _powers[base] = p
    return p[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of BYTE[b]*BASE**i before each place; runs are hashed from their two ends."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[s:e] for each run, the same wherever the run stands."""
    inverse = powers(INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and where each row starts, one more at the end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: 1 for A-Z, a-z, 0-9 and every byte from 0x80: a letter beyond ASCII stays in its word.
WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD[_a : _b + 1] = True
#: A-Z to a-z, all else kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def runs(flag: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True, cut at the starts of rows: starts, ends, and where each row's runs begin, one more at the end."""
    n = len(flag)
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    first = flag.copy()
    first[1:] &= ~flag[:-1] | edge[1:n]
    last = flag.copy()
    last[:-1] &= ~flag[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, rows)
