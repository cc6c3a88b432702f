"""Column expressions: vectors, identifiers, texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The namespace of identifiers, and the limits of previews.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
PREVIEW_BYTES, BODY_BYTES, BODY_LINES, HEAD_LINES, TAIL_LINES = 500, 50_000, 50, 13, 7


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_to(a, values) -> Column:
    """Cosine similarity to given values, whose norm is computed once; null for a zero vector."""
    norm = sum(float(x) ** 2 for x in values) ** 0.5
    return dot(a, vector(values)) / F.nullif(F.sqrt(dot(a, a)) * F.lit(norm), F.lit(0.0))


def vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def uuid5(name, namespace: str = NAMESPACE) -> Column:
    """The name-based identifier (version 5) of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), _c(name).cast("binary")))
    nibble = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def clip_bytes(text, most: int = PREVIEW_BYTES, tail: str = "...") -> Column:
    """The text if it has at most `most` bytes, else as many whole characters as fit into them and the tail."""
    t = _c(text)
    raw = F.substring(t.cast("binary"), 1, most)
    # A character that was cut in two is dropped: at most three bytes at the end.
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(t) > most, F.concat(whole, F.lit(tail))).otherwise(t)


def body_or_size(text, most: int = BODY_BYTES) -> Column:
    t = _c(text)
    return F.when(F.octet_length(t) > most, F.format_string("[BODY: %d bytes]", F.octet_length(t))).otherwise(t)


def body_preview(text) -> Column:
    """Lines with numbers four wide; beyond BODY_LINES the first and last with the number left out between them."""
    lines = F.split(_c(text), "\n")
    numbered = F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(": "), x))
    n = F.size(lines)
    note = F.array(F.format_string("  ... (%d lines omitted) ...", n - HEAD_LINES - TAIL_LINES))
    short = F.concat(F.slice(numbered, 1, HEAD_LINES), note, F.slice(numbered, -TAIL_LINES, TAIL_LINES))
    return F.array_join(F.when(n <= BODY_LINES, numbered).otherwise(F.when(n > BODY_LINES, short)), "\n")


def fallback(*names) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(n), F.lit("")) for n in names])


#: Characters of both sides that are held against each other at once.
_CELLS = 1 << 22


def _points(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts as rows, 0 behind their ends."""
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


def jaro_winkler_of(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler similarities of pairs of texts: above 0.7, a common prefix of up to four counts a tenth each.

    All pairs of a block advance together, one character of the left side at a
    time: each takes the first unused equal character inside its window.
    """
    out = np.zeros(len(left))
    size = np.array([max(len(a), len(b), 1) for a, b in zip(left, right)], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * int(size[order[end]]) <= _CELLS:
            end += 1
        rows = order[at:end]
        out[rows] = _jaro_block([left[i] for i in rows], [right[i] for i in rows], int(size[rows[-1]]))
        at = end
    return out


def _jaro_block(left: list[str], right: list[str], width: int) -> np.ndarray:
    a, b = _points(left, width), _points(right, width)
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    n, place = len(left), np.arange(width)
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    inside = place[None, :] < nb[:, None]
    used, hit = np.zeros((n, width), bool), np.zeros((n, width), bool)
    for i in range(int(na.max(initial=0))):
        ok = (b == a[:, i : i + 1]) & inside & ~used & (np.abs(place[None, :] - i) <= reach[:, None]) & (i < na)[:, None]
        first = ok.argmax(1)
        found = ok[np.arange(n), first]
        used[np.flatnonzero(found), first[found]] = True
        hit[:, i] = found
    m = hit.sum(1)
    # Matched characters of either side in order, row by row, have equal counts.
    differ = np.bincount(np.nonzero(hit)[0], a[hit] != b[used], n)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / na + m / nb + (m - differ // 2) / m) / 3, 0.0)
    same = np.cumprod((a[:, :4] == b[:, :4]) & (place[None, :4] < np.minimum(na, nb)[:, None]), axis=1).sum(1)
    out = np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
    equal = np.array([x == y for x, y in zip(left, right)], bool)
    return np.where(equal, 1.0, out)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    ok = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(np.full(len(a), np.nan))
    out[ok] = jaro_winkler_of(a[ok].tolist(), b[ok].tolist())
    return out.astype(object).where(ok, None).astype("float64")
