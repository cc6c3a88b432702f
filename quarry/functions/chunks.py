"""Texts, Markdown and HTML cut into chunks.

Every cut is the same greedy one: pieces in order fill a chunk while they fit.  It
is made on running sums of their sizes, a binary search for each chunk.  Sections
of a page are column expressions; packing runs over one text at a time, in Arrow
batches.
"""

from __future__ import annotations

import html
import re
from itertools import groupby
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Bytes of a chunk of text, characters under which a section is merged and over which it is split, characters of a chunk
# of a page and the most that one too short has, what a page doesn't show, and the headings that begin a section.
CHUNK_BYTES, MERGE_CHARS, SPLIT_CHARS, HTML_CHARS, SHORT_HTML = 500, 200, 3000, 500, 30
UNSEEN, HEADINGS = ("script", "style", "nav", "footer", "head"), "[1-4]"


def filled(sizes, most: int, glue: int = 0, free: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the pieces that fill each chunk: those whose sizes, with `glue` between them, come to `most` at most; `free` is what isn't counted, and a chunk has one piece at least."""
    ends = np.append(0, np.cumsum(np.asarray(sizes, np.int64) + glue))
    out, i = [], 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most + glue + free, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def _sentences(paragraph: str, most: int) -> list[str]:
    """A paragraph packed by sentence, which `.`, `!`, `?` or a line end closes; a blank rest is dropped."""
    pieces = re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", paragraph)
    cut = ["".join(pieces[i:j]).strip() for i, j in filled([len(p.encode()) for p in pieces], most)]
    return cut if cut and cut[-1] else cut[:-1]


def text_chunks(text: str | None, most: int = CHUNK_BYTES) -> list[str]:
    """Paragraphs, cut at empty lines, packed up to `most` bytes; a longer paragraph is packed by sentence, and a sentence is never cut."""
    out = []
    paragraphs = [p for p in (text or "").split("\n\n") if p.strip()]
    for long, run in groupby(paragraphs, lambda p: len(p.encode()) > most):
        run = list(run)
        if long:
            out += [c for p in run for c in _sentences(p, most)]
        else:
            out += ["\n\n".join(run[i:j]).strip() for i, j in filled([len(p.encode()) for p in run], most, 2)]
    return out


def markdown_chunks(text: str | None, path: str = "") -> list[tuple[str, str]]:
    """(heading, chunk) of a Markdown text.

    Sections begin at first and second headings, which stay in them.  One under
    MERGE_CHARS joins the section before, whose heading then names both; one over
    SPLIT_CHARS is split at paragraphs.  Each chunk stands under its file and headings.
    """
    text = text or ""
    heads = list(re.finditer(r"(?m)^(##?)[^\S\n]+(\S.*)$", text))
    cuts = [0, *(m.start() for m in heads), len(text)]
    title, above, sections = PurePosixPath(path).stem, ["", ""], []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if k:
            title = heads[k - 1][2].strip()
            above = [title, ""] if heads[k - 1][1] == "#" else [above[0], title]
        body = text[a:b].strip()
        if not body:
            continue
        if sections and len(body) < MERGE_CHARS:
            old = sections[-1]
            sections[-1] = (f"{old[0]} / {title}", old[1], f"{old[2]}\n\n{body}")
        else:
            sections.append((title, " > ".join([f"File: {path}", *filter(None, above)]), body))
    out = []
    for title, place, body in sections:
        pieces = re.split(r"\n\n+", body) if len(body) > SPLIT_CHARS else [body]
        out += [(title, f"{place}\n\n{c}") for c in ("\n\n".join(pieces[i:j]).strip() for i, j in filled([len(p) for p in pieces], SPLIT_CHARS, 2)) if c]
    return out


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Texts with character references resolved; those without one are passed through."""
    some = text.str.contains("&", regex=False).fillna(False).astype(bool)
    out = text.copy()
    out[some] = text[some].map(html.unescape)
    return out


def _marked(page: Column) -> Column:
    """What a page shows, its tags as marks: 2 where a heading begins, 3 where one ends, 1 for all others."""
    c = F.regexp_replace(F.coalesce(page, F.lit("")), "\u0001|\u0002|\u0003", " ")
    for tag in UNSEEN:  # scripts first, as they may hold what looks like tags
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|$)", "\u0001" if tag != "script" else "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "\u0001")
    c = F.regexp_replace(c, rf"(?i)<h{HEADINGS}\b[^>]*>", "\u0002")
    c = F.regexp_replace(c, rf"(?i)</h{HEADINGS}\s*>", "\u0003")
    return F.regexp_replace(c, r"</?[A-Za-z!][^>]*>", "\u0001")


def _parts(marked: Column) -> Column:
    pieces = lambda x: F.filter(F.transform(F.split(x, "\u0001"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    head = lambda x: F.split_part(x, F.lit("\u0003"), F.lit(1))
    last = lambda x: F.element_at(F.concat(F.array(F.lit("")), x), -1)
    body = lambda x, i: F.array_join(pieces(F.when(i == 0, x).otherwise(F.substr(x, F.length(head(x)) + 2))), " ")
    return F.transform(F.split(marked, "\u0002"), lambda x, i: F.struct(F.when(i == 0, F.lit("")).otherwise(last(pieces(head(x)))).alias("heading"), body(x, i).alias("text")))


def sections(df: DataFrame, key: str, page: str) -> DataFrame:
    """key, section (from 0), heading and text: a row for each part of a page with visible text.

    A part begins at a heading of the first four ranks; text before any has the
    empty one.  Pieces of text between tags are trimmed and joined by blanks; of a
    heading the last piece counts, and a heading without text leaves the one before.
    """
    # Tags go before references are resolved, so a resolved `<` isn't one.
    rows = df.select(key, unescaped(_marked(F.col(page))).alias("_m")).select(key, _parts(F.col("_m")).alias("_p"))
    told = lambda i: F.filter(F.transform(F.slice("_p", F.lit(1), i + 1), lambda y: y["heading"]), lambda y: y != "")
    named = F.transform("_p", lambda x, i: F.struct(F.element_at(F.concat(F.array(F.lit("")), told(i)), -1).alias("heading"), x["text"].alias("text")))
    return rows.select(key, F.posexplode(F.filter(named, lambda x: x["text"] != "")).alias("section", "s")).select(key, "section", "s.heading", "s.text")


def html_chunks(text: str | None, most: int = HTML_CHARS) -> list[str]:
    """Sentences of a part packed up to `most` characters, the blank before the last one not counted; chunks of SHORT_HTML characters or fewer are dropped."""
    pieces = [s for s in re.split(r"(?<=[.!?])\s+", text or "") if s]
    chunks = (" ".join(pieces[i:j]).strip() for i, j in filled([len(p) for p in pieces], most, 1, 1))
    return [c for c in chunks if len(c) > SHORT_HTML]


def exploded(df: DataFrame, key: str, text: str, fn, names: str = "chunk_index int, chunk string") -> DataFrame:
    """key and one row for each thing that fn finds in a text, numbered from 0."""
    kind = df.schema[key].dataType.simpleString()
    cols = [x.split()[0] for x in names.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(k, i, *(c if isinstance(c, tuple) else (c,))) for k, t in zip(pdf[key], pdf[text]) for i, c in enumerate(fn(t))]
            yield pd.DataFrame(rows, columns=[key, *cols])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, {names}")
