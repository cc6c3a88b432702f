"""Exact, fast use of a tokenizers-library vocabulary over whole texts.

The vocabulary drops white space and cuts text at class changes, so a run of
letters, a digit or a run of ASCII punctuation is encoded alike alone and in its
text as long as no apostrophe, combining mark or other character stands in its
white-space-separated chunk; a chunk with such a character is kept whole.  Each
distinct piece is encoded once by the library and kept, by a 64-bit hash, in a
table of bounded size.  A text that holds the string of a special token goes to
the library as a whole, and so does every text if `splits_alike` finds that the
file works otherwise.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from .bytesio import LOWER, U, prefix_sums, run_hashes, text_buffers

#: Distinct pieces that a worker keeps; then it starts anew.
KEPT_PIECES = 600_000
#: Bytes hashed at once.
BLOCK = 1 << 20

SPACE, LETTER, MARK, OTHER, DIGIT, LEAD, REST, CHUNK = range(8)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
for _c in range(0x21, 0x7F):
    CLASS[_c] = DIGIT if chr(_c).isdigit() else LETTER if chr(_c).isalpha() else MARK
CLASS[0x27] = OTHER
CLASS[0x80:0xC0] = REST
CLASS[0xC3] = LEAD


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_alike(spec: dict) -> bool:
    """Whether the file's normaliser and cuts are those that this module's split respects."""
    norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = (cuts[0].get("pattern") or {}).get("Regex", "")
    kinds = [x.get("type") for x in cuts]
    suffix = (spec.get("model") or {}).get("end_of_word_suffix")
    return bool(norm == ["NFC", "Replace", "Lowercase"] and kinds == ["Split", "ByteLevel"] and cuts[0].get("invert") is True and cuts[0].get("behavior") == "Removed" and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and suffix and not spec.get("truncation") and not spec.get("post_processor"))


class Encoder:
    """Texts to ids by a tokenizers file, with the id `end` after each text."""

    def __init__(self, path: str | None = None, end: int | None = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.end = path or default_path(), end
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = splits_alike(spec)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in special)) if special else None
        self.library = Tokenizer.from_file(self.path)
        self.size = self.library.get_vocab_size()
        if self.by_piece:
            # The same vocabulary and merges, for pieces that are lower case and cut already.
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends_piece = np.zeros(self.size, bool)
            for token, i in spec["model"]["vocab"].items():
                self.ends_piece[i] = token.endswith(suffix)
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}}
            self.plain = Tokenizer.from_str(json.dumps(spec))
        self.forget()

    def forget(self) -> None:
        """Empties the table of pieces."""
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.old = self.new = pd.Index(np.zeros(0, U))

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], whole: np.ndarray) -> None:
        base = len(self.old) + len(self.new)
        lengths = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        cut = np.flatnonzero(~whole)
        for a in range(0, len(cut), 4096):
            own = cut[a : a + 4096]
            got = np.array(self.plain.encode_batch_fast([b" ".join([pieces[i] for i in own]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.ends_piece[got]) + 1
            if len(at) != len(own):
                raise ValueError("a piece was cut further")
            lengths[own] = np.diff(at, prepend=0)
            parts.append(got)
            order.append(own)
        kept = np.flatnonzero(whole)
        if len(kept):
            got = [x.ids for x in self.library.encode_batch_fast([pieces[i].decode() for i in kept], add_special_tokens=False)]
            lengths[kept] = [len(x) for x in got]
            parts.append(np.array([i for x in got for i in x], np.uint32))
            order.append(kept)
        flat, order = np.concatenate(parts), np.concatenate(order)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + len(pieces) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[base + order] = self.used + np.cumsum(lengths[order]) - lengths[order]
        self.lengths[base : base + len(pieces)] = lengths
        self.used += len(flat)
        self.new = self.new.append(pd.Index(hashes))
        if len(self.new) > 50_000 + len(self.old) // 8:
            self.old, self.new = self.old.append(self.new), pd.Index(np.zeros(0, U))

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = self.old.get_indexer(hashes)
        miss = np.flatnonzero(out < 0)
        if len(miss) and len(self.new):
            got = self.new.get_indexer(hashes[miss])
            out[miss] = np.where(got >= 0, got + len(self.old), -1)
        return out

    def _block(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block, and where each row's ids start, one more at the end."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        kind, low = CLASS[data], LOWER[data]
        lead = np.flatnonzero(kind == LEAD)
        if len(lead):
            second = data[lead + 1]
            good = (second != 0x97) & (second != 0xB7)
            lead, second = lead[good], second[good]
            low[lead[second < 0x9F] + 1] += 32
            kind[lead] = LETTER
            kind[lead + 1] = LETTER
        odd = np.flatnonzero((kind == OTHER) | (kind >= LEAD))
        if len(odd):
            stop = np.flatnonzero((kind == SPACE) | edge[:n])
            i = np.searchsorted(stop, odd, "right")
            a = np.where(i > 0, stop[np.maximum(i - 1, 0)], 0)
            a = np.where(kind[a] == SPACE, a + 1, a)
            b = np.append(stop, n)[i]
            a, first = np.unique(a, return_index=True)
            b = b[first]
            mark = np.zeros(n + 1, np.int32)
            np.add.at(mark, a, 1)
            np.add.at(mark, b, -1)
            inside = np.cumsum(mark[:n]) > 0
            kind[inside] = CHUNK
            low[inside] = data[inside]
        change = np.ones(n + 1, bool)
        change[1:n] = kind[1:] != kind[:-1]
        change |= edge
        change[:n] |= kind == DIGIT
        change[1:] |= kind == DIGIT
        at = np.flatnonzero(change)
        starts, ends = at[:-1], at[1:]
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
        whole = kind[starts] == CHUNK
        hashes = run_hashes(prefix_sums(low), starts, ends) ^ np.where(whole, U(0x5851F42D4C957F2D), U(0))
        numbers = self._numbers(hashes)
        miss = np.flatnonzero(numbers < 0)
        if len(miss):
            fresh, first = np.unique(hashes[miss], return_index=True)
            first = miss[first]
            raw = low.tobytes()
            self._learn(fresh, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], whole[first])
            numbers[miss] = self._numbers(hashes[miss])
        lengths = self.lengths[numbers]
        before = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.arange(before[-1]) + np.repeat(self.starts[numbers] - before[:-1], lengths)
        return self.ids[flat], before[np.searchsorted(starts, rows)]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column one after another, and the count of each row; null counts as empty."""
        if isinstance(column, list):
            column = pa.array(column, pa.string())
        data, rows = text_buffers(column)
        count = len(rows) - 1
        whole: list[int] = []
        if not self.by_piece:
            whole = list(range(count))
        elif self.special and self.special.search(data):
            whole = sorted({int(np.searchsorted(rows, m.start(), "right")) - 1 for m in self.special.finditer(data)})
        if len(self.old) + len(self.new) > KEPT_PIECES:
            self.forget()
        parts: list[np.ndarray] = []
        counts = np.zeros(count, np.int64)
        skip = set(whole)
        a, row = 0, 0
        while self.by_piece and a < len(data):
            b = min(a + BLOCK, len(data))
            if b < len(data):  # a block ends at white space or the end of a row
                near = rows[np.searchsorted(rows, b, "right") - 1]
                if near > a:
                    b = int(near)
                else:
                    after = int(rows[np.searchsorted(rows, b, "right")])
                    blank = np.flatnonzero(CLASS[data[b:after]] == SPACE)
                    b = b + int(blank[0]) if len(blank) else after
            first = int(np.searchsorted(rows, a, "right")) - 1
            last = int(np.searchsorted(rows, b, "left"))  # rows[first:last] start before b
            edges = np.clip(rows[first : last + 1], a, b) - a
            ids, at = self._block(data[a:b], edges)
            if skip:
                keep = np.ones(len(ids), bool)
                for i in range(first, last):
                    if i in skip:
                        keep[at[i - first] : at[i - first + 1]] = False
                        at = np.concatenate([at[: i - first + 1], at[i - first + 1 :]])
                counts[first:last] += [int(keep[x:y].sum()) for x, y in zip(at[:-1], at[1:])]
                ids = ids[keep]
            else:
                counts[first:last] += np.diff(at)
            parts.append(ids)
            a = b
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if whole:
            texts = column.take(pa.array(whole, pa.int64())).to_pylist()
            direct = dict(zip(whole, self.library.encode_batch([x or "" for x in texts], add_special_tokens=False)))
            out, at = [], 0
            for i in range(count):
                if i in direct:
                    out.append(np.array(direct[i].ids, np.uint32))
                    counts[i] = len(out[-1])
                else:
                    out.append(ids[at : at + counts[i]])
                    at += int(counts[i])
            ids = np.concatenate(out) if out else ids
        if self.end is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(self.end))
            counts = counts + 1
        return ids.astype(np.uint32, copy=False), counts


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, end: int | None = 1) -> Encoder:
    """One encoder for each worker process and file."""
    key = (path, end)
    if key not in _encoders:
        _encoders[key] = Encoder(path, end)
    return _encoders[key]
