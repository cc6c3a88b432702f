"""Items of source text, found by their heads and braces; no full parser.

Comments, strings and character literals are blanked first, so that braces are
braces.  One regular expression then names every head, brace and semicolon; a
stack of open containers (modules, impls, traits) tells which heads are items, and
an item ends where its braces close or at its semicolon.  What stands inside a
function is no item.  Texts are parsed one at a time, in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

PARAM, CLAUSE = "struct<name: string, kind: string, bounds: array<string>, default: string>", "struct<subject: string, bounds: array<string>>"
ITEM = (
    f"fqn string, name string, item_type string, visibility string, signature string, doc_comment string, body_source string, attributes array<string>, generic_params array<{PARAM}>, "
    f"where_clauses array<{CLAUSE}>, start_line int, end_line int"
)
_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n']+|[^\\'\n])'", re.S)
_MARK = re.compile(r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?(?P<mods>(?:\b(?:default|async|unsafe|const(?=\s+(?:unsafe|extern|fn|async)\b)|extern(?:\s+\"\s*\")?)\s+)*)(?P<kind>\b(?:fn|struct|enum|union|trait|impl|mod|type|const|static|use)\b|\bmacro_rules!)|(?P<sign>[{};])")
_KINDS = {"fn": "function", "mod": "module", "type": "type_alias", "macro_rules!": "macro"}
_SCOPES = ("mod", "impl", "trait")


def _blank(text: str) -> str:
    """The text with comments, strings and characters as blanks of equal length; lines stay."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n\"]", " ", m[0]) if m[0].startswith('"') else re.sub(r"[^\n]", " ", m[0]), text)


def split_outside(text: str, sep: str) -> list[str]:
    """Parts of a text between separators that stand in no brackets, trimmed; empty ones are left out."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ")]}" or c == ">" and text[i - 1 : i] != "-")
        if c == sep and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p for p in (x.strip() for x in [*out, text[start:]]) if p]


def _angle(text: str) -> int:
    """Where the angle bracket that opens a text closes, one behind it; 0 if the text doesn't begin with one."""
    if not text.startswith("<"):
        return 0
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">" and text[i - 1] != "-")
        if not depth:
            return i + 1
    return 0


def parameters(text: str) -> list[tuple]:
    """(name, kind, bounds, default) of generic parameters without their brackets."""
    out = []
    for part in split_outside(text, ","):
        head, _, default = part.partition("=")
        name, _, bounds = head.partition(":")
        name, kind = name.strip(), "type"
        if name.startswith("'"):
            name, kind = name[1:], "lifetime"
        elif name.startswith("const "):
            name, kind = name[6:].strip(), "const"
        out.append((name, kind, split_outside(bounds, "+"), default.strip() or None))
    return out


def clauses(head: str) -> list[tuple]:
    """(subject, bounds) of what follows `where` in a head."""
    m = re.search(r"\bwhere\b", head)
    parts = split_outside(head[m.end() :], ",") if m else []
    return [(s.strip(), split_outside(b, "+")) for s, _, b in (p.partition(":") for p in parts)]


def _impl_names(rest: str) -> tuple[str, str, str | None]:
    """(name, type, trait) of an impl from what follows its generics."""
    rest = re.split(r"\bwhere\b", rest)[0].strip()
    m = re.match(r"(.*?)\s+for\s+(.*)$", rest, re.S)
    bare = lambda x: re.sub(r"<.*", "", x, flags=re.S).strip().lstrip("&!").strip()
    if not m:
        return bare(rest), bare(rest), None
    trait, own = m[1].strip(), bare(m[2])
    return f"{bare(trait).split('::')[-1]}_{own}", own, trait


def items_of(text: str | None, module: str) -> list[tuple]:
    """The items of a source text that stands for a module, in order of their heads."""
    text = text or ""
    code = _blank(text)
    marks = list(_MARK.finditer(code))
    line = lambda at: text.count("\n", 0, at) + 1
    out, scopes, depth, k = [], [(module, 0, None)], 0, 0
    while k < len(marks):
        m = marks[k]
        k += 1
        if m["sign"]:
            depth += (m["sign"] == "{") - (m["sign"] == "}")
            while len(scopes) > 1 and depth < scopes[-1][1]:
                scopes.pop()
            continue
        if depth != scopes[-1][1]:
            continue
        kind, place = m["kind"], scopes[-1]
        # The head reaches to the brace or semicolon; braces of a `use` and semicolons in brackets belong to it.
        j, inner = k, 0
        while j < len(marks) and not (marks[j]["sign"] in ("{", ";") and kind != "use" and not _open(code, m.end(), marks[j].start()) or kind == "use" and marks[j]["sign"] == ";"):
            j += 1
        end = marks[j].start() if j < len(marks) else len(code)
        head = code[m.end() : end]
        brace = j < len(marks) and marks[j]["sign"] == "{"
        if kind in ("const", "static") and "=" in head and brace or kind == "type" and brace:
            while j < len(marks) and not (marks[j]["sign"] == ";" and inner <= 0):
                inner += (marks[j]["sign"] == "{") - (marks[j]["sign"] == "}")
                j += 1
            end, brace = (marks[j].start() if j < len(marks) else len(code)), False
            head = code[m.end() : end]
        stop, nxt = end + 1, j + 1
        if brace:
            inner, nxt = 1, j + 1
            while nxt < len(marks) and inner:
                inner += (marks[nxt]["sign"] == "{") - (marks[nxt]["sign"] == "}")
                nxt += 1
            stop = marks[nxt - 1].end() if not inner else len(code)
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        generics, attributes, name, own = "", _above(text, start)[0], None, None
        if kind == "impl":
            cut = _angle(head.lstrip())
            generics = head.lstrip()[1 : cut - 1] if cut else ""
            name, own, trait = _impl_names(head.lstrip()[cut:])
            attributes = [*attributes, *([f"impl_for={trait}"] if trait else [])]
        elif kind == "use":
            name = re.sub(r"\s+", "", text[m.end() : end]).split("::")[-1].strip("{}") or "use"
        else:
            found = re.match(r"\s*(?:mut\s+|r#)?([A-Za-z_]\w*)\s*", head)
            if not found:
                continue
            name = found[1]
            cut = _angle(head[found.end() :])
            generics = head[found.end() + 1 : found.end() + cut - 1] if cut else ""
        if place[2] and kind == "fn":
            attributes = [*attributes, f"impl_type={place[2]}"]
        fqn = f"{place[0]}::{name}"
        vis = re.sub(r"\s+", "", m["vis"] or "")
        signature = re.sub(r"\s+", " ", text[start:end]).strip()
        body = text[start:stop] if kind != "fn" or brace else ""
        out.append((fqn, name, _KINDS.get(kind, kind), vis, signature, _above(text, start)[1], body, attributes, parameters(generics), clauses(head), line(start), line(min(stop, len(text)) - 1 if stop > start else start)))
        if brace and kind in _SCOPES:
            scope = f"{place[0]}::{own}" if kind == "impl" else fqn
            depth += 1
            scopes.append((scope, depth, own if kind == "impl" else None))
            k = j + 1
        else:
            k = nxt
    return out


def _open(code: str, a: int, b: int) -> bool:
    """Whether a round or square bracket is open between two places."""
    part = code[a:b]
    return part.count("(") > part.count(")") or part.count("[") > part.count("]")


def _above(text: str, start: int) -> tuple[list[str], str]:
    """Attributes and documentation right above a place."""
    attributes, doc = [], []
    for row in reversed(text[: text.rfind("\n", 0, start) + 1].split("\n")[:-1]):
        row = row.strip()
        if row.startswith("///"):
            doc.append(row[3:].strip())
        elif row.startswith("#["):
            attributes.append(row)
        else:
            break
    return attributes[::-1], "\n".join(doc[::-1])


def parsed(files: DataFrame, keep: tuple[str, ...] = ("crate_name", "file_path"), path: str = "module_path", text: str = "text") -> DataFrame:
    """The items of files(module_path, text), a row each, with the columns `keep` of their file."""
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    names = [x.split()[0] for x in split_outside(ITEM, ",")]

    def run(batches):
        for pdf in batches:
            rows = [(*i, *k) for m, t, *k in zip(pdf[path], pdf[text], *(pdf[c] for c in keep)) for i in items_of(t, m)]
            yield pd.DataFrame(rows, columns=[*names, *keep])

    return files.select(path, text, *keep).mapInPandas(run, ITEM + "".join(f", `{c}` {kinds[c]}" for c in keep))
