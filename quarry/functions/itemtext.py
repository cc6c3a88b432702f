"""The text that stands for an item when it is embedded, and the payload stored beside its vector.

Columns of an item: fqn, name, item_type, visibility (the words of the source, empty for
private), signature, doc_comment, body_source, start_line, end_line, attributes (array of
texts), generic_params (array of name, kind, bounds, default) and where_clauses (array of
subject, bounds).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import body_preview, clip_bytes

# Bytes of the previews in a payload, and patterns of a macro that are shown.
DOC_BYTES, TEXT_BYTES, MACRO_PATTERNS = 500, 1000, 3


def _t(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def generics(params: str = "generic_params") -> Column:
    """`<'a, T: A + B = C>`; empty without parameters."""
    one = lambda g: F.concat(
        F.when(g["kind"] == "lifetime", F.lit("'")).otherwise(F.lit("")), g["name"],
        F.when(F.size(g["bounds"]) > 0, F.concat(F.lit(": "), F.array_join(g["bounds"], " + "))).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" = "), g["default"]), F.lit("")),
    )
    return F.when(F.size(params) > 0, F.concat(F.lit("<"), F.array_join(F.transform(params, one), ", "), F.lit(">"))).otherwise(F.lit(""))


def bounds_of(clauses: str = "where_clauses") -> Column:
    return F.when(F.size(clauses) > 0, F.array_join(F.transform(clauses, lambda w: F.concat(w["subject"], F.lit(": "), F.array_join(w["bounds"], " + "))), ", ")).otherwise(F.lit("none"))


def documentation(doc: str = "doc_comment") -> Column:
    return F.when(_t(doc) == "", F.lit("No documentation")).otherwise(F.concat(F.lit("Documentation: "), F.trim(doc)))


def _listed(values: Column, empty: str) -> Column:
    kept = F.filter(values, lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(F.lit(empty))


def parameters(signature: str = "signature") -> Column:
    """What stands between the first and the last parenthesis, cut at commas and trimmed."""
    return F.array_join(F.filter(F.transform(F.split(F.regexp_extract(_t(signature), r"(?s)^[^(]*\((.*)\)", 1), ","), lambda x: F.trim(x)), lambda x: x != ""), ", ")


def return_type(signature: str = "signature") -> Column:
    after = F.regexp_extract(_t(signature), r"(?s)->(.*)$", 1)
    cut = F.when(after.contains("where"), F.split_part(after, F.lit("where"), F.lit(1))).otherwise(F.split_part(after, F.lit("{"), F.lit(1)))
    return F.when(_t(signature).contains("->"), F.trim(cut)).otherwise(F.lit("()"))


def _code_lines(body: str) -> Column:
    return F.filter(F.transform(F.split(_t(body), r"\r?\n"), lambda x: F.trim(x)), lambda x: ~x.rlike(r"^(#\[|///|//!)"))


def _inside(body: str) -> Column:
    """Lines from the first that leaves a brace open."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        depth = acc["depth"] + count(x, "{") - count(x, "}")
        now = acc["open"] | (depth > 0)
        return F.struct(depth.alias("depth"), now.alias("open"), F.when(now, F.array_append(acc["out"], x)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_code_lines(body), start, step, lambda acc: acc["out"])


def fields(body: str = "body_source") -> Column:
    names = F.transform(F.filter(_inside(body), lambda x: x.contains(":") & ~x.startswith("//")), lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1))))
    return _listed(F.filter(names, lambda x: ~x.startswith("where")), "no fields")


def variants(body: str = "body_source") -> Column:
    """Lines that begin in upper case, up to the first of `{`, else `(`, else `=`, else `,` they hold."""
    def name(x):
        out = x
        for c in (",", "=", "(", "{"):
            out = F.when(x.contains(c), F.split_part(x, F.lit(c), F.lit(1))).otherwise(out)
        return F.trim(out)

    return _listed(F.transform(F.filter(_inside(body), lambda x: x.rlike("^[A-Z]")), name), "no variants")


def derived(attributes: str = "attributes") -> Column:
    first = F.get(F.filter(F.col(attributes), lambda a: a.contains("derive") & a.rlike(r"(?s)\(.*\)")), 0)
    return F.coalesce(F.trim(F.regexp_extract(first, r"(?s)^[^(]*\((.*)\)", 1)), F.lit("none"))


def supertraits(signature: str = "signature") -> Column:
    after = F.regexp_extract(_t(signature), r"(?s)^[^:]*:(.*)$", 1)
    return F.trim(F.when(after.contains("{"), F.split_part(after, F.lit("{"), F.lit(1))).otherwise(F.split_part(after, F.lit("where"), F.lit(1))))


def methods(body: str = "body_source") -> Column:
    """Names after `fn`, up to the first `<`, else the first parenthesis."""
    heads = F.transform(F.filter(_code_lines(body), lambda x: x.rlike(r"^(async )?fn ")), lambda x: F.regexp_extract(x, r"^(?:async )?\s*fn (.*)$", 1))
    return _listed(F.transform(heads, lambda x: F.trim(F.when(x.contains("<"), F.split_part(x, F.lit("<"), F.lit(1))).otherwise(F.split_part(x, F.lit("("), F.lit(1))))), "no methods")


def macro_patterns(body: str = "body_source") -> Column:
    """The first patterns inside the outer braces, each a group of braces of its own."""
    inner = F.regexp_extract_all(F.regexp_extract(_t(body), r"(?s)^[^{]*\{(.*)$", 1), F.lit(r"(?s)\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"), F.lit(1))
    kept = F.slice(F.filter(F.transform(inner, lambda x: F.trim(x)), lambda x: x != ""), 1, MACRO_PATTERNS)
    return F.when(F.size(kept) > 0, F.array_join(kept, " | ")).otherwise(F.lit("simplified"))


def _declared(group: int, signature: str = "signature") -> Column:
    """The type (1) or the value (2) of `name: type = value;`."""
    return F.when(_t(signature).rlike(r"(?s)^[^:]*:[^=]*="), F.trim(F.regexp_extract(signature, r"(?s)^[^:]*:([^=]*)=([^;]*)", group))).otherwise(F.lit("unknown"))


def item_text(preview: Column | None = None) -> Column:
    """The text of an item, by its type: a head line, its documentation, and where it stands."""
    vis, name, gen = _t("visibility"), F.col("name"), generics()
    parts = F.split("fqn", "::")
    module = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::")).otherwise(F.col("fqn"))
    place = [F.concat(F.lit("Module: "), module), F.concat(F.lit("Crate: "), F.get(parts, F.lit(0)))]
    doc = documentation()
    join = lambda *x: F.concat_ws("\n", *x)
    braces = lambda x: F.concat(F.lit(" { "), x, F.lit(" }"))
    head = lambda word, *rest: F.concat(vis, F.lit(f" {word} "), name, *rest)
    derive = F.concat(F.lit("Derives: "), derived())
    above = supertraits()
    value = F.concat(F.lit(": "), _declared(1), F.lit(" = "), _declared(2), F.lit(";"))
    alias = F.when(_t("signature").contains("="), F.trim(F.regexp_extract("signature", r"(?s)^[^=]*=([^;]*)", 1))).otherwise(F.lit("unknown"))
    impl = F.trim(F.regexp_replace(F.trim(F.regexp_replace(_t("signature"), "^(impl)+", "")), r"\{+$", ""))
    path = F.regexp_replace(F.trim(F.regexp_replace(_t("signature"), "^(use)+", "")), ";+$", "")
    shown = body_preview("body_source") if preview is None else preview
    kind = F.col("item_type")
    other = F.when(kind == "extern_block", F.lit("extern")).otherwise(kind)
    return (
        F.when(kind == "function", join(F.concat(vis, F.lit(" fn "), name, gen, F.lit("("), parameters(), F.lit(") -> "), return_type()), doc, *place, F.concat(F.lit("Traits used: "), bounds_of()), F.lit("Body preview:"), F.coalesce(shown, F.lit(""))))
        .when(kind == "struct", join(head("struct", gen, braces(fields())), doc, derive, *place))
        .when(kind == "enum", join(head("enum", gen, braces(variants())), doc, derive, *place))
        .when(kind == "trait", join(head("trait", gen, F.when(above != "", F.concat(F.lit(": "), above)).otherwise(F.lit("")), braces(methods())), doc, *place))
        .when(kind == "impl", join(F.concat(F.lit("impl"), gen, F.lit(" "), impl, braces(methods())), doc, *place))
        .when(kind == "type_alias", join(head("type", gen, F.lit(" = "), alias, F.lit(";")), doc, *place))
        .when(kind == "const", join(head("const", value), doc, *place))
        .when(kind == "static", join(head("static", value), doc, *place))
        .when(kind == "macro", join(head("macro_rules!", braces(macro_patterns())), doc, *place))
        .when(kind == "module", join(head("mod"), doc, *place))
        .when(kind == "use", join(F.concat(vis, F.lit(" use "), path), *place))
        .otherwise(join(F.concat(vis, F.lit(" "), other, F.lit(" "), name), doc, F.concat(F.lit("Signature: "), _t("signature")), *place, F.lit("Body:"), _t("body_source")))
    )


def payload(text: Column) -> Column:
    """The fields stored with a vector; lists are JSON texts and null where there is nothing to list."""
    parts = F.split("fqn", "::")
    n = F.size(parts)
    every = F.flatten(F.transform("where_clauses", lambda w: w["bounds"]))
    listed = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    return F.struct(
        "fqn", "name", "item_type", "visibility", F.get(parts, F.lit(0)).alias("crate_name"), F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), n - 1), "::")).alias("module_path"),
        "signature", clip_bytes(_t("doc_comment"), DOC_BYTES).alias("doc_comment"), "start_line", "end_line", clip_bytes(text, TEXT_BYTES).alias("text_preview"),
        (F.size("generic_params") > 0).alias("has_generics"), listed(F.col("generic_params")).alias("generic_params"), listed(every).alias("trait_bounds"),
        listed(F.col("where_clauses")).alias("where_clauses"), listed(F.col("attributes")).alias("attributes"),
    )
