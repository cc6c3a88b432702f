"""What patterns find in source text: trait impls, calls with type arguments, derived impls, self types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of an impl of a trait, of calls with type arguments on functions and methods, of derive attributes
# and of the types below them, and the bytes of a file beyond which only patterns are used.
IMPL = r"impl\s*(?:<[^>]*>)?\s*(\w+(?:::\w+)*)\s+for\s+([^\{]+)"
CALL, METHOD = r"(\w+(?:::\w+)*)::<([^>]+)>", r"\.(\w+)::<([^>]+)>"
DERIVE, TYPE = r"#\[derive\(([^)]*)\)\]", r"(?:struct|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"
DERIVE_LINES, PATTERN_BYTES = 5, 10_000_000


def _lines(files: DataFrame, *keep: str) -> DataFrame:
    rows = files.select(*keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "source"))
    return rows.select(*keep, (F.col("at") + 1).cast("int").alias("line_number"), "source")


def trait_impls(files: DataFrame) -> DataFrame:
    """trait_fqn, self_type, impl_fqn, file_path, line_number, quality of the impls that files(module_path, file_path, text) show, one a line."""
    rows = _lines(files, "module_path", "file_path").where(F.col("source").rlike(IMPL))
    rows = rows.withColumn("trait_fqn", F.regexp_extract("source", IMPL, 1)).withColumn("self_type", F.trim(F.regexp_extract("source", IMPL, 2)))
    name = F.concat("module_path", F.lit("::"), "trait_fqn", F.lit("_"), "self_type")
    return rows.select("trait_fqn", "self_type", name.alias("impl_fqn"), "file_path", "line_number", F.lit("heuristic").alias("quality"))


def type_args(text: Column) -> Column:
    """Type arguments in a text, cut at commas outside angle brackets; the text ends at the first closing one."""
    head = F.split_part(text, F.lit("<"), F.lit(1))
    parts = F.split(head, ",")
    rest = F.substr(text, F.length(head) + 1)
    whole = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.concat(F.element_at(parts, -1), rest)))
    return F.filter(F.transform(whole, lambda x: F.trim(x)), lambda x: x != "")


def typed_calls(files: DataFrame) -> DataFrame:
    """Call sites with type arguments in files(file_path, text, caller); a method's callee is `unknown::name`, and no caller is an empty one.

    A method call with type arguments fits the pattern of functions as well, so it is found twice, as static and as dynamic.
    """
    rows = _lines(files.withColumn("caller_fqn", F.coalesce("caller", F.lit(""))), "file_path", "caller_fqn")

    def found(pattern, dispatch, front):
        hits = F.arrays_zip(F.regexp_extract_all("source", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("source", F.lit(pattern), F.lit(2)).alias("args"))
        one = rows.select("*", F.explode(hits).alias("h")).withColumn("concrete_type_args", type_args(F.col("h.args")))
        return one.select("caller_fqn", F.concat(F.lit(front), "h.name").alias("callee_fqn"), "file_path", "line_number", "concrete_type_args", (F.size("concrete_type_args") > 0).alias("is_monomorphized"), F.lit("heuristic").alias("quality"), F.lit(dispatch).alias("dispatch"))

    return found(CALL, "static", "").unionByName(found(METHOD, "dynamic", "unknown::"))


def derives(files: DataFrame) -> DataFrame:
    """key, type_name, trait_name for each trait that a derive attribute names and the struct or enum on its line or the four after it, of files(key, text)."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    near = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, DERIVE, 1).alias("traits"), F.regexp_extract(F.array_join(F.slice(lines, i + 1, DERIVE_LINES), "\n"), TYPE, 1).alias("type_name")))
    rows = files.select("key", F.explode(near).alias("d")).where("d.traits <> '' AND d.type_name <> ''")
    rows = rows.select("key", "d.type_name", F.explode(F.split("d.traits", ",")).alias("t"))
    return rows.select("key", "type_name", F.trim(F.substring_index("t", "::", -1)).alias("trait_name")).where("trait_name <> ''").distinct()


def generated_impls(original: DataFrame, expanded: DataFrame) -> DataFrame:
    """key, impl, generated_by: impls in expanded files that a derive attribute of the same original file accounts for."""
    impls = _lines(expanded, "key").where(F.col("source").rlike(IMPL))
    name, own = F.regexp_extract("source", IMPL, 1), F.regexp_extract("source", IMPL, 2)
    impls = impls.select("key", name.alias("trait_name"), F.trim(F.split_part(own, F.lit("<"), F.lit(1))).alias("type_name"))
    both = impls.join(derives(original), ["key", "type_name", "trait_name"])
    return both.select("key", F.concat_ws(" for ", "trait_name", "type_name").alias("impl"), F.format_string("derive(%s)", "trait_name").alias("generated_by")).distinct()


def callers_of_files(items: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, caller (the first of the functions that may be meant, in order of names), how many there are, and whether patterns alone are used.

    May be meant all functions of the file's crate: those below its module path are among them.
    """
    by = items.where("item_type = 'function'").groupBy(F.split_part("fqn", F.lit("::"), F.lit(1)).alias("crate_name")).agg(F.min("fqn").alias("caller"), F.count_distinct("fqn").alias("candidates"))
    out = files.join(by, "crate_name", "left")
    return out.select("file_path", "caller", F.coalesce("candidates", F.lit(0)).alias("candidates"), (F.octet_length("text") > PATTERN_BYTES).alias("patterns_only"))


_ANGLE = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"


def self_type(name: str = "name", signature: str = "signature") -> Column:
    """The type an impl is for: from its signature without generics; else what follows the last `_` of its name if that is upper case, else the name."""
    sig = F.trim(F.coalesce(F.col(signature), F.lit("")))
    rest = F.trim(F.regexp_replace(sig, rf"^(?:unsafe\s+)?impl\s*(?:{_ANGLE})?", ""))
    part = F.when(rest.contains(" for "), F.regexp_extract(rest, r" for \s*(.*)$", 1)).otherwise(rest)
    kind = F.when(part.contains("<"), F.trim(F.split_part(part, F.lit("<"), F.lit(1)))).otherwise(F.split_part(F.trim(part), F.lit(" "), F.lit(1)))
    after = F.regexp_extract(F.col(name), r"_([^_]*)$", 1)
    fallback = F.when(after.rlike(r"^\p{Lu}"), after).otherwise(F.col(name))
    return F.when(sig.rlike(r"^(unsafe\s+)?impl"), F.coalesce(F.nullif(kind, F.lit("")), fallback)).otherwise(fallback)


def method_prefix(fqn: str = "fqn", name: str = "name", signature: str = "signature") -> Column:
    """What the full names of an impl's methods begin with: its module, the type, and a separator."""
    f, n = F.col(fqn), F.col(name)
    module = F.when(f.endswith(F.concat(F.lit("::"), n)), F.substr(f, F.lit(1), F.length(f) - F.length(n) - 2)).otherwise(F.regexp_extract(f, r"^(.*)::[^:]*$", 1))
    return F.concat_ws("::", F.nullif(module, F.lit("")), self_type(name, signature), F.lit(""))
