"""From items to a graph: one expression for each family of edges.

items: fqn, name, item_type, visibility, signature, doc_comment, body_source,
attributes (array of texts), generic_params (array of name, kind, bounds, default),
start_line, crate_name and file_path; null texts count as empty.

Names in source text are resolved against small maps that are made unique before
they are joined (a full name, the last segments of one, a name below a module),
so a common name such as `new` adds no rows to a join.  Where several items would
do, the smallest full name is taken.  Edges: src, dst, rel, line, detail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph, crate_of, parent_of, with_placeholders
from .lineage import cut

# Labels of item types, what is no type of the code's own, and words that look like calls.
LABEL_OF = {"function": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "impl": "Impl", "type_alias": "TypeAlias", "const": "Const", "static": "Static", "macro": "Macro", "module": "Module"}
TYPE_ITEMS = ("struct", "enum", "trait", "type_alias")
PLAIN = """i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Vec Option Result Box Rc Arc Cow Cell RefCell""".split()
STANDARD = PLAIN + """Mutex RwLock Weak HashMap HashSet BTreeMap BTreeSet VecDeque LinkedList BinaryHeap PhantomData PhantomPinned Duration
 Instant SystemTime Path PathBuf OsStr OsString IpAddr Ipv4Addr Ipv6Addr SocketAddr Error BoxError io fmt Debug Display Clone Copy Default Eq
 Hash Ord PartialEq PartialOrd Send Sync Sized Unpin From Into TryFrom TryInto AsRef AsMut Deref DerefMut Index IndexMut Add Sub Mul Div Rem
 Neg Not BitAnd BitOr BitXor Fn FnMut FnOnce Future Stream Iterator Self self static dyn""".split()  # fmt: skip
KEYWORDS = """if while for match fn let const static pub mod use struct enum trait impl type async unsafe extern crate self super where return
 break continue yield await move ref mut as in else loop dyn box""".split()  # fmt: skip
# An angle bracket and what it holds, three deep.
_ANGLE = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"
_CALL = rf"((?:[A-Za-z_]|::)[\w:]*)\s*(?:{_ANGLE}\s*)?\("


def label_of(item_type: str = "item_type") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABEL_OF.items() for x in kv])[F.col(item_type)], F.lit("Type"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def bare(name: Column) -> Column:
    """A name without its generic arguments."""
    return F.rtrim(F.split_part(name, F.lit("<"), F.lit(1)))


def _below(module: Column, name: Column) -> Column:
    return F.concat_ws("::", module, name)  # concat_ws leaves a null module out


def is_standard(name: Column) -> Column:
    """Primitive and library types, type parameters, and what starts in lower case."""
    return name.isin(*STANDARD) | name.rlike(r"^\p{Ll}") | (F.length(name) == 1)


def lines_of(items: DataFrame, *keep: str) -> DataFrame:
    """fqn, further columns, line (from 1) and text of each line of a body, trimmed; comments and attributes are left out."""
    body = F.split(F.regexp_replace(_text("body_source"), r"\r?\n$", ""), r"\r?\n")
    rows = items.where(_text("body_source") != "").select("fqn", *keep, F.posexplode(body).alias("at", "text"))
    rows = rows.select("fqn", *keep, (F.col("at") + 1).alias("line"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))
    return rows.where(~F.col("text").rlike(r"^(//|#)"))


def _edges(df: DataFrame, src, dst, rel: str, line=None, detail=None) -> DataFrame:
    nothing = F.lit(None)
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), (nothing if line is None else line).cast("int").alias("line"), (nothing if detail is None else detail).cast("string").alias("detail"))


def linked(items: DataFrame, files: DataFrame) -> DataFrame:
    """items with source_file_id: the file(id, module_path, file_path) of their path, else that of the longest module path their name begins with; null if there is none."""
    by_path = files.groupBy("file_path").agg(F.min("id").alias("_by_path"))
    by_module = files.groupBy(F.col("module_path").alias("_module")).agg(F.min("id").alias("_by_module"))
    rows = items.join(by_path, "file_path", "left")
    parts = F.split("fqn", "::")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "::"))
    # Joined by equal module paths, of which an item has as many as its name has parts.
    near = rows.where("_by_path IS NULL").select("fqn", F.explode(above).alias("_module")).distinct().join(by_module, "_module")
    near = near.groupBy("fqn").agg(F.max_by("_by_module", F.length("_module")).alias("_by_module"))
    return rows.join(near, "fqn", "left").withColumn("source_file_id", F.coalesce("_by_path", "_by_module")).drop("_by_path", "_by_module")


# -- nodes and containment -------------------------------------------------


def nodes_of(items: DataFrame) -> DataFrame:
    """A node for each item and crate; properties of rows that bear one full name and label overlay each other, later lines last."""
    own = items.select("fqn", "name", label_of().alias("label"), "file_path", F.col("start_line").cast("long").alias("start_line"), "visibility")
    crates = items.select(F.coalesce("crate_name", crate_of("fqn")).alias("c")).distinct()
    crates = crates.select(F.col("c").alias("fqn"), F.col("c").alias("name"), F.lit("Crate").alias("label"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("long").alias("start_line"), F.lit(None).cast("string").alias("visibility"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.coalesce("start_line", F.lit(0)))).alias(c)
    return own.unionByName(crates).groupBy("fqn", "label").agg(last("name"), last("file_path"), F.max("start_line").alias("start_line"), last("visibility")).select("fqn", "name", "label", "file_path", "start_line", "visibility")


def contains(items: DataFrame) -> DataFrame:
    """Parent to item: a known crate to what stands at its root, a module (whether it has a node or not) to the rest."""
    crates = items.select(F.coalesce("crate_name", crate_of("fqn")).alias("parent")).distinct()
    rows = items.select("fqn", parent_of("fqn").alias("parent")).where("parent IS NOT NULL")
    root = ~F.col("parent").contains("::")
    at_root = rows.where(root).join(crates, "parent", "left_semi").select("fqn", "parent")
    every = at_root.withColumn("kind", F.lit("Crate")).unionByName(rows.where(~root).withColumn("kind", F.lit("Module")))
    return _edges(every, F.col("parent"), F.col("fqn"), "CONTAINS", detail=F.col("kind"))


def has_method(items: DataFrame) -> DataFrame:
    """Traits to the functions directly below them; a method without a body is required."""
    traits = items.where("item_type = 'trait'").select(F.col("fqn").alias("parent")).distinct()
    rows = items.where("item_type = 'function'").select("fqn", parent_of("fqn").alias("parent"), F.trim(_text("body_source")).isin("", ";").alias("required"))
    return _edges(rows.join(traits, "parent"), F.col("parent"), F.col("fqn"), "HAS_METHOD", detail=F.col("required"))


# -- traits ------------------------------------------------------------------


def trait_names(items: DataFrame) -> DataFrame:
    """One full name for each name of a trait."""
    return items.where("item_type = 'trait'").groupBy(F.col("name").alias("known")).agg(F.min("fqn").alias("known_fqn"))


def resolved_trait(rows: DataFrame, name: str, near: str, known: DataFrame) -> DataFrame:
    """rows with trait_fqn: a trait of that name, of the name without generics, or a guess beside the item `near`."""
    plain = known.select(F.col("known").alias("k2"), F.col("known_fqn").alias("f2"))
    out = rows.join(known, F.col(name) == F.col("known"), "left").join(plain, bare(F.col(name)) == F.col("k2"), "left")
    module = parent_of(near)
    guess = F.when(module.isNotNull(), F.concat(module, F.lit("::"), bare(F.col(name)))).otherwise(F.col(name))
    return out.withColumn("trait_fqn", F.coalesce("known_fqn", "f2", guess)).drop("known", "known_fqn", "k2", "f2")


def trait_of(attributes: str = "attributes") -> Column:
    """The trait that an impl's attributes name first; null for an inherent one."""
    named = F.filter(F.coalesce(F.col(attributes), F.array().cast("array<string>")), lambda a: a.startswith("impl_for="))
    return F.substring(F.get(named, 0), len("impl_for=") + 1, 1 << 30)


def implements(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IMPLEMENTS edges, FOR edges, and the nodes of traits that are no items."""
    impls = items.where("item_type = 'impl'").select("fqn", "name", trait_of().alias("trait"))
    rows = resolved_trait(impls.where("trait IS NOT NULL"), "trait", "fqn", trait_names(items))
    local = items.where("item_type = 'trait'").select(F.col("fqn").alias("trait_fqn")).distinct()
    outside = rows.join(local, "trait_fqn", "left_anti").groupBy(F.col("trait_fqn").alias("fqn")).agg(F.min("trait").alias("name"))
    outside = outside.select("fqn", "name", F.lit("Trait").alias("label"), F.lit(True).alias("external"))
    own = F.when(F.col("name").contains("_"), F.regexp_extract("name", r"^[^_]*_(.*)$", 1)).otherwise(F.col("name"))
    return _edges(rows, F.col("fqn"), F.col("trait_fqn"), "IMPLEMENTS"), _edges(impls, F.col("fqn"), _below(parent_of("fqn"), own), "FOR"), outside


def extends(items: DataFrame) -> DataFrame:
    """Traits to the traits that bound their type parameters; bounds in lower case don't count."""
    params = items.where("item_type = 'trait'").select("fqn", F.explode("generic_params").alias("p")).where("p.kind = 'type'")
    bounds = params.select("fqn", F.explode("p.bounds").alias("bound")).where(~F.col("bound").rlike(r"^\p{Ll}"))
    return _edges(resolved_trait(bounds, "bound", "fqn", trait_names(items)), F.col("fqn"), F.col("trait_fqn"), "EXTENDS")


# -- fields and variants -----------------------------------------------------


def fields(items: DataFrame) -> DataFrame:
    """Structs to the types of their private fields, one line each; lines that begin with `pub ` or a closing brace are no fields."""
    rows = lines_of(items.where("item_type = 'struct'")).where(~F.col("text").rlike(r"^(pub |\})") & F.col("text").contains(":"))
    name = F.trim(F.split_part("text", F.lit(":"), F.lit(1)))
    kind = F.trim(F.split_part(F.regexp_extract("text", r"^[^:]*:(.*)$", 1), F.lit(","), F.lit(1)))
    rows = rows.select("fqn", "line", name.alias("field"), kind.alias("kind")).where("field <> '' AND kind <> ''")
    as_is = F.col("kind").isin(*PLAIN) | F.col("kind").rlike(r"^\p{Ll}") | F.col("kind").contains("::")
    return _edges(rows, F.col("fqn"), F.when(as_is, F.col("kind")).otherwise(_below(parent_of("fqn"), F.col("kind"))), "HAS_FIELD", F.col("line"), F.col("field"))


def variants(items: DataFrame) -> DataFrame:
    """Enums to themselves, an edge for each variant, one line each."""
    rows = lines_of(items.where("item_type = 'enum'")).where(~F.col("text").rlike(r"^[{}]"))
    name = F.trim(F.regexp_extract(F.split_part("text", F.lit(","), F.lit(1)), r"^([^({]*)", 1))
    return _edges(rows.withColumn("v", name).where("v <> ''"), F.col("fqn"), F.col("fqn"), "HAS_VARIANT", F.col("line"), F.col("v"))


# -- calls ---------------------------------------------------------------------


def suffixes(functions: DataFrame) -> DataFrame:
    """tail, tail_fqn: for each `::a::b` that ends a function's full name, one such function."""
    parts = F.split("fqn", "::")
    n = F.size(parts)
    tails = F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda k: F.when(k < n, F.array_join(F.slice(parts, n - k + 1, k), "::")))
    return functions.select("fqn", F.explode(F.array_compact(tails)).alias("tail")).groupBy("tail").agg(F.min("fqn").alias("tail_fqn"))


def named_below(rows: DataFrame, keep: str = "name") -> DataFrame:
    """module, name, inside: for each module and name, one item of that name anywhere below the module."""
    parts = F.split("fqn", "::")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "::"))
    return rows.where(F.col("fqn").contains("::")).select("fqn", keep, F.explode(above).alias("module")).groupBy("module", keep).agg(F.min("fqn").alias("inside"))


def loose_targets(targets: DataFrame, functions: DataFrame) -> DataFrame:
    """target, loose: for targets(target, name, front) the least full name of a function of that name with the front somewhere inside.

    A front begins at a `::`, so a full name holds it if it stands at one of its
    own.  Functions are cut there to the lengths that fronts of their name have,
    and joined by equal texts: a common name costs its functions and its targets,
    not their pairs.
    """
    sizes = targets.select("name", F.length("front").alias("size")).distinct()
    rows = functions.join(sizes, "name")
    starts = F.filter(F.sequence(F.lit(1), F.length("fqn")), lambda i: F.substring(F.col("fqn"), i, F.lit(2)) == "::")
    cuts = rows.select("name", "fqn", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("fqn"), i, F.col("size"))))).alias("front"), "size")
    least = cuts.where(F.length("front") == F.col("size")).groupBy("name", "front").agg(F.min("fqn").alias("loose"))
    return targets.join(least, ["name", "front"]).select("target", "loose")


def resolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls(fqn, line, target) with callee, for the targets that lead to a function.

    A bare name leads to a function below the caller's module, or to any of that
    name.  A path leads to the function it names in full, to that below the
    caller's module, to one that ends in it, or to one of its name with the path's
    front somewhere inside; never to one that merely bears the name.  A call with
    type arguments leads nowhere, as these are taken for a part of its path.
    """
    functions = functions.select("fqn", "name").distinct()
    full = functions.select(F.col("fqn").alias("exact")).distinct()
    rows = calls.withColumn("module", parent_of("fqn")).withColumn("path", F.col("target").contains("::"))
    plain, paths = rows.where(~F.col("path")), rows.where("path")
    some = functions.groupBy("name").agg(F.min("fqn").alias("some"))
    near = named_below(functions)
    plain = plain.join(near.withColumnRenamed("name", "target"), ["module", "target"], "left").join(some.withColumnRenamed("name", "target"), "target", "left")
    plain = plain.withColumn("callee", F.coalesce("inside", "some"))
    paths = paths.join(full, F.col("target") == F.col("exact"), "left")
    paths = paths.join(full.select(F.col("exact").alias("beside")), _below(F.col("module"), F.col("target")) == F.col("beside"), "left")
    paths = paths.join(suffixes(functions), F.col("target") == F.col("tail"), "left").withColumn("callee", F.coalesce("exact", "beside", "tail_fqn"))
    open_ = paths.where("callee IS NULL").select("target").distinct().withColumn("name", F.regexp_extract("target", r"([^:]*)$", 1))
    open_ = open_.where("name <> ''").withColumn("front", F.concat(F.lit("::"), F.regexp_extract("target", r"^(.*)::[^:]*$", 1)))
    paths = paths.join(loose_targets(open_, functions), "target", "left").withColumn("callee", F.coalesce("callee", "loose"))
    return plain.select("fqn", "line", "target", "callee").unionByName(paths.select("fqn", "line", "target", "callee")).where("callee IS NOT NULL AND callee <> fqn")


def static_calls(items: DataFrame) -> DataFrame:
    """fqn, line, target of what looks like a call in a function's body."""
    found = lines_of(items.where("item_type = 'function'")).select("fqn", "line", F.explode(F.regexp_extract_all("text", F.lit(_CALL), F.lit(1))).alias("target"))
    return found.where(~F.col("target").isin(*KEYWORDS))


def method_calls(items: DataFrame, functions: DataFrame) -> DataFrame:
    """fqn, line, callee of calls on `self` and on variables whose type a `let` tells: by annotation or constructor, the last one of a variable."""
    functions_ = items.where("item_type = 'function'")
    self_type = F.substring(F.get(F.filter(F.coalesce(F.col("attributes"), F.array().cast("array<string>")), lambda a: a.startswith("impl_type=")), 0), len("impl_type=") + 1, 1 << 30)
    lines = lines_of(functions_.withColumn("self_type", self_type), "self_type")
    typed, made = r"let\s+(?:mut\s+)?(\w+)\s*:\s*([A-Z]\w+)", r"let\s+(?:mut\s+)?(\w+)\s*=\s*([A-Z]\w+)::"
    either = lambda k: F.coalesce(F.nullif(F.regexp_extract("text", typed, k), F.lit("")), F.regexp_extract("text", made, k))
    told = lines.select("fqn", "line", either(1).alias("receiver"), either(2).alias("kind")).where("receiver <> '' AND kind <> ''")
    told = told.groupBy("fqn", "receiver").agg(F.max_by("kind", "line").alias("kind"))
    use = F.lit(r"(\w+)\.(\w+)\s*\(")
    uses = F.arrays_zip(F.regexp_extract_all("text", use, F.lit(1)).alias("r"), F.regexp_extract_all("text", use, F.lit(2)).alias("m"))
    calls = lines.select("fqn", "line", "self_type", F.explode(uses).alias("u")).select("fqn", "line", "self_type", F.col("u.r").alias("receiver"), F.col("u.m").alias("method"))
    calls = calls.join(told, ["fqn", "receiver"], "left")
    own = F.when(F.col("receiver").isin("self", "Self"), F.col("self_type")).otherwise(F.col("kind"))
    calls = calls.withColumn("tail", F.concat_ws("::", own, "method")).where(own.isNotNull())
    return calls.join(suffixes(functions), "tail").select("fqn", "line", F.col("tail_fqn").alias("callee"))


def calls(items: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """CALLS edges: known call sites(caller_fqn, callee_fqn, line_number, dispatch) first; for callers without any, what their text shows."""
    functions = items.where("item_type = 'function'").select("fqn", "name")
    rest, known = items, None
    if sites is not None:
        known = _edges(sites, F.col("caller_fqn"), F.col("callee_fqn"), "CALLS", F.col("line_number"), F.col("dispatch"))
        rest = items.join(sites.select(F.col("caller_fqn").alias("fqn")).distinct(), "fqn", "left_anti")
    static = cut(resolved_calls(static_calls(rest), functions))  # used twice
    dynamic = method_calls(rest, functions).join(static.select("fqn", "callee").distinct(), ["fqn", "callee"], "left_anti")
    out = _edges(static, F.col("fqn"), F.col("callee"), "CALLS", F.col("line"), F.lit("static")).unionByName(_edges(dynamic, F.col("fqn"), F.col("callee"), "CALLS", F.col("line"), F.lit("dynamic")))
    return out if known is None else known.unionByName(out)


def dispatched(calls_: DataFrame, methods: DataFrame) -> DataFrame:
    """caller_fqn, callee_fqn, dispatch of calls_(caller_fqn, callee, receiver, method).

    A call by path is static.  A method call on a type that methods(self_type,
    method, impl_fqn) knows gives two rows, the impl's method as static and the
    type's own as trait; any other method call is dynamic.
    """
    by_path = calls_.where("receiver IS NULL").select("caller_fqn", F.col("callee").alias("callee_fqn"), F.lit("static").alias("dispatch"))
    known = methods.select(F.col("self_type").alias("receiver"), "method", "impl_fqn").distinct()
    rows = calls_.where("receiver IS NOT NULL").join(known, ["receiver", "method"], "left")
    own = F.concat_ws("::", "receiver", "method")
    pair = lambda c, d: F.struct(c.alias("callee_fqn"), F.lit(d).alias("dispatch"))
    both = F.when(F.col("impl_fqn").isNotNull(), F.array(pair(F.concat_ws("::", "impl_fqn", "method"), "static"), pair(own, "trait"))).otherwise(F.array(pair(own, "dynamic")))
    return by_path.unionByName(rows.select("caller_fqn", F.explode(both).alias("x")).select("caller_fqn", "x.callee_fqn", "x.dispatch")).distinct()


# -- types ---------------------------------------------------------------------


def type_names_in(text: Column) -> Column:
    """Names of types in a type expression: without references, lifetimes and brackets; library types and parameters don't count."""
    plain = F.regexp_replace(F.regexp_replace(text, r"'\w+", " "), r"\b(mut|dyn|impl)\b", " ")
    names = F.transform(F.split(plain, r"[<>,;&()\[\]{}=+*]"), lambda x: F.trim(x))
    return F.filter(names, lambda x: (x != "") & x.rlike(r"^[\w:]+$") & ~x.rlike(r"^[\d:]") & ~is_standard(x))


def types_of_signature(signature: Column) -> Column:
    """(type, place) pairs of a function's signature; place is parameter or return."""
    before = F.split_part(signature, F.lit("->"), F.lit(1))
    params = F.regexp_replace(F.regexp_extract(before, r"\((.*)\)", 1), r"\b\w+\s*:(?!:)", ",")
    back = F.regexp_replace(F.regexp_extract(signature, r"->(.*)$", 1), r"\swhere\b.*$|[;{].*$", "")
    pair = lambda place: lambda x: F.struct(x.alias("type"), F.lit(place).alias("place"))
    return F.concat(F.transform(type_names_in(params), pair("parameter")), F.transform(type_names_in(back), pair("return")))


def types_of_impl(signature: Column) -> Column:
    """(type, place) pairs of an impl's signature: its trait, and the type it is for."""
    head = F.regexp_replace(F.trim(signature), rf"^(unsafe\s+)?impl\s*(?:{_ANGLE})?\s*", "")
    head = F.trim(F.regexp_replace(head, r"\swhere\b.*$|\{.*$", ""))
    two = head.contains(" for ")
    trait, own = bare(F.split_part(head, F.lit(" for "), F.lit(1))), F.when(two, bare(F.regexp_extract(head, r" for (.*)$", 1))).otherwise(bare(head))
    both = F.array(F.struct(F.when(two, F.trim(trait)).alias("type"), F.lit("impl_trait").alias("place")), F.struct(F.trim(own).alias("type"), F.lit("impl_self_type").alias("place")))
    return F.filter(both, lambda x: x["type"].isNotNull() & (x["type"] != "") & ~is_standard(x["type"]))


def types_of_line(text: Column) -> Column:
    """Types in a line of code: before a path's first `::`, annotations of `let`, casts, and what is built with braces."""
    path = F.array(F.regexp_extract(text, r"(\w+)::", 1))
    let = F.when(text.rlike(r"\blet\b[^=:]*:(?!:)"), type_names_in(F.regexp_extract(text, r"\blet\b[^=:]*:([^=]*)", 1))).otherwise(F.array().cast("array<string>"))
    cast = F.array(F.regexp_extract(text, r" as ([\w:<>]+)", 1))
    built = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z0-9_]*)\s*\{"), F.lit(1))
    return F.filter(F.concat(path, let, cast, built), lambda x: (x != "") & ~x.isin("self", "super", "crate", "Self") & ~is_standard(x))


def uses_type(items: DataFrame) -> DataFrame:
    """USES_TYPE edges of functions (signature and body) and impls (signature).

    A type name leads to the full name it is, itself if it is a path, a type below
    the item's module, any type of the name, or a guess beside the item.  In a body
    each name counts once, where it stands first.
    """
    types = items.where(F.col("item_type").isin(*TYPE_ITEMS)).select("fqn", "name").distinct()
    functions = items.where("item_type = 'function'")
    signed = functions.select("fqn", F.col("start_line").alias("line"), F.explode(types_of_signature(_text("signature"))).alias("t"))
    impls = items.where("item_type = 'impl'").select("fqn", F.col("start_line").alias("line"), F.explode(types_of_impl(_text("signature"))).alias("t"))
    inside = lines_of(functions).select("fqn", "line", F.explode(types_of_line(F.col("text"))).alias("type"))
    inside = inside.groupBy("fqn", F.lower("type").alias("_low")).agg(F.min(F.struct("line", "type")).alias("one")).select("fqn", "one.line", "one.type", F.lit("body").alias("place"))
    rows = signed.union(impls).select("fqn", F.col("line").cast("int").alias("line"), "t.type", "t.place").unionByName(inside.select("fqn", F.col("line").cast("int").alias("line"), "type", "place"))
    rows = rows.withColumn("module", parent_of("fqn"))
    some = types.groupBy(F.col("name").alias("type")).agg(F.min("fqn").alias("some"))
    near = named_below(types).withColumnRenamed("name", "type")
    exact = types.select(F.col("fqn").alias("exact")).distinct()
    rows = rows.join(exact, F.col("type") == F.col("exact"), "left").join(near, ["module", "type"], "left").join(some, "type", "left")
    target = F.coalesce("exact", F.when(F.col("type").contains("::"), F.col("type")), "inside", "some", _below(F.col("module"), F.col("type")))
    return _edges(rows, F.col("fqn"), target, "USES_TYPE", F.col("line"), F.col("place"))


# -- crates ----------------------------------------------------------------------


def dependencies(manifests: DataFrame, crates: DataFrame) -> DataFrame:
    """DEPENDS_ON edges from manifests(crate_name, content): the named dependencies that are crates(crate_name) of the workspace, `-` and `_` alike."""
    sections = manifests.select("crate_name", F.explode(F.split(F.concat(F.lit("\n"), "content"), r"\n\s*\[")).alias("part"))
    head = F.trim(F.regexp_extract("part", r"^([^\]\n]*)\]", 1))
    kinds = {"dependencies": "", "dev-dependencies": "dev", "build-dependencies": "build"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    deep = F.regexp_extract(head, r"^((?:dev-|build-)?dependencies)\.\"?([\w-]+)", 2)  # a section of its own for one dependency
    top = F.regexp_extract(head, r"^((?:dev-|build-)?dependencies)", 1)
    rows = sections.select("crate_name", head.alias("head"), top.alias("top"), deep.alias("deep"), F.split("part", r"\n").alias("lines"))
    rows = rows.where((F.col("head") == F.col("top")) | (F.col("deep") != "")).where("top <> ''")
    named = F.filter(F.transform("lines", lambda x: F.regexp_extract(x, r"^\s*\"?([A-Za-z][\w-]*)\"?(?:\.\w+)*\s*=", 1)), lambda x: x != "")
    rows = rows.select("crate_name", kind[F.col("top")].alias("kind"), F.explode(F.when(F.col("deep") != "", F.array("deep")).otherwise(named)).alias("dep"))
    known = crates.select(F.col("crate_name").alias("target"), F.replace("crate_name", F.lit("-"), F.lit("_")).alias("key")).distinct()
    rows = rows.withColumn("key", F.replace("dep", F.lit("-"), F.lit("_"))).join(known, "key").where("target <> crate_name")
    return _edges(rows.distinct(), F.col("crate_name"), F.col("target"), "DEPENDS_ON", detail=F.col("kind"))


def raw_edges(items: DataFrame, sites: DataFrame | None = None, manifests: DataFrame | None = None) -> DataFrame:
    """All edges as their families give them, with `origin`, the family's place in the order they are stored in."""
    implement, own, _ = implements(items)
    parts = [contains(items), implement, own, fields(items), variants(items), extends(items), calls(items, sites), uses_type(items), has_method(items)]
    if manifests is not None:
        parts.append(dependencies(manifests, items.select(F.coalesce("crate_name", crate_of("fqn")).alias("crate_name")).distinct()))
    return reduce(DataFrame.unionByName, [p.withColumn("origin", F.lit(i)) for i, p in enumerate(parts)])


def graph(items: DataFrame, sites: DataFrame | None = None, manifests: DataFrame | None = None) -> Graph:
    """The graph of items, settled: one edge for each (src, rel, dst), with the line and detail of its last site, and placeholder nodes for types and traits that are no items."""
    nodes = nodes_of(items).withColumn("external", F.lit(False)).unionByName(implements(items)[2], allowMissingColumns=True)
    edges = cut(raw_edges(items, sites, manifests))
    order = F.struct("origin", F.coalesce("line", F.lit(-1)), F.coalesce("detail", F.lit("")))
    out = with_placeholders(nodes, edges, order=order)
    return Graph(out.nodes, out.edges.drop("origin"))
