"""Queries on code items: the driver's tables as a made-up code base, and SQL that knows what was put into it.

Nations are modules of their region's crate, suppliers structs with two methods and an
impl, customers functions that call each other, brands traits; call sites and trait
implementations are lineitems and suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import extract, itemtext, parse
from .functions import scalar as S
from .operators import embedding, listing
from .plans import build
from .plans.graph import dangling
from .suite import SQL, query, t

ITEMS = """WITH nc AS (SELECT count(*) AS nc FROM customer), ns AS (SELECT count(*) AS ns FROM supplier),
mo AS (SELECT n_nationkey AS y, 'r' || n_regionkey || '::n' || n_nationkey AS m FROM nation),
cu AS (SELECT c_custkey AS c, m || '::f' || c_custkey AS fqn, m, y, c_custkey % ns AS s, (c_custkey * 13 + 1) % nc AS o FROM customer JOIN mo ON c_nationkey = y, nc, ns),
su AS (SELECT s_suppkey AS s, m || '::S' || s_suppkey AS fqn, m, y, s_suppkey % 25 + 1 AS b FROM supplier JOIN mo ON s_nationkey = y),
br AS (SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS b FROM part)
"""
_ITEM = ("fqn", "name", "item_type", "visibility", "signature", "doc_comment", "body_source", "attributes", "generic_params", "where_clauses", "start_line", "end_line", "crate_name", "file_path")


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in parts])


def _tables(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("y"), _cat("r", [F.col("n_regionkey")], "::n", [F.col("n_nationkey")]).alias("m"))
    many = t(s, d, "customer").agg(F.count("*").alias("nc")).crossJoin(t(s, d, "supplier").agg(F.count("*").alias("ns")))
    c = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("y")).crossJoin(many)
    c = c.select(F.col("c_custkey").alias("c"), "m", "y", (F.col("c_custkey") % F.col("ns")).alias("s"), ((F.col("c_custkey") * 13 + 1) % F.col("nc")).alias("o"))
    u = t(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("y")).select(F.col("s_suppkey").alias("s"), "m", "y", (F.col("s_suppkey") % 25 + 1).alias("b"))
    b = t(s, d, "part").select(F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("long").alias("b")).distinct()
    return n, c, u, b


def items(s, d):
    """The items of the code base."""
    n, c, u, b = _tables(s, d)
    no_params = "array<struct<name: string, kind: string, bounds: array<string>, default: string>>"
    no_where = "array<struct<subject: string, bounds: array<string>>>"

    def rows(df, fqn, kind, signature="", body="", attributes=(), doc="", line=None, params=None):
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        made = {
            "fqn": fqn, "name": F.substring_index(fqn, "::", -1), "item_type": F.lit(kind), "visibility": F.lit("pub"), "signature": text(signature), "doc_comment": text(doc), "body_source": text(body),
            "attributes": F.array(*[text(a) for a in attributes]).cast("array<string>"), "generic_params": (F.array() if params is None else params).cast(no_params), "where_clauses": F.array().cast(no_where),
            "start_line": (F.lit(1) if line is None else line).cast("int"), "end_line": (F.lit(9) if line is None else line + 8).cast("int"), "crate_name": F.split_part(fqn, F.lit("::"), F.lit(1)), "file_path": F.lit("src/lib.rs"),
        }
        return df.select(*[made[k].alias(k) for k in _ITEM])

    k, y, cc = [F.col("s")], [F.col("y")], [F.col("c")]
    own = _cat([F.col("m")], "::S", k)
    parts = [
        rows(n, F.col("m"), "module"),
        rows(u, own, "struct", _cat("pub struct S", k), _cat("pub struct S", k, " {\n    owner: N", y, ",\n    name: String,\n    pub key: u64,\n}"), ["#[derive(Debug, Clone)]"], _cat(" Struct ", k, ". "), F.col("s") % 500),
        rows(n, _cat([F.col("m")], "::E", y), "enum", _cat("pub enum E", y), _cat("{\n    A", y, ",\n    B(u8),\n    // C,\n}")),
        rows(b, _cat("t::T", [F.col("b")]), "trait", _cat("pub trait T", [F.col("b")]), "{\n    fn go(&self);\n}", params=F.array(F.struct(F.lit("U").alias("name"), F.lit("type").alias("kind"), F.array(_cat("T", [F.col("b") % 25 + 1]), F.lit("lower")).alias("bounds"), F.lit(None).cast("string").alias("default")))),
        rows(b, _cat("t::T", [F.col("b")], "::go"), "function", "fn go(&self)", F.when(F.col("b") % 2 == 0, "").otherwise("{ }")),
        rows(u, _cat([F.col("m")], "::T", [F.col("b")], "_S", k), "impl", _cat("impl T", [F.col("b")], " for S", k), "", [_cat("impl_for=T", [F.col("b")], [F.when(F.col("s") % 2 == 0, "<u8>").otherwise("")])]),
        rows(u, F.concat(own, F.lit("::new")), "function", "fn new() -> Self", ""),
        rows(u, F.concat(own, F.lit("::size")), "function", "fn size(&self) -> usize", ""),
        rows(c, _cat([F.col("m")], "::f", cc), "function", _cat("fn f", cc, "(a: &S", k, ", n: u64) -> Option<E", y, ">"), _cat("let s: S", k, " = S", k, "::new();\nf", [F.col("o")], "(1);\ns.size();"), line=F.col("c") % 500 + 1),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _q(name, sql, f):
    query(name, ITEMS + sql)(lambda s, d: f(items(s, d)))


def _edge(df):
    return df.select("src", "dst", "line", "detail")


_q("build_contains", """SELECT split_part(m, '::', 1) AS src, m AS dst, 'Crate' AS detail FROM mo UNION ALL SELECT m, fqn, 'Module' FROM su UNION ALL SELECT m, m || '::E' || y, 'Module' FROM mo UNION ALL SELECT 't', 't::T' || b, 'Crate' FROM br
 UNION ALL SELECT 't::T' || b, 't::T' || b || '::go', 'Module' FROM br UNION ALL SELECT m, m || '::T' || b || '_S' || s, 'Module' FROM su UNION ALL SELECT fqn, fqn || '::new', 'Module' FROM su UNION ALL SELECT fqn, fqn || '::size', 'Module' FROM su UNION ALL SELECT m, fqn, 'Module' FROM cu""", lambda i: build.contains(i).select("src", "dst", "detail"))
_q("build_has_method", "SELECT 't::T' || b AS src, 't::T' || b || '::go' AS dst, CASE WHEN b % 2 = 0 THEN 'true' ELSE 'false' END AS detail FROM br", lambda i: build.has_method(i).select("src", "dst", "detail"))
_q("build_implements", "SELECT m || '::T' || b || '_S' || s AS src, CASE WHEN b IN (SELECT b FROM br) THEN 't::T' || b ELSE m || '::T' || b END AS dst FROM su", lambda i: build.implements(i)[0].select("src", "dst"))
_q("build_for", "SELECT m || '::T' || b || '_S' || s AS src, fqn AS dst FROM su", lambda i: build.implements(i)[1].select("src", "dst"))
_q("build_extends", "SELECT 't::T' || b AS src, 't::T' || (b % 25 + 1) AS dst FROM br", lambda i: build.extends(i).select("src", "dst"))
_q("build_has_field", "SELECT fqn AS src, m || '::N' || y AS dst, 2 AS line, 'owner' AS detail FROM su UNION ALL SELECT fqn, 'String', 3, 'name' FROM su", lambda i: _edge(build.fields(i)))
_q("build_has_variant", "SELECT m || '::E' || y AS src, m || '::E' || y AS dst, 2 AS line, 'A' || y AS detail FROM mo UNION ALL SELECT m || '::E' || y, m || '::E' || y, 3, 'B' FROM mo", lambda i: _edge(build.variants(i)))
# `s.size()` also looks like a call of some `size`: below the caller's module, else the first of all.
CALLS = """, near AS (SELECT m, min(fqn || '::size') AS f FROM su GROUP BY m), st AS (SELECT cu.fqn AS src, su.fqn || '::new' AS dst, 1 AS line FROM cu JOIN su USING (s)
 UNION ALL SELECT a.fqn, b.fqn, 2 FROM cu a JOIN cu b ON b.c = a.o WHERE a.c <> b.c UNION ALL SELECT cu.fqn, coalesce(f, (SELECT min(fqn || '::size') FROM su)), 3 FROM cu LEFT JOIN near USING (m))
"""
_q("build_calls", CALLS + "SELECT *, 'static' AS detail FROM st UNION ALL SELECT cu.fqn, su.fqn || '::size', 3, 'dynamic' FROM cu JOIN su USING (s) WHERE NOT EXISTS (SELECT 1 FROM st WHERE src = cu.fqn AND dst = su.fqn || '::size')", lambda i: _edge(build.calls(i)))
_q("build_uses_type", """SELECT cu.fqn AS src, su.fqn AS dst, CAST(c % 500 + 1 AS INTEGER) AS line, 'parameter' AS detail FROM cu JOIN su USING (s) UNION ALL SELECT fqn, m || '::E' || y, CAST(c % 500 + 1 AS INTEGER), 'return' FROM cu
 UNION ALL SELECT cu.fqn, su.fqn, 1, 'body' FROM cu JOIN su USING (s) UNION ALL SELECT m || '::T' || b || '_S' || s, CASE WHEN b IN (SELECT b FROM br) THEN 't::T' || b ELSE m || '::T' || b END, 1, 'impl_trait' FROM su UNION ALL SELECT m || '::T' || b || '_S' || s, fqn, 1, 'impl_self_type' FROM su""", lambda i: _edge(build.uses_type(i)))
# The whole graph, settled: families in their order, one edge for each pair, placeholders for what is no item.
_FAMILIES = (("build_contains", "CONTAINS"), ("build_implements", "IMPLEMENTS"), ("build_for", "FOR"), ("build_has_field", "HAS_FIELD"), ("build_has_variant", "HAS_VARIANT"), ("build_extends", "EXTENDS"), ("build_calls", "CALLS"), ("build_uses_type", "USES_TYPE"), ("build_has_method", "HAS_METHOD"))
_LINED, _PLAIN_FAMILIES = {"HAS_FIELD", "HAS_VARIANT", "CALLS", "USES_TYPE"}, {"IMPLEMENTS", "FOR", "EXTENDS"}


def _family(name, rel, at):
    body = SQL[name][len(ITEMS):].removeprefix(CALLS)
    line = "line" if rel in _LINED else "CAST(NULL AS INTEGER)"
    detail = "CAST(NULL AS VARCHAR)" if rel in _PLAIN_FAMILIES else "CAST(detail AS VARCHAR)"
    return f"SELECT src, dst, '{rel}' AS rel, {line} AS line, {detail} AS detail, {at} AS origin FROM ({body})"


GRAPH_OF_ITEMS = ITEMS + CALLS + f""", raw AS ({" UNION ALL ".join(_family(n, r, i) for i, (n, r) in enumerate(_FAMILIES))}),
own AS (SELECT m AS fqn, 'Module' AS label FROM mo UNION SELECT fqn, 'Struct' FROM su UNION SELECT m || '::E' || y, 'Enum' FROM mo UNION SELECT 't::T' || b, 'Trait' FROM br UNION SELECT 't::T' || b || '::go', 'Function' FROM br
 UNION SELECT m || '::T' || b || '_S' || s, 'Impl' FROM su UNION SELECT fqn || '::new', 'Function' FROM su UNION SELECT fqn || '::size', 'Function' FROM su UNION SELECT fqn, 'Function' FROM cu UNION SELECT split_part(m, '::', 1), 'Crate' FROM mo UNION SELECT 't', 'Crate' FROM br),
guessed AS (SELECT m || '::T' || b AS fqn, min('T' || b || CASE WHEN s % 2 = 0 THEN '<u8>' ELSE '' END) AS name FROM su WHERE b NOT IN (SELECT b FROM br) GROUP BY 1),
known AS (SELECT fqn, false AS external FROM own UNION SELECT fqn, true FROM guessed),
e AS (SELECT src, rel, dst, arg_max(line, (origin, coalesce(line, -1), coalesce(detail, ''))) FILTER (line IS NOT NULL) AS line, arg_max(detail, (origin, coalesce(line, -1), coalesce(detail, ''))) FILTER (detail IS NOT NULL) AS detail, count(*) AS sites FROM raw GROUP BY 1, 2, 3),
stored AS (SELECT e.*, coalesce(NOT external, false) AS resolved, external IS NULL AS fresh FROM e LEFT JOIN known ON dst = fqn WHERE src IN (SELECT fqn FROM known) AND (external IS NOT NULL OR rel IN ('HAS_FIELD', 'HAS_VARIANT', 'USES_TYPE', 'FOR', 'EXTENDS')))
"""
query("build_graph", GRAPH_OF_ITEMS + """SELECT fqn, regexp_extract(fqn, '([^:]*)$', 1) AS name, label, false AS external FROM own UNION ALL SELECT fqn, name, 'Trait', true FROM guessed
 UNION ALL SELECT dst, dst, min(CASE rel WHEN 'HAS_VARIANT' THEN 'Enum' WHEN 'EXTENDS' THEN 'Trait' ELSE 'Type' END), true FROM stored WHERE fresh GROUP BY dst""")(lambda s, d: build.graph(items(s, d)).nodes.select("fqn", "name", "label", "external"))
query("build_graph_edges", GRAPH_OF_ITEMS + "SELECT src, rel, dst, line, detail, sites, resolved FROM stored")(lambda s, d: build.graph(items(s, d)).edges.select("src", "rel", "dst", "line", "detail", "sites", "resolved"))
query("graph_dangling", GRAPH_OF_ITEMS + ", i AS (SELECT fqn FROM own WHERE label NOT IN ('Struct', 'Trait')) SELECT rel, CASE WHEN src NOT IN (SELECT fqn FROM i) THEN 'source' ELSE 'target' END AS reason, count(*) AS cnt FROM raw WHERE src NOT IN (SELECT fqn FROM i) OR (dst NOT IN (SELECT fqn FROM i) AND rel NOT IN ('HAS_FIELD', 'HAS_VARIANT', 'USES_TYPE', 'FOR', 'EXTENDS')) GROUP BY 1, 2")(
    lambda s, d: dangling(build.nodes_of(items(s, d)).where("label NOT IN ('Struct', 'Trait')"), build.raw_edges(items(s, d)))
)
_q("item_texts", """SELECT fqn, 'pub struct S' || s || ' { owner, name, pub key }' || chr(10) || 'Documentation: Struct ' || s || '.' || chr(10) || 'Derives: Debug, Clone' || chr(10) || 'Module: ' || m || chr(10) || 'Crate: ' || split_part(m, '::', 1) AS text FROM su
 UNION ALL SELECT m || '::E' || y, 'pub enum E' || y || ' { A' || y || ', B }' || chr(10) || 'No documentation' || chr(10) || 'Derives: none' || chr(10) || 'Module: ' || m || chr(10) || 'Crate: ' || split_part(m, '::', 1) FROM mo
 UNION ALL SELECT 't::T' || b, 'pub trait T' || b || '<U: T' || (b % 25 + 1) || ' + lower> { go }' || chr(10) || 'No documentation' || chr(10) || 'Module: t' || chr(10) || 'Crate: t' FROM br
 UNION ALL SELECT m || '::T' || b || '_S' || s, 'impl T' || b || ' for S' || s || ' { no methods }' || chr(10) || 'No documentation' || chr(10) || 'Module: ' || m || chr(10) || 'Crate: ' || split_part(m, '::', 1) FROM su
 UNION ALL SELECT m, 'pub mod n' || y || chr(10) || 'No documentation' || chr(10) || 'Module: ' || split_part(m, '::', 1) || chr(10) || 'Crate: ' || split_part(m, '::', 1) FROM mo
 UNION ALL SELECT fqn, 'pub fn f' || c || '(a: &S' || s || ', n: u64) -> Option<E' || y || '>' || chr(10) || 'No documentation' || chr(10) || 'Module: ' || m || chr(10) || 'Crate: ' || split_part(m, '::', 1) || chr(10) || 'Traits used: none' || chr(10) || 'Body preview:' || chr(10)
  || '   1: let s: S' || s || ' = S' || s || '::new();' || chr(10) || '   2: f' || o || '(1);' || chr(10) || '   3: s.size();' FROM cu""", lambda i: i.where("NOT fqn RLIKE '::(new|size|go)$'").select("fqn", itemtext.item_text().alias("text")))
_q("item_payloads", """SELECT 't::T' || b AS fqn, 't' AS crate_name, 't' AS module_path, true AS has_generics, '[{"name":"U","kind":"type","bounds":["T' || (b % 25 + 1) || '","lower"]}]' AS generic_params, CAST(NULL AS VARCHAR) AS attributes FROM br
 UNION ALL SELECT fqn, split_part(m, '::', 1), m, false, NULL, '["#[derive(Debug, Clone)]"]' FROM su""", lambda i: i.where("item_type IN ('trait', 'struct')").withColumn("x", itemtext.item_text()).select(itemtext.payload(F.col("x")).alias("p")).select("p.fqn", "p.crate_name", "p.module_path", "p.has_generics", "p.generic_params", "p.attributes"))
_q("item_point_ids", ", x AS (SELECT fqn AS key FROM su UNION SELECT m || '::T' || b || '_S' || s FROM su), p AS (SELECT *, sha1(unhex('" + S.NAMESPACE + "') || encode(key)) AS h FROM x) SELECT key AS fqn, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM p", lambda i: i.where("item_type IN ('struct', 'impl')").select("fqn", S.uuid5("fqn").alias("id")))
_q("impl_self_types", "SELECT m || '::T' || b || '_S' || s AS fqn, 'S' || s AS self_type, fqn || '::' AS prefix FROM su", lambda i: i.where("item_type = 'impl'").select("fqn", extract.self_type().alias("self_type"), extract.method_prefix().alias("prefix")))

# -- pattern finds in files: a document of lines for each supplier ----------------

FILES = "WITH f AS (SELECT s_suppkey AS k, s_suppkey % 7 AS g FROM supplier) "


def files(s, d):
    k, g = [F.col("s_suppkey")], [F.col("s_suppkey") % 7]
    text = _cat("#[derive(Debug, a::Copy", g, ")]\npub struct S", k, " {\n}\nimpl<T> a::Show", g, " for S", k, "<T> {\n  x.collect::<Vec<u8>>();\n  parse::<A", g, ", B>(1);\n}")
    grown = _cat("impl Debug for S", k, " {}\nimpl Copy", g, " for S", k, " {}\nimpl Other for S", k, " {}")
    return t(s, d, "supplier").select(_cat("k", k).alias("key"), text.alias("text"), grown.alias("expanded"), _cat("c", g, "::m").alias("module_path"), _cat("c", g).alias("crate_name"), _cat(k, ".rs").alias("file_path"), _cat("c", g, "::m::one").alias("caller"))


query("heuristic_trait_impls", FILES + "SELECT 'a::Show' || g AS trait_fqn, 'S' || k || '<T>' AS self_type, 'c' || g || '::m::a::Show' || g || '_S' || k || '<T>' AS impl_fqn, k || '.rs' AS file_path, 4 AS line_number, 'heuristic' AS quality FROM f")(lambda s, d: extract.trait_impls(files(s, d)))
query("heuristic_typed_calls", FILES + """SELECT 'c' || g || '::m::one' AS caller_fqn, callee AS callee_fqn, k || '.rs' AS file_path, line AS line_number, args, true AS is_monomorphized, dispatch FROM f, (VALUES ('collect', 5, 'Vec<u8', 'static'), ('unknown::collect', 5, 'Vec<u8', 'dynamic')) v(callee, line, args, dispatch)
 UNION ALL SELECT 'c' || g || '::m::one', 'parse', k || '.rs', 6, 'A' || g || '|B', true, 'static' FROM f""")(lambda s, d: extract.typed_calls(files(s, d)).select("caller_fqn", "callee_fqn", "file_path", "line_number", F.array_join("concrete_type_args", "|").alias("args"), "is_monomorphized", "dispatch"))
query("derived_impls", FILES + "SELECT 'k' || k AS key, 'Debug for S' || k AS impl, 'derive(Debug)' AS generated_by FROM f UNION ALL SELECT 'k' || k, 'Copy' || g || ' for S' || k, 'derive(Copy' || g || ')' FROM f")(lambda s, d: extract.generated_impls(files(s, d).select("key", "text"), files(s, d).select("key", F.col("expanded").alias("text"))))
query("typecheck_callers", FILES + ", c AS (SELECT 'c' || (c_custkey % 7) || '::' || CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'z' END || '::f' || c_custkey AS fqn, c_custkey % 7 AS g FROM customer), n AS (SELECT g, count(*) AS n, min(fqn) AS first FROM c GROUP BY g) SELECT k || '.rs' AS file_path, coalesce(n, 0) AS n, first FROM f LEFT JOIN n USING (g)")(
    lambda s, d: extract.callers_of_files(t(s, d, "customer").select(_cat("c", [F.col("c_custkey") % 7], "::", [F.when(F.col("c_custkey") % 2 == 0, "m").otherwise("z")], "::f", [F.col("c_custkey")]).alias("fqn"), F.lit("function").alias("item_type")), files(s, d).drop("caller")).select("file_path", F.col("candidates").alias("n"), F.col("caller").alias("first"))
)
query("build_dependencies", "SELECT DISTINCT 'c' || c_nationkey AS src, 'c' || d AS dst, kind AS detail FROM (SELECT c_nationkey, (c_nationkey + 1) % 25 AS d, '' AS kind FROM customer UNION ALL SELECT c_nationkey, (c_nationkey + 2) % 25, 'dev' FROM customer) WHERE d IN (SELECT c_nationkey FROM customer) AND d <> c_nationkey")(
    lambda s, d: build.dependencies(_manifests(s, d), t(s, d, "customer").select(_cat("c", [F.col("c_nationkey")]).alias("crate_name")).distinct()).select("src", "dst", "detail")
)


def _manifests(s, d):
    n = F.col("c_nationkey")
    text = _cat('[package]\nname = "c', [n], '"\n[dependencies]\nserde = "1"\nc', [(n + 1) % 25], ' = { path = "x" }\n[dev-dependencies]\nc', [(n + 2) % 25], '.workspace = true\n[features]\nc0 = []\n')
    return t(s, d, "customer").select("c_nationkey").distinct().select(_cat("c", [n]).alias("crate_name"), text.alias("content"))


# -- type queries ------------------------------------------------------------------

SITES = "SELECT 'S' || l_suppkey || '::run' AS caller_fqn, 'p' || (l_partkey % 50) || '::' || CASE WHEN l_linenumber % 2 = 0 THEN 'parse' ELSE 'load' END AS callee_fqn, 'src/f' || (l_orderkey % 40) || '.rs' AS file_path, CAST(l_orderkey % 1000 AS INTEGER) AS line_number, 'Type' || (l_partkey % 90) AS a, l_returnflag AS b, l_linenumber > 1 AS is_monomorphized FROM lineitem"


def sites(s, d):
    arg = lambda i, c: F.struct(F.lit(f"T{i}").alias("param_name"), c.cast("string").alias("concrete_type"))
    args = F.array(arg(0, _cat("Type", [F.col("l_partkey") % 90])), arg(1, F.col("l_returnflag")))
    return t(s, d, "lineitem").select(
        _cat("S", [F.col("l_suppkey")], "::run").alias("caller_fqn"), _cat("p", [F.col("l_partkey") % 50], "::", [F.when(F.col("l_linenumber") % 2 == 0, "parse").otherwise("load")]).alias("callee_fqn"),
        _cat("src/f", [F.col("l_orderkey") % 40], ".rs").alias("file_path"), (F.col("l_orderkey") % 1000).cast("int").alias("line_number"), args.alias("concrete_type_args"), (F.col("l_linenumber") > 1).alias("is_monomorphized"), F.lit(None).cast("string").alias("quality"),
    )


def _typed(s, d, callee):
    out = listing.calls_with_type(sites(s, d).distinct(), "Type7", callee, 60)
    return out.withColumn("concrete_type_args", F.array_join("concrete_type_args", ","))


for _name, _callee in (("calls_with_type", None), ("calls_with_type_of", "parse")):
    _more = f" AND callee_fqn LIKE '%::{_callee}'" if _callee else ""
    query(_name, f"SELECT caller_fqn, callee_fqn, file_path, line_number, a || ',' || b AS concrete_type_args, is_monomorphized, 'unknown' AS quality FROM (SELECT DISTINCT * FROM ({SITES})) WHERE a LIKE '%Type7%'{_more} ORDER BY file_path, line_number, caller_fqn, callee_fqn LIMIT 60")(lambda s, d, c=_callee: _typed(s, d, c))

query("impls_for_type", "SELECT 'Trait' || lpad(CAST(s_suppkey % 9 AS VARCHAR), 2, '0') AS trait_fqn, 'Vec<S' || s_suppkey || '>' AS self_type, 'm::T_S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS impl_fqn, 'src/lib.rs' AS file_path, CAST(s_suppkey % 500 AS INTEGER) AS line_number, 'unknown' AS quality FROM supplier WHERE 'Vec<S' || s_suppkey || '>' LIKE '%S1%' ORDER BY trait_fqn, impl_fqn LIMIT 10")(
    lambda s, d: listing.impls_for_type(t(s, d, "supplier").select(_cat("Trait", [F.lpad((F.col("s_suppkey") % 9).cast("string"), 2, "0")]).alias("trait_fqn"), _cat("Vec<S", [F.col("s_suppkey")], ">").alias("self_type"), _cat("m::T_S", [F.lpad(F.col("s_suppkey").cast("string"), 9, "0")]).alias("impl_fqn"), F.lit("src/lib.rs").alias("file_path"), (F.col("s_suppkey") % 500).cast("int").alias("line_number"), F.lit(None).cast("string").alias("quality")), "S1")
)

# -- parsed items --------------------------------------------------------------------

PARSED = "SELECT *, 'c' || g || '::m' AS m FROM (SELECT s_suppkey AS k, s_suppkey % 7 AS g FROM supplier)"


def _sources(s, d):
    k, g = [F.col("s_suppkey")], [F.col("s_suppkey") % 7]
    text = _cat("// top {\n/// Says ", k, ".\n#[derive(Debug)]\npub struct S", k, "<T: A + B> {\n    x: u8,\n}\nimpl<T> Show for S", k, "<T> {\n    fn show(&self) -> u8 { if true { 1 } else { 2 } }\n}\nmod inner {\n    pub const N: u8 = ", g, ";\n}\n")
    return t(s, d, "supplier").select(_cat("c", g, "::m").alias("module_path"), text.alias("text"), _cat("c", g).alias("crate_name"), _cat(k, ".rs").alias("file_path"))


query("parse_items", f"""WITH p AS ({PARSED}) SELECT m || '::S' || k AS fqn, 'struct' AS item_type, 'pub' AS visibility, 'pub struct S' || k || '<T: A + B>' AS signature, 'Says ' || k || '.' AS doc_comment, '#[derive(Debug)]' AS attributes, 'T:A+B' AS generics, 4 AS start_line, 6 AS end_line, k || '.rs' AS file_path FROM p
 UNION ALL SELECT m || '::Show_S' || k, 'impl', '', 'impl<T> Show for S' || k || '<T>', '', 'impl_for=Show', 'T:', 7, 9, k || '.rs' FROM p UNION ALL SELECT m || '::S' || k || '::show', 'function', '', 'fn show(&self) -> u8', '', 'impl_type=S' || k, '', 8, 8, k || '.rs' FROM p
 UNION ALL SELECT m || '::inner', 'module', '', 'mod inner', '', '', '', 10, 12, k || '.rs' FROM p UNION ALL SELECT m || '::inner::N', 'const', 'pub', 'pub const N: u8 = ' || g, '', '', '', 11, 11, k || '.rs' FROM p""")(
    lambda s, d: parse.parsed(_sources(s, d)).select("fqn", "item_type", "visibility", "signature", "doc_comment", F.array_join("attributes", ",").alias("attributes"), F.array_join(F.transform("generic_params", lambda g: F.concat(g["name"], F.lit(":"), F.array_join(g["bounds"], "+"))), ",").alias("generics"), "start_line", "end_line", "file_path")
)
query("call_dispatch", "WITH c AS (SELECT 'f' || l_orderkey AS f, 'S' || l_suppkey AS r, l_linenumber AS n, l_suppkey AS s FROM lineitem) SELECT DISTINCT f AS caller_fqn, 'm::go' AS callee_fqn, 'static' AS dispatch FROM c WHERE n = 1 UNION SELECT f, 'm::T_' || r || '::go', 'static' FROM c WHERE n > 1 AND s % 2 = 0 UNION SELECT f, r || '::go', 'trait' FROM c WHERE n > 1 AND s % 2 = 0 UNION SELECT f, r || '::go', 'dynamic' FROM c WHERE n > 1 AND s % 2 <> 0")(
    lambda s, d: build.dispatched(
        t(s, d, "lineitem").select(_cat("f", [F.col("l_orderkey")]).alias("caller_fqn"), F.when(F.col("l_linenumber") == 1, "m::go").alias("callee"), F.when(F.col("l_linenumber") > 1, _cat("S", [F.col("l_suppkey")])).alias("receiver"), F.lit("go").alias("method")),
        t(s, d, "supplier").where("s_suppkey % 2 = 0").select(_cat("S", [F.col("s_suppkey")]).alias("self_type"), F.lit("go").alias("method"), _cat("m::T_S", [F.col("s_suppkey")]).alias("impl_fqn")))
)
# Points in full: identifiers made of names, letters of the embedded texts as a stand-in for a model, and payloads.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts):
    """A stand-in for a model: how often each letter stands in a text."""
    return [[float(x.count(c)) for c in _LETTERS] for x in texts]


_VEC = "list_transform(string_split('" + _LETTERS + "', ''), lambda c: CAST(length(text) - length(replace(text, c, '')) AS DOUBLE))"
_UUID5 = "SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_HASHED = f"sha1(unhex('{S.NAMESPACE}') || encode(key))"
query("item_points", ITEMS + f""", x AS (SELECT fqn AS key, m, s, 'pub struct S' || s || ' {{ owner, name, pub key }}' || chr(10) || 'Documentation: Struct ' || s || '.' || chr(10) || 'Derives: Debug, Clone' || chr(10) || 'Module: ' || m || chr(10) || 'Crate: ' || split_part(m, '::', 1) AS text FROM su),
 p AS (SELECT *, {_HASHED} AS h FROM x) SELECT ({_UUID5}) AS id, {_VEC} AS vector, key AS fqn, split_part(m, '::', 1) AS crate_name, m AS module_path FROM p""")(
    lambda s, d: embedding.item_points(items(s, d).where("item_type = 'struct'"), letter_counts).select("id", "vector", "payload.fqn", "payload.crate_name", "payload.module_path")
)
query("doc_points", ITEMS + f""", x AS (SELECT fqn, 'Struct ' || s || '.' AS text, fqn || ':doc:0' AS key FROM su), p AS (SELECT *, {_HASHED} AS h FROM x) SELECT ({_UUID5}) AS id, {_VEC} AS vector, fqn AS source_fqn, 'struct' AS source_item_type, 0 AS chunk_index, text FROM p""")(
    lambda s, d: embedding.doc_points(items(s, d).where("item_type = 'struct'"), letter_counts)
)
