"""Every operator on the driver's tables: a query and, where SQL can say it, the SQL to hold it against.

The tables stand in for the engine's own: region, nation, customer and supplier
are a tree of crates, modules and items with call, type and dependency edges;
events and conversations are event logs; documents, labels and embeddings are
three stores that should agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chunks
from .functions import scalar as S
from .operators import audit, evals, eventlog, listing, metrics, search, tables
from .plans import sqlgate
from .plans.graph import Graph, crate_of, first, parent_of, with_placeholders
from .plans.lineage import changed, cut
from .sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}
NAME, CALLEE, CRATE, MODULE, BRAND, KIND = "Customer#000000042", "Customer#000000007", "ASIA", "NATION_3", "Brand#7", "ECONOMY"
PREFIX = "ASIA::NATION_2"
VECTOR = [((i * 37) % 11 - 5) / 10 for i in range(64)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- the graph ---------------------------------------------------------------


_stored: dict[tuple, Graph] = {}


def graph_of(spark: SparkSession, d: str) -> Graph:
    """The graph of a folder of tables, stored once for a session: queries read it, they don't build it; tables written anew are read anew."""
    key = (spark.sparkContext.applicationId, d, *changed(spark, *(f"{d}/{x}.parquet" for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))))
    if key not in _stored:
        g = made_graph(spark, d)
        _stored[key] = Graph(cut(g.nodes), cut(g.edges))
    return _stored[key]


def made_graph(spark: SparkSession, d: str) -> Graph:
    r, n, c, s, p, o, li = (t(spark, d, x) for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    mods = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.concat_ws("::", "r_name", "n_name").alias("m"))
    cu = c.join(mods, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.concat_ws("::", "m", "c_name").alias("fqn"), F.col("c_name").alias("name"), "n_name", "m")
    su = s.join(mods, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), F.concat_ws("::", "m", "s_name").alias("fqn"), F.col("s_name").alias("name"), "n_name", "m")
    path = F.concat(F.lit("src/"), F.col("n_name"), F.lit(".rs"))
    null, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    def node(df, fqn, name, label, file, line):
        return df.select(fqn.alias("fqn"), name.alias("name"), F.lit(label).alias("label"), file.alias("file_path"), line.alias("start_line"))

    brand, kind = F.concat(F.lit("types::"), F.col("p_brand")), F.concat(F.lit("types::"), F.col("p_type"))
    types = F.lit("src/types.rs")
    nodes = node(r, F.col("r_name"), F.col("r_name"), "Crate", null, zero)
    for more in (
        node(mods, F.col("m"), F.col("n_name"), "Module", path, zero),
        node(cu, F.col("fqn"), F.col("name"), "Function", F.when(F.col("k") % 7 != 0, path), F.col("k") % 500),
        node(su, F.col("fqn"), F.col("name"), "Struct", path, F.col("k") % 500),
        node(p.select("p_brand").distinct(), brand, F.col("p_brand"), "Trait", types, zero),
        node(p.select("p_type").distinct(), kind, F.col("p_type"), "Enum", types, zero),
    ):
        nodes = nodes.unionByName(more)

    def edge(df, src, dst, rel):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))

    a, b = cu.select(F.col("k").alias("ak"), F.col("fqn").alias("af")), cu.select(F.col("k").alias("bk"), F.col("fqn").alias("bf"))
    many = c.agg(F.count("*").alias("nc")).crossJoin(p.agg(F.count("*").alias("np")))
    o = o.crossJoin(many)
    # Tables that grow are shuffled, however small they look: a broadcast one goes through the driver.
    p, cu, su, a, b = (x.hint("merge") for x in (p, cu, su, a, b))
    calls = o.select(F.col("o_custkey").alias("ak"), ((F.col("o_custkey") * 13 + F.col("o_orderkey") % 3) % F.col("nc")).alias("bk")).distinct().join(a, "ak").join(b, "bk")
    impl = li.select("l_suppkey", "l_partkey").distinct().join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", brand.alias("b")).distinct().join(su, F.col("l_suppkey") == F.col("k"))
    uses = o.select("o_custkey", (F.col("o_orderkey") % F.col("np")).alias("pk")).distinct().join(p, F.col("pk") == F.col("p_partkey")).select("o_custkey", kind.alias("b")).distinct().join(cu, F.col("o_custkey") == F.col("k"))
    r2 = r.select(F.col("r_regionkey").alias("k2"), F.col("r_name").alias("n2"))
    deps = r.join(r2, (F.col("k2") == (F.col("r_regionkey") + 1) % 5) | (F.col("k2") == (F.col("r_regionkey") + 2) % 5))
    edges = edge(mods, F.col("r_name"), F.col("m"), "CONTAINS")
    for more in (
        edge(cu, F.col("m"), F.col("fqn"), "CONTAINS"), edge(su, F.col("m"), F.col("fqn"), "CONTAINS"), edge(calls, F.col("af"), F.col("bf"), "CALLS"),
        edge(impl, F.col("fqn"), F.col("b"), "IMPLEMENTS"), edge(uses, F.col("fqn"), F.col("b"), "USES_TYPE"), edge(deps, F.col("r_name"), F.col("n2"), "DEPENDS_ON"),
    ):
        edges = edges.unionByName(more)
    return Graph(nodes, edges)


G = """WITH RECURSIVE mods AS (SELECT n_nationkey, n_name, r_name, r_name || '::' || n_name AS m FROM nation JOIN region ON n_regionkey = r_regionkey),
cu AS (SELECT c_custkey AS k, m || '::' || c_name AS fqn, c_name AS name, n_name, m FROM customer JOIN mods ON c_nationkey = n_nationkey),
su AS (SELECT s_suppkey AS k, m || '::' || s_name AS fqn, s_name AS name, n_name, m FROM supplier JOIN mods ON s_nationkey = n_nationkey),
nodes AS (SELECT r_name AS fqn, r_name AS name, 'Crate' AS label, CAST(NULL AS VARCHAR) AS file_path, CAST(0 AS BIGINT) AS start_line FROM region
 UNION ALL SELECT m, n_name, 'Module', 'src/' || n_name || '.rs', 0 FROM mods
 UNION ALL SELECT fqn, name, 'Function', CASE WHEN k % 7 <> 0 THEN 'src/' || n_name || '.rs' END, k % 500 FROM cu
 UNION ALL SELECT fqn, name, 'Struct', 'src/' || n_name || '.rs', k % 500 FROM su
 UNION ALL SELECT DISTINCT 'types::' || p_brand, p_brand, 'Trait', 'src/types.rs', 0 FROM part
 UNION ALL SELECT DISTINCT 'types::' || p_type, p_type, 'Enum', 'src/types.rs', 0 FROM part),
edges AS (SELECT r_name AS src, m AS dst, 'CONTAINS' AS rel FROM mods UNION ALL SELECT m, fqn, 'CONTAINS' FROM cu UNION ALL SELECT m, fqn, 'CONTAINS' FROM su
 UNION ALL SELECT DISTINCT a.fqn, b.fqn, 'CALLS' FROM orders JOIN cu a ON o_custkey = a.k JOIN cu b ON b.k = (o_custkey * 13 + o_orderkey % 3) % (SELECT count(*) FROM customer)
 UNION ALL SELECT DISTINCT su.fqn, 'types::' || p_brand, 'IMPLEMENTS' FROM lineitem JOIN su ON l_suppkey = su.k JOIN part ON l_partkey = p_partkey
 UNION ALL SELECT DISTINCT cu.fqn, 'types::' || p_type, 'USES_TYPE' FROM orders JOIN cu ON o_custkey = cu.k JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
 UNION ALL SELECT a.r_name, b.r_name, 'DEPENDS_ON' FROM region a JOIN region b ON b.r_regionkey = (a.r_regionkey + 1) % 5 OR b.r_regionkey = (a.r_regionkey + 2) % 5)
"""
IS = "(name = '{0}' OR fqn = '{0}')"


def gq(name: str, sql: str):
    """A query on the graph."""
    def add(f):
        return query(name, G + sql)(lambda spark, d: f(graph_of(spark, d)))

    return add


def reach_sql(seeds: str, depth: int, a: str, b: str) -> str:
    return f""", reach(fqn, d) AS (SELECT e.{b}, 1 FROM edges e WHERE e.rel = 'CALLS' AND e.{a} IN ({seeds})
 UNION SELECT e.{b}, d + 1 FROM reach JOIN edges e ON e.{a} = reach.fqn AND e.rel = 'CALLS' WHERE d < {depth})
"""


named_sql = f"SELECT fqn FROM nodes WHERE {IS.format(NAME)}"
gq("graph_functions_by_name", "SELECT fqn, name, file_path, start_line FROM nodes WHERE label = 'Function' AND name = 'Customer#000000041' AND file_path IS NOT NULL")(lambda g: g.functions_by_name("Customer#000000041"))
gq("graph_callers", reach_sql(named_sql, 3, "dst", "src") + "SELECT fqn, name, file_path, start_line FROM nodes WHERE fqn IN (SELECT fqn FROM reach) AND file_path IS NOT NULL")(lambda g: g.callers(NAME, 3))
gq("graph_callers_limit", reach_sql(named_sql, 5, "dst", "src") + "SELECT fqn, name, file_path, start_line FROM nodes WHERE fqn IN (SELECT fqn FROM reach) AND file_path IS NOT NULL ORDER BY fqn LIMIT 25")(lambda g: g.query("find_callers", name=NAME, depth="9"))
gq("graph_callees", f"SELECT DISTINCT n.fqn, n.name, n.file_path FROM edges e JOIN nodes n ON n.fqn = e.dst WHERE e.rel = 'CALLS' AND e.src IN (SELECT fqn FROM nodes WHERE {IS.format(CALLEE)}) AND n.file_path IS NOT NULL")(lambda g: g.callees(CALLEE))
FULL = "(SELECT fqn FROM nodes WHERE name = '" + NAME + "')"


@query("graph_callers_api", G + reach_sql(FULL, 4, "dst", "src") + f"SELECT n.fqn, name, file_path, start_line, 1 AS depth, CAST(min(d) AS INTEGER) AS least FROM nodes n JOIN reach r ON n.fqn = r.fqn WHERE n.fqn <> {FULL} GROUP BY ALL")
def _callers_api(spark, d):
    g = graph_of(spark, d)
    full = g.nodes.where(F.col("name") == NAME).select("fqn").first()
    return g.callers_api(full[0] if full else NAME, 4)


@query("graph_callees_api", G + "SELECT n.fqn, n.name FROM edges e JOIN nodes n ON n.fqn = e.dst WHERE rel = 'CALLS' AND src = (SELECT fqn FROM nodes WHERE name = '" + CALLEE + "')")
def _callees_api(spark, d):
    g = graph_of(spark, d)
    full = g.nodes.where(F.col("name") == CALLEE).select("fqn").first()
    return g.callees_api(full[0] if full else CALLEE)


PRE = f"SELECT fqn FROM nodes WHERE label = 'Function' AND starts_with(fqn, '{PREFIX}')"
gq("graph_callers_for_prefix", reach_sql(PRE, 2, "dst", "src") + f"SELECT fqn, name, file_path, start_line FROM nodes WHERE label = 'Function' AND fqn IN (SELECT fqn FROM reach) AND NOT starts_with(fqn, '{PREFIX}')")(lambda g: g.callers_for_prefix(PREFIX, 2))
gq("graph_callees_for_prefix", f"SELECT DISTINCT n.fqn, n.name FROM edges e JOIN nodes n ON n.fqn = e.dst WHERE rel = 'CALLS' AND src IN ({PRE}) AND NOT starts_with(n.fqn, '{PREFIX}')")(lambda g: g.callees_for_prefix(PREFIX))
gq("graph_trait_implementations", f"SELECT n.fqn, n.name, n.file_path, n.start_line FROM edges e JOIN nodes tr ON tr.fqn = e.dst AND tr.label = 'Trait' JOIN nodes n ON n.fqn = e.src WHERE rel = 'IMPLEMENTS' AND (tr.name = '{BRAND}' OR tr.fqn = '{BRAND}' AND n.file_path IS NOT NULL)")(lambda g: g.trait_implementations(BRAND))
gq("graph_trait_impls_api", f"SELECT DISTINCT n.fqn AS impl_fqn, CASE WHEN contains(n.name, '_') THEN split_part(n.name, '_', 2) ELSE n.name END AS type_name, '' AS file_path, n.start_line FROM edges e JOIN nodes tr ON tr.fqn = e.dst AND tr.label = 'Trait' JOIN nodes n ON n.fqn = e.src WHERE rel = 'IMPLEMENTS' AND (tr.name = '{BRAND}' OR contains(tr.fqn, '{BRAND}')) ORDER BY impl_fqn LIMIT 10")(lambda g: g.trait_impls_api(BRAND))
gq("graph_by_fqn", f"SELECT * FROM nodes WHERE label = 'Function' AND {IS.format(NAME)}")(lambda g: g.by_fqn(NAME))
gq("graph_neighbours", f""", e2 AS (SELECT src, dst, rel, row_number() OVER (ORDER BY src, dst, rel) AS e FROM edges), both_ AS (SELECT src AS u, dst AS v, rel, e FROM e2 UNION ALL SELECT dst, src, rel, e FROM e2 WHERE src <> dst),
p(v, rel, path, d) AS (SELECT b.v, b.rel, [b.e], 1 FROM both_ b WHERE b.u IN (SELECT fqn FROM nodes WHERE {IS.format(NAME)}) UNION ALL SELECT b.v, b.rel, list_append(p.path, b.e), d + 1 FROM p JOIN both_ b ON b.u = p.v WHERE d < 2 AND NOT list_contains(p.path, b.e))
SELECT DISTINCT p.rel AS relationship, n.fqn, n.name, n.label FROM p JOIN nodes n ON n.fqn = p.v""")(lambda g: g.neighbours(NAME, 2))
gq("graph_nodes_by_label", "SELECT fqn, name FROM nodes WHERE label = 'Struct' ORDER BY fqn LIMIT 100")(lambda g: g.query("find_nodes_by_label", label="Struct", limit=500))
gq("graph_module_contents", f"SELECT DISTINCT n.fqn, n.name, n.label FROM edges e JOIN nodes n ON n.fqn = e.dst WHERE rel = 'CONTAINS' AND src IN (SELECT fqn FROM nodes WHERE label = 'Module' AND {IS.format(MODULE)})")(lambda g: g.module_contents(MODULE))
gq("graph_crate_overview", f"SELECT k.label, count(k.fqn) AS cnt FROM nodes c LEFT JOIN edges e ON e.src = c.fqn AND e.rel = 'CONTAINS' LEFT JOIN nodes k ON k.fqn = e.dst WHERE c.label = 'Crate' AND c.name = '{CRATE}' GROUP BY k.label")(lambda g: g.crate_overview(CRATE))
gq("graph_crate_dependencies", f"SELECT n.fqn, n.name FROM edges e JOIN nodes n ON n.fqn = e.dst WHERE rel = 'DEPENDS_ON' AND src = '{CRATE}'")(lambda g: g.crate_dependencies(CRATE))
gq("graph_crate_dependents", f"SELECT n.fqn, n.name FROM edges e JOIN nodes n ON n.fqn = e.src WHERE rel = 'DEPENDS_ON' AND dst = '{CRATE}'")(lambda g: g.crate_dependencies(CRATE, True))
gq("graph_usages_of_type", f"SELECT DISTINCT n.fqn, n.name, n.label AS kind, n.file_path, n.start_line FROM edges e JOIN nodes n ON n.fqn = e.src WHERE rel = 'USES_TYPE' AND dst IN (SELECT fqn FROM nodes WHERE label IN ('Struct','Enum','Trait','Type','TypeAlias') AND (name = '{KIND}' OR fqn = '{KIND}' OR ends_with(fqn, '::{KIND}')))")(lambda g: g.usages_of_type(KIND))
gq("graph_label_counts", "SELECT label, count(*) AS cnt FROM nodes GROUP BY label")(lambda g: g.label_counts())
gq("graph_relationship_counts", "SELECT rel, count(*) AS cnt FROM edges GROUP BY rel")(lambda g: g.relationship_counts())
gq("graph_health", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")(lambda g: g.health())
gq("graph_has_relationship", "SELECT count(*) > 0 AS present FROM edges WHERE rel = 'DEPENDS_ON'")(lambda g: g.has_relationship("DEPENDS_ON"))
ITEMS = "label IN ('Function','Struct','Enum','Trait','Impl','TypeAlias')"
gq("graph_consistency_fqns", f"SELECT DISTINCT fqn FROM nodes WHERE {ITEMS}")(lambda g: g.consistency_fqns())
gq("graph_consistency_fqns_crate", f"SELECT DISTINCT fqn FROM nodes WHERE {ITEMS} AND split_part(fqn, '::', 1) = '{CRATE}'")(lambda g: g.consistency_fqns(CRATE))
gq("graph_consistency_count", f"SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS cnt FROM (SELECT DISTINCT count(*) AS c FROM nodes WHERE {ITEMS} GROUP BY label)")(lambda g: g.consistency_count())
gq("graph_module_tree", f"SELECT n.fqn, n.label, CASE WHEN n.label = 'Crate' THEN NULL ELSE coalesce(e.src, '{CRATE}') END AS parent, CAST(len(string_split(n.fqn, '::')) - 1 AS INTEGER) AS depth FROM nodes n LEFT JOIN edges e ON e.dst = n.fqn AND e.rel = 'CONTAINS' WHERE split_part(n.fqn, '::', 1) = '{CRATE}'")(lambda g: g.module_tree(CRATE))


@query("graph_item_detail", G + f", f AS (SELECT fqn FROM nodes WHERE name = '{NAME}') SELECT fqn, name, label, CAST(start_line AS BIGINT) AS start_line, (SELECT coalesce(string_agg(DISTINCT src, ',' ORDER BY src), '') FROM edges WHERE rel = 'CALLS' AND dst IN (SELECT fqn FROM f)) AS callers, (SELECT coalesce(string_agg(DISTINCT dst, ',' ORDER BY dst), '') FROM edges WHERE rel = 'CALLS' AND src IN (SELECT fqn FROM f)) AS callees FROM nodes WHERE name = '{NAME}'")
def _item_detail(spark, d):
    g = graph_of(spark, d)
    full = g.nodes.where(F.col("name") == NAME).select("fqn").first()
    items = g.nodes.withColumn("source_file_id", F.col("file_path")).drop("file_path")
    files = g.nodes.select(F.col("file_path").alias("source_file_id")).where("source_file_id IS NOT NULL").distinct()
    out = g.item_detail(items, files, full[0] if full else NAME)
    return out.select("fqn", "name", "label", "start_line", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query("graph_placeholders", "SELECT external, count(*) AS cnt FROM (SELECT DISTINCT 'p' || l_partkey AS id, CAST(l_partkey % 3 = 0 AS BOOLEAN) AS external FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, false FROM lineitem UNION SELECT 'p' || p_partkey, false FROM part WHERE p_partkey % 3 <> 0) GROUP BY external")
def _placeholders(spark, d):
    li = t(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = li.select(key("s", "l_suppkey").alias("fqn")).union(t(spark, d, "part").where("p_partkey % 3 <> 0").select(key("p", "p_partkey"))).distinct()
    g = with_placeholders(nodes, li.select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("USES_TYPE").alias("rel")))
    return g.nodes.groupBy("external").agg(F.count("*").alias("cnt"))


gq("graph_parent_names", "SELECT fqn, nullif(regexp_extract(fqn, '^(.*)::[^:]*$', 1), '') AS parent, split_part(fqn, '::', 1) AS crate FROM nodes")(lambda g: g.nodes.select("fqn", parent_of("fqn").alias("parent"), crate_of("fqn").alias("crate")))

# -- search --------------------------------------------------------------------

VSQL = "[" + ",".join(map(str, VECTOR)) + "]::DOUBLE[]"
COS = f"list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), {VSQL}) / (sqrt(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * sqrt(list_inner_product({VSQL}, {VSQL})))"


def _score(df):
    return df.withColumn("score", F.round("score", 6))


query("semantic_search", f"SELECT vec_id, label, round({COS}, 6) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10")(lambda s, d: _score(search.semantic(t(s, d, "embeddings"), VECTOR)))
query("semantic_search_filtered", f"SELECT vec_id, label, round({COS}, 6) AS score FROM embeddings WHERE label = 3 AND {COS} >= 0.05 ORDER BY {COS} DESC, vec_id LIMIT 20")(lambda s, d: _score(search.semantic(t(s, d, "embeddings"), VECTOR, 20, 0.05, F.col("label") == 3)))
CLIP = "CASE WHEN strlen(text) > 500 THEN left(text, (SELECT max(k) FROM range(125, 501) r(k) WHERE strlen(left(text, k)) <= 500)) || '...' ELSE text END"
query("search_docs", f"SELECT doc_id, source AS source_file, {CLIP} AS content_preview, round({COS}, 6) AS score FROM embeddings JOIN documents ON vec_id = doc_id ORDER BY {COS} DESC, vec_id LIMIT 10")(
    lambda s, d: _score(search.docs(t(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id").join(t(s, d, "documents").select("doc_id"), "doc_id", "left_semi"), t(s, d, "documents").withColumnRenamed("source", "source_file"), VECTOR))
)


@query("aggregate_search", f"SELECT e.vec_id, label, round({COS}, 6) AS score, lang, source, quality, toxic FROM embeddings e LEFT JOIN documents dd ON dd.doc_id = vec_id LEFT JOIN labels l ON l.doc_id = vec_id ORDER BY {COS} DESC, vec_id LIMIT 10")
def aggregate_search(spark, d):
    items = t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source").join(t(spark, d, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id", "left")
    return _score(search.aggregate(t(spark, d, "embeddings"), items, None, VECTOR))


@query("aggregate_search_graph", f"WITH top AS (SELECT vec_id, round({COS}, 6) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10), e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % (SELECT count(*) FROM embeddings) AS dst FROM orders) SELECT vec_id, score, c_name, coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM e WHERE dst = vec_id), '') AS callers, coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FROM e WHERE src = vec_id), '') AS callees FROM top LEFT JOIN customer ON c_custkey = vec_id")
def _aggregate_graph(spark, d):
    items = t(spark, d, "customer").select(F.col("c_custkey").alias("vec_id"), "c_name")
    many = t(spark, d, "embeddings").agg(F.count("*").alias("ne"))
    edges = t(spark, d, "orders").crossJoin(many).select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("ne")).alias("dst"))
    out = _score(search.aggregate(t(spark, d, "embeddings").drop("label"), items, edges, VECTOR))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.withColumn("callers", join("callers")).withColumn("callees", join("callees"))


query("keyword_search", "SELECT p_partkey, p_name, p_brand, p_type, round(1.0 - 0.01 * (r - 1), 2)::DOUBLE AS score FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN p_name ILIKE '%ring%' THEN 0 ELSE 1 END, CASE WHEN p_brand ILIKE '%ring%' THEN 0 ELSE 1 END, p_name, p_brand, p_partkey) AS r FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%') WHERE r <= 10")(
    lambda s, d: search.keyword(t(s, d, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("b"), "p_brand", "p_type"), "ring", ("p_name", "p_type"), "p_name", "b").drop("b")
)

# -- relations -----------------------------------------------------------------

query("scan_prefix", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name")(lambda s, d: t(s, d, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name"))
query("scan_documented", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'P') AND l_returnflag = 'R' AND l_quantity > 45")(
    lambda s, d: t(s, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").join(t(s, d, "orders").where(F.col("o_orderstatus").isin("O", "P")), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderpriority")
)
query("join_left_enrichment", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")(lambda s, d: t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice"))
query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")(lambda s, d: t(s, d, "customer").join(t(s, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))
query("join_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left_anti").select("doc_id"))
query("join_inner_three", "SELECT r_name, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")(
    lambda s, d: t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("total"))
)
query("join_prefer_same_module", "SELECT l_orderkey, s_suppkey FROM (SELECT l_orderkey, s_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN s_nationkey = c_nationkey THEN 0 ELSE 1 END, s_suppkey) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) WHERE r = 1")(
    lambda s, d: tables.keep_first(
        t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(t(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "s_suppkey", F.when(F.col("s_nationkey") == F.col("c_nationkey"), 0).otherwise(1).alias("far")),
        ["l_orderkey"], [F.col("far"), F.col("s_suppkey")]).drop("far")
)
query("agg_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(DISTINCT o_custkey) AS customers FROM orders")(lambda s, d: t(s, d, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_distinct("o_custkey").alias("customers")))
query("agg_group_order", "SELECT o_orderstatus AS status, count(*) AS cnt FROM orders GROUP BY 1")(lambda s, d: t(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt")))
query("agg_crate_distinct", "SELECT DISTINCT split_part(event_type || '::x', '::', 1) AS crate FROM events")(lambda s, d: t(s, d, "events").select(crate_of(F.concat("event_type", F.lit("::x"))).alias("crate")).distinct())
query("agg_population_stats", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem GROUP BY 1")(lambda s, d: t(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.var_pop("l_quantity"), 6).alias("variance"), F.round(F.stddev_pop("l_quantity"), 6).alias("spread")))
query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS cnt FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda s, d: t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("cnt")))
query("agg_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")(lambda s, d: metrics.exact_quantiles(t(s, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")))
query("agg_mean_seconds", "SELECT user_id, coalesce(round(avg(epoch(ts) - epoch(was)), 3), 0) AS mean_seconds FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) GROUP BY user_id")(
    lambda s, d: metrics.mean_gap(t(s, d, "events"), "user_id", "ts", "event_id", "mean_seconds").withColumn("mean_seconds", F.coalesce(F.round("mean_seconds", 3), F.lit(0.0)))
)
query("top_latest_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")(lambda s, d: tables.latest(t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey"))
query("top_recent_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(lambda s, d: t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50))
query("optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")(lambda s, d: listing.matching(t(s, d, "orders"), o_orderstatus="F", o_orderpriority="5-LOW", o_custkey=None).select("o_orderkey"))
query("set_union_intersect_except", "SELECT 'both' AS kind, count(*) AS cnt FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'without', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'any', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)")(lambda s, d: _sets(t(s, d, "orders").select("o_custkey"), t(s, d, "customer").select("c_custkey")))


def _sets(a: DataFrame, b: DataFrame) -> DataFrame:
    def one(kind, df):
        return df.agg(F.lit(kind).alias("kind"), F.count("*").alias("cnt"))

    return one("both", a.intersect(b)).union(one("without", b.subtract(a))).union(one("any", b.union(a).distinct()))


# -- upserts and changes ---------------------------------------------------------

query("upsert_items", "SELECT coalesce(n.k, c_custkey) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE c_name END AS name, coalesce(n.src, c_mktsegment) AS src FROM customer FULL JOIN (SELECT c_custkey + 1000 AS k, 'new ' || c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS src FROM customer) n ON n.k = c_custkey")(
    lambda s, d: tables.upsert(t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("src")), t(s, d, "customer").select((F.col("c_custkey") + 1000).alias("k"), F.concat(F.lit("new "), "c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("src")), ["k"], ("src",))
)
query("insert_ignore", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 <> 0")(lambda s, d: tables.insert_ignore(t(s, d, "lineitem").where("l_orderkey % 2 = 0").select("l_orderkey", "l_linenumber"), t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]))
query("delete_by_key", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")(lambda s, d: tables.delete(t(s, d, "embeddings").select("vec_id"), t(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")), ["vec_id"]))
query("keep_first_by_key", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")(lambda s, d: tables.keep_first(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey")]))
query("change_detection", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NOT NULL AND a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2) b USING (doc_id)")(
    lambda s, d: tables.changes(t(s, d, "documents").where("doc_id % 10 <> 1").select("doc_id", F.sha2("text", 256).alias("h")), t(s, d, "documents").where("doc_id % 10 <> 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h")), "doc_id", "h")
)
query("stale_cleanup", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: tables.stale(t(s, d, "documents"), t(s, d, "labels"), "doc_id"))
query("stale_cleanup_guard", "SELECT doc_id FROM documents WHERE false")(lambda s, d: tables.stale(t(s, d, "documents"), t(s, d, "labels").where("false"), "doc_id"))
# -- event log -------------------------------------------------------------------

LOG = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS r FROM events) WHERE r = 1"


def log_of(spark, d):
    e = t(spark, d, "events").withColumn("h", eventlog.content_hash("user_id", "event_type", "props"))
    return eventlog.append(e, "user_id", "event_id", "h")


query("events_append_dedup", f"SELECT user_id, event_id, event_type, seq FROM ({LOG})")(lambda s, d: log_of(s, d).select("user_id", "event_id", "event_type", "seq"))
query("events_after_cursor", f"SELECT event_id, seq FROM ({LOG}) WHERE user_id = 8 AND seq > 5")(lambda s, d: eventlog.after(log_of(s, d), "user_id", 8, 5).select("event_id", "seq"))
query("events_point_lookup", f"SELECT event_id, event_type FROM ({LOG}) WHERE user_id = 8 AND seq = 3")(lambda s, d: log_of(s, d).where("user_id = 8 AND seq = 3").select("event_id", "event_type"))
query("events_frames", """SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN '{"truncated":true,"full_payload_seq":' || doc_id || ',"original_size":' || strlen(text) || '}' ELSE text END AS frame FROM documents""")(lambda s, d: eventlog.frames(t(s, d, "documents").withColumn("seq", F.col("doc_id")), "text", 2000).select("doc_id", "frame"))
query("events_gaps", "SELECT user_id, was + 1 AS expected, event_id AS found FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE event_id - was > 1")(lambda s, d: eventlog.gaps(t(s, d, "events").withColumn("seq", F.col("event_id")), "user_id"))
query("events_grouped", "SELECT user_id, CAST(grp AS BIGINT) AS grp, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type AND event_type <> 'error' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, grp, event_type")(lambda s, d: eventlog.grouped(t(s, d, "events"), "user_id", "event_id", "event_type", "error"))
query("events_stuck", "SELECT event_id, CAST(stale AS BIGINT) AS stale, CASE WHEN stale = 0 THEN 'ok' WHEN stale = 1 THEN 'warning' WHEN stale <= 3 THEN 'diagnostic' ELSE 'circuit_break' END AS step FROM (SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS stale FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events))")(lambda s, d: eventlog.stuck(t(s, d, "events").withColumn("ok", F.col("event_type") == "purchase"), "user_id", "event_id", "ok").select("event_id", "stale", "step"))
query("events_transitions", "SELECT event_id, was, event_type, (was || '>' || event_type IN ('view>click', 'click>purchase', 'signup>view')) OR event_type = 'error' AS valid FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS NOT NULL")(lambda s, d: eventlog.transitions(t(s, d, "events"), "user_id", "event_id", "event_type", [("view", "click"), ("click", "purchase"), ("signup", "view")], "error").select("event_id", "was", "event_type", "valid"))
query("events_ring", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10")(lambda s, d: eventlog.ring(t(s, d, "events"), "user_id", "event_id", 10).select("user_id", "event_id"))
query("events_buckets", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, event_type, count(*) AS cnt FROM events GROUP BY 1, 2")(lambda s, d: eventlog.buckets(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "day", "event_type").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd")))
query("events_typed_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type IN ('click', 'view') THEN 'ui' WHEN event_type = 'error' THEN 'fault' ELSE 'opaque' END AS kind FROM events")(lambda s, d: t(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.when(F.col("event_type").isin("click", "view"), "ui").when(F.col("event_type") == "error", "fault").otherwise("opaque").alias("kind")))
query("events_backoff", "SELECT event_id, CAST(least(30000, 1000 * pow(2, event_id % 8)) AS BIGINT) AS wait_ms FROM events")(lambda s, d: t(s, d, "events").withColumn("a", F.col("event_id") % 8).select("event_id", eventlog.backoff_ms("a").alias("wait_ms")))
query("transcript_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(role || ' ' || text), 'user the')")(lambda s, d: t(s, d, "conversations").where(F.lower(F.concat_ws(" ", "role", "text")).contains("user the")).select("conv_id", "turn"))

# -- audits ----------------------------------------------------------------------

WS = "SELECT c_custkey AS id, c_name AS fqn, CASE WHEN c_custkey % 97 = 0 THEN [] WHEN c_custkey % 89 = 0 THEN ['Workspace_' || c_nationkey, 'Workspace_x'] ELSE ['Workspace_' || c_nationkey] END AS ws FROM customer"
WE = f"n AS ({WS}), e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 13 + o_orderkey % 3) % (SELECT count(*) FROM customer) AS dst FROM orders), x AS (SELECT src, dst, a.ws[1] AS wa, b.ws[1] AS wb FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE len(a.ws) = 1 AND len(b.ws) = 1 AND a.ws[1] <> b.ws[1])"


def tenant_nodes(s, d):
    w = F.concat(F.lit("Workspace_"), F.col("c_nationkey").cast("string"))
    labels = F.when(F.col("c_custkey") % 97 == 0, F.array(F.lit("Function"))).when(F.col("c_custkey") % 89 == 0, F.array(F.lit("Function"), w, F.lit("Workspace_x"))).otherwise(F.array(F.lit("Function"), w))
    return t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("fqn"), labels.alias("labels"))


def tenant_edges(s, d):
    o = t(s, d, "orders").crossJoin(t(s, d, "customer").agg(F.count("*").alias("nc")))
    return o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 13 + F.col("o_orderkey") % 3) % F.col("nc")).alias("dst")).distinct()


query("audit_multi_label", f"SELECT id FROM ({WS}) WHERE len(ws) > 1")(lambda s, d: audit.multi_label(tenant_nodes(s, d)).select("id"))
query("audit_orphans", f"SELECT id FROM ({WS}) WHERE len(ws) = 0")(lambda s, d: audit.orphans(tenant_nodes(s, d)).select("id"))
query("audit_per_tenant", f"SELECT w AS workspace, count(*) AS nodes, CAST(sum(CASE WHEN len(ws) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS leaking FROM (SELECT unnest(ws) AS w, ws FROM ({WS})) GROUP BY 1")(lambda s, d: audit.per_tenant(tenant_nodes(s, d)))
query("audit_cross_tenant", f"WITH {WE} SELECT src, dst, wa AS src_workspace, wb AS dst_workspace FROM x")(lambda s, d: audit.cross_tenant(tenant_nodes(s, d), tenant_edges(s, d)))
query("audit_label_mismatch", f"WITH {WE} SELECT id, expected, cnt FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cnt DESC, expected) AS r FROM (SELECT id, expected, count(*) AS cnt FROM (SELECT src AS id, wb AS expected FROM x UNION ALL SELECT dst, wa FROM x) GROUP BY 1, 2)) WHERE r = 1")(lambda s, d: audit.label_mismatch(tenant_nodes(s, d), tenant_edges(s, d)))
query("audit_shared_names", "SELECT p_name AS fqn, count(DISTINCT p_brand) AS workspaces FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")(lambda s, d: audit.shared_names(t(s, d, "part").select(F.col("p_name").alias("fqn"), F.col("p_brand").alias("workspace_id"))))
THREE = "p AS (SELECT id, d.doc_id IS NOT NULL AS in_pg, l.doc_id IS NOT NULL AS in_graph, v.vec_id IS NOT NULL AS in_vector FROM (SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings) k LEFT JOIN documents d ON d.doc_id = id LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = id LEFT JOIN embeddings v ON v.vec_id = id)"
STORES = ("pg", "graph", "vector")


def stores(s, d):
    return tables.presence("id", pg=t(s, d, "documents").withColumnRenamed("doc_id", "id"), graph=t(s, d, "labels").withColumnRenamed("doc_id", "id"), vector=t(s, d, "embeddings").withColumnRenamed("vec_id", "id"))


query("consistency_presence", f"WITH {THREE} SELECT id, in_pg, in_graph, in_vector, in_pg AND in_graph AND in_vector AS synced, array_to_string(list_filter([CASE WHEN NOT in_pg THEN 'pg' END, CASE WHEN NOT in_graph THEN 'graph' END, CASE WHEN NOT in_vector THEN 'vector' END], lambda x: x IS NOT NULL), ',') AS missing FROM p")(stores)
query("consistency_pairwise", f"WITH {THREE} " + " UNION ALL ".join(f"SELECT '{a}' AS has, '{b}' AS lacks, count(*) AS cnt FROM p WHERE in_{a} AND NOT in_{b}" for a in STORES for b in STORES if a != b))(lambda s, d: audit.pairwise(stores(s, d), STORES))
query("consistency_health", f"WITH {THREE} SELECT id % 10 AS crate, CAST(sum(CAST(in_pg AS INT)) AS BIGINT) AS pg, CAST(sum(CAST(in_graph AS INT)) AS BIGINT) AS graph, CAST(sum(CAST(in_vector AS INT)) AS BIGINT) AS vector, bool_and(in_pg AND in_graph AND in_vector) AS sets_equal, sum(CAST(in_graph AS INT)) = sum(CAST(in_pg AS INT)) AND sum(CAST(in_vector AS INT)) = sum(CAST(in_pg AS INT)) AS consistent FROM p GROUP BY 1")(lambda s, d: audit.health(stores(s, d), (F.col("id") % 10).alias("crate"), STORES))
query("retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")(lambda s, d: audit.retained(t(s, d, "events"), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 7).select("event_id"))
query("gap_status", "SELECT event_type, CASE WHEN event_type = 'error' THEN 'broken' WHEN count(*) FILTER (WHERE value > 1000) = 0 THEN 'partial' ELSE 'working' END AS status FROM events GROUP BY 1")(lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 1000).alias("n")).select("event_type", audit.feature_status(F.col("event_type") != "error", F.col("n")).alias("status")))

# -- evaluation --------------------------------------------------------------------

RUNS = "SELECT l_returnflag AS suite, l_partkey % 50 AS c, round(l_quantity / 10, 1) AS composite, l_quantity > 40 AS passed, CASE WHEN l_linenumber <> 3 THEN l_tax END AS cost FROM lineitem"


def runs_of(li):
    return li.select(F.col("l_returnflag").alias("suite"), (F.col("l_partkey") % 50).alias("c"), F.round(F.col("l_quantity") / 10, 1).alias("composite"), (F.col("l_quantity") > 40).alias("passed"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("cost"))


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


CASE1 = "SELECT suite || ':' || c AS id, bool_or(passed) AS passed, avg(composite) AS m FROM ({0}) GROUP BY 1"
query("eval_cases", f"SELECT suite, c, count(*) AS runs, round(avg(composite), 6) AS mean_composite, round(stddev_pop(composite), 6) AS std_composite, bool_or(passed) AS passed, round(sum(coalesce(cost, 0)), 6) AS cost FROM ({RUNS}) GROUP BY 1, 2")(lambda s, d: _rounded(evals.cases(runs_of(t(s, d, "lineitem")), "suite", "c"), "mean_composite", "std_composite", "cost"))
query("eval_suites", f"WITH r AS ({RUNS}), p AS (SELECT suite, c, bool_or(passed) AS ok FROM r GROUP BY 1, 2) SELECT r.suite, round(avg(composite), 6) AS mean_composite, round(var_pop(composite), 6) AS var_composite, round(sum(coalesce(cost, 0)), 6) AS total_cost, (SELECT count(*) FROM p WHERE p.suite = r.suite) AS cases, (SELECT count(*) FROM p WHERE p.suite = r.suite AND ok) AS passing, round((SELECT avg(CAST(ok AS INT)) FROM p WHERE p.suite = r.suite), 6) AS pass_rate FROM r GROUP BY r.suite")(lambda s, d: _rounded(evals.suites(runs_of(t(s, d, "lineitem")), "suite", "c"), "mean_composite", "var_composite", "total_cost", "pass_rate"))
query("eval_compare", f"SELECT id, CASE WHEN b.passed IS NULL THEN 'new' WHEN n.passed IS NULL THEN 'removed' WHEN b.passed AND NOT n.passed THEN 'regression' WHEN NOT b.passed AND n.passed THEN 'improvement' ELSE 'stable' END AS kind, round(n.m - b.m, 6) AS delta FROM ({CASE1.format(RUNS + ' WHERE l_orderkey % 2 = 0')}) b FULL JOIN ({CASE1.format(RUNS + ' WHERE l_orderkey % 2 = 1')}) n USING (id)")(
    lambda s, d: _rounded(evals.compare(*[evals.cases(runs_of(t(s, d, "lineitem").where(f"l_orderkey % 2 = {k}")), "suite", "c").withColumn("id", F.concat_ws(":", "suite", F.col("c").cast("string"))) for k in (0, 1)], "id"), "delta")
)
query("eval_weighted", "SELECT l_orderkey, l_linenumber, round(0.15 * l_tax + 0.15 * l_discount + 0.30 * l_quantity, 6) AS composite, CASE WHEN l_returnflag = 'R' THEN 0.15 * l_tax + 0.15 * l_discount + 0.30 * l_quantity < 2.0 ELSE 0.15 * l_tax + 0.15 * l_discount + 0.30 * l_quantity >= 3.0 END AS passed FROM lineitem")(lambda s, d: _weighted(t(s, d, "lineitem")))
query("eval_advisory", "SELECT lang, CASE WHEN avg(quality) >= 0.8 THEN 'pass' WHEN avg(quality) >= 0.5 THEN 'warning' ELSE 'fail' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY 1")(lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("r")).select("lang", evals.advisory(F.col("r")).alias("status")))
query("eval_overlap", "SELECT o_custkey, round(len(list_intersect(e, a)) / len(a), 6) AS precision_, round(len(list_intersect(e, a)) / len(e), 6) AS recall_ FROM (SELECT o_custkey, list(DISTINCT o_orderkey % 5) AS e, list(DISTINCT o_orderkey % 7) AS a FROM orders GROUP BY 1)")(lambda s, d: _overlap(t(s, d, "orders")))
query("eval_line_similarity", "SELECT a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS sim FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 7 + 3) % (SELECT count(*) FROM part)")(
    lambda s, d: t(s, d, "part").crossJoin(t(s, d, "part").agg(F.count("*").alias("np"))).withColumn("k", (F.col("p_partkey") * 7 + 3) % F.col("np")).join(t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("o")), "k").select("p_partkey", F.round(S.jaro_winkler("p_name", "o"), 6).alias("sim"))
)
query("eval_progress", "SELECT user_id, round(count(*) / 60.0, 6) AS rate, CASE WHEN count(*) / 60.0 >= 0.001 THEN round((200 - count(*)) / (count(*) / 60.0), 6) END AS seconds_left FROM events GROUP BY 1")(lambda s, d: _progress(t(s, d, "events")))


def _weighted(li):
    li = li.withColumn("m", evals.weighted({"file_precision": F.col("l_tax"), "file_recall": F.col("l_discount"), "logical_equivalence": F.col("l_quantity")}))
    return li.select("l_orderkey", "l_linenumber", F.round("m", 6).alias("composite"), evals.passes(F.col("m"), F.col("l_returnflag") == "R").alias("passed"))


def _overlap(o):
    g = o.groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 5).alias("e"), F.collect_set(F.col("o_orderkey") % 7).alias("a"))
    p, r = evals.overlap(F.col("e"), F.col("a"))
    return g.select("o_custkey", F.round(p, 6).alias("precision_"), F.round(r, 6).alias("recall_"))


def _progress(e):
    rate, left = evals.eta(F.col("n"), F.lit(200), F.lit(60.0))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.round(rate, 6).alias("rate"), F.round(left, 6).alias("seconds_left"))


# -- texts -------------------------------------------------------------------------

query("text_clip", f"SELECT doc_id, {CLIP} AS preview FROM documents")(lambda s, d: t(s, d, "documents").select("doc_id", S.clip_bytes("text").alias("preview")))
query("text_body_size", "SELECT doc_id, CASE WHEN strlen(text) > 1000 THEN '[BODY: ' || strlen(text) || ' bytes]' ELSE text END AS body FROM documents")(lambda s, d: t(s, d, "documents").select("doc_id", S.body_or_size("text", 1000).alias("body")))
PREVIEW = "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, len(l) AS n, list_transform(l, lambda x, i: lpad(CAST(i AS VARCHAR), 4, ' ') || ': ' || x) AS l FROM d) "
query("text_body_preview", PREVIEW + "SELECT doc_id, array_to_string(CASE WHEN n <= 50 THEN l ELSE list_concat(list_concat(l[1:13], ['  ... (' || (n - 20) || ' lines omitted) ...']), l[n - 6:n]) END, chr(10)) AS preview FROM n")(lambda s, d: t(s, d, "documents").select("doc_id", S.body_preview("text").alias("preview")))
UUID = "SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer"
query("text_uuid5", f"SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[CAST((strpos('0123456789abcdef', h[17]) - 1) % 4 + 1 AS INTEGER)] || h[18:20] || '-' || h[21:32] AS id FROM ({UUID})")(lambda s, d: t(s, d, "customer").select("c_custkey", S.uuid5("c_name").alias("id")))
query("text_fallback", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END, ''), c_name) AS v FROM customer")(lambda s, d: t(s, d, "customer").select("c_custkey", S.fallback(F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, None).otherwise(F.col("c_mktsegment")), "c_name").alias("v")))
query("text_hash", "SELECT doc_id, sha256(text) AS h FROM documents")(lambda s, d: t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")))
# A fold over pieces: each stands for a list of done chunks and the one being filled.
FOLD = "list_reduce(list_transform({0}, lambda x: {{'done': []::VARCHAR[], 'cur': x}}), lambda a, b: CASE WHEN {1} THEN {{'done': list_append(a.done, {2}), 'cur': b.cur}} ELSE {{'done': a.done, 'cur': a.cur || {3} || b.cur}} END)"
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SENTENCES = FOLD.format("regexp_extract_all(p, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+')", "strlen(a.cur) + strlen(b.cur) > 500", TRIM.format("a.cur"), "''")
# The texts hold no empty lines, so each is one paragraph.
query("text_chunks", f"WITH p AS (SELECT doc_id, text AS p FROM documents WHERE {TRIM.format('text')} <> ''), f AS (SELECT doc_id, {SENTENCES} AS f, p FROM p), c AS (SELECT doc_id, CASE WHEN strlen(p) <= 500 THEN [{TRIM.format('p')}] WHEN {TRIM.format('f.cur')} <> '' THEN list_append(f.done, {TRIM.format('f.cur')}) ELSE f.done END AS c FROM f) SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, c[i] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)")(lambda s, d: chunks.exploded(t(s, d, "documents"), "doc_id", "text", chunks.text_chunks))
SEEN = "html"
for _tag in ("script", "style", "nav", "footer", "head"):
    SEEN = f"regexp_replace({SEEN}, '(?is)<{_tag}\\b[^>]*>.*?(</{_tag}\\s*>|$)', '{'' if _tag == 'script' else '<i>'}', 'g')"
SEEN = f"regexp_replace({SEEN}, '(?s)<!--.*?-->', '<i>', 'g')"
PIECES = "list_filter(list_transform(regexp_split_to_array({0}, '</?[A-Za-z!][^>]*>'), lambda x: regexp_replace(replace(replace(replace(replace(x, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
# Each page has one heading, with text before and behind it.
query("html_sections", f"WITH p AS (SELECT page_id, regexp_split_to_array({SEEN}, '(?i)<h[1-4]\\b[^>]*>') AS p FROM pages), q AS (SELECT page_id, i, CASE WHEN i = 1 THEN '' ELSE {PIECES.format(chr(39).join(['split_part(p[i], ', '</h1>', ', 1)']))}[-1] END AS heading, array_to_string({PIECES.format('CASE WHEN i = 1 THEN p[i] ELSE split_part(p[i], ' + chr(39) + '</h1>' + chr(39) + ', 2) END')}, ' ') AS text FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS section, heading, text FROM q WHERE text <> ''")(lambda s, d: chunks.sections(t(s, d, "pages"), "page_id", "html"))
HTML_FOLD = FOLD.format("regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))", "length(a.cur) + length(b.cur) > 500", "a.cur", "' '")
query("html_chunks", f"WITH f AS (SELECT doc_id, {HTML_FOLD} AS f FROM documents WHERE text <> ''), c AS (SELECT doc_id, list_filter(list_transform(list_append(f.done, f.cur), lambda x: {TRIM.format('x')}), lambda x: length(x) > 30) AS c FROM f) SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, c[i] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)")(lambda s, d: chunks.exploded(t(s, d, "documents"), "doc_id", "text", chunks.html_chunks))
MARK = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Lead ' || doc_id || chr(10) END || '# Top ' || doc_id || chr(10) || repeat('word ', CAST(doc_id % 90 AS INTEGER)) || chr(10) || '## Sub' || chr(10) || '### deep' || chr(10) || repeat('text ', CAST(50 + doc_id % 50 AS INTEGER))"
MERGED = "length('# Top ' || doc_id || chr(10) || repeat('word ', CAST(doc_id % 90 AS INTEGER))) - CASE WHEN doc_id % 90 > 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 90 = 0 THEN 1 ELSE 0 END < 200 AND doc_id % 3 <> 0"
query("markdown_chunks", f"WITH d AS (SELECT doc_id, {MERGED} AS merged, '# Top ' || doc_id || CASE WHEN doc_id % 90 > 0 THEN chr(10) || rtrim(repeat('word ', CAST(doc_id % 90 AS INTEGER))) ELSE '' END AS top, '## Sub' || chr(10) || '### deep' || chr(10) || rtrim(repeat('text ', CAST(50 + doc_id % 50 AS INTEGER))) AS sub FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [['Top ' || doc_id, 'File: a/notes.md > Top ' || doc_id || chr(10) || chr(10) || top], ['Sub', 'File: a/notes.md > Top ' || doc_id || ' > Sub' || chr(10) || chr(10) || sub]] WHEN merged THEN [['notes / Top ' || doc_id, 'File: a/notes.md' || chr(10) || chr(10) || 'Lead ' || doc_id || chr(10) || chr(10) || top], ['Sub', 'File: a/notes.md > Top ' || doc_id || ' > Sub' || chr(10) || chr(10) || sub]] ELSE [['notes', 'File: a/notes.md' || chr(10) || chr(10) || 'Lead ' || doc_id], ['Top ' || doc_id, 'File: a/notes.md > Top ' || doc_id || chr(10) || chr(10) || top], ['Sub', 'File: a/notes.md > Top ' || doc_id || ' > Sub' || chr(10) || chr(10) || sub]] END AS c FROM d) SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, c[i][1] AS heading, c[i][2] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)")(
    lambda s, d: chunks.exploded(_markdown(t(s, d, "documents")), "doc_id", "text", lambda x: chunks.markdown_chunks(x, "a/notes.md"), "chunk_index int, heading string, chunk string")
)


def _markdown(docs):
    n = F.col("doc_id").cast("string")
    rep = lambda w, k: F.repeat(F.lit(w), k.cast("int"))
    lead = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Lead "), n, F.lit("\n")))
    body = F.concat(lead, F.lit("# Top "), n, F.lit("\n"), rep("word ", F.col("doc_id") % 90), F.lit("\n## Sub\n### deep\n"), rep("text ", F.col("doc_id") % 50 + 50))
    return docs.select("doc_id", body.alias("text"))


query("file_tree", "WITH p AS (SELECT DISTINCT r_name || '/' || n_name || '/' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS path, CASE WHEN k > 1 THEN array_to_string(string_split(path, '/')[1:k-1], '/') END AS parent FROM p, (SELECT unnest([1, 2, 3]) AS k)")(lambda s, d: _tree(s, d))


def _tree(s, d):
    p = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tables.tree(p.select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path")).distinct()).select("path", "parent")


# -- read-only SQL -------------------------------------------------------------------

PASS = "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = {0} ORDER BY total DESC, c_name LIMIT 20"


@query("sql_pass_through", PASS.format("'BUILDING'"))
def _sql(spark, d):
    for name in ("orders", "customer"):
        t(spark, d, name).createOrReplaceTempView(name)
    return sqlgate.sql(spark, PASS.format(":segment"), ("orders", "customer"), {"segment": "BUILDING"})


query("tenant_scope", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")(lambda s, d: Graph(t(s, d, "customer").withColumn("workspace_id", F.col("c_nationkey").cast("string")), t(s, d, "orders").withColumn("workspace_id", F.lit("3"))).tenant("3").nodes.select("c_custkey"))
query("rows_as_json", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS row FROM region""")(lambda s, d: files.as_json(t(s, d, "region")))
query("first_rows", "SELECT n_name FROM nation ORDER BY n_name LIMIT 5")(lambda s, d: first(t(s, d, "nation").select("n_name"), 5, "n_name"))

# Further queries of the suite register themselves when they are imported.
from . import suite_code, suite_match, suite_ops, suite_state  # noqa: E402, F401
