"""A property graph over two DataFrames, and the named queries on it.

nodes: fqn, name, label, file_path, start_line and any further columns.
edges: src, dst, rel (fqn to fqn).  A tenant's graph is a filter on both before
anything else, so no query can reach beyond it.  Reads are declarative joins;
traversals are at most MAX_DEPTH of them, with what was reached before removed
after each hop, so rows don't multiply along parallel paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import method_prefix
from .lineage import cut

# The node labels, the type labels and the relationships a count may name.
LABELS = ("Function", "Struct", "Enum", "Trait", "Impl", "Module", "Crate", "Type", "TypeAlias", "Const", "Static", "Macro")
ITEM_LABELS = ("Function", "Struct", "Enum", "Trait", "Impl", "TypeAlias")
TYPE_LABELS = ("Struct", "Enum", "Trait", "Type", "TypeAlias")
COUNTED = ("CALLS", "IMPLEMENTS", "USES_TYPE", "CONTAINS", "HAS_METHOD")
MAX_DEPTH, MAX_LIMIT, DEFAULT_LIMIT = 5, 100, 25


def clamp(value, low: int, high: int, default: int) -> int:
    """A parameter as an int inside its bounds; numeric strings count, anything else is the default."""
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default


def known_label(label: str) -> str:
    if label not in LABELS:
        raise ValueError(f"unknown label: {label}")
    return label


def crate_of(fqn: str | Column) -> Column:
    return F.split_part(F.col(fqn) if isinstance(fqn, str) else fqn, F.lit("::"), F.lit(1))


def parent_of(fqn: str | Column) -> Column:
    """The name without its last segment; null at the top."""
    c = F.col(fqn) if isinstance(fqn, str) else fqn
    return F.nullif(F.regexp_extract(c, r"^(.*)::[^:]*$", 1), F.lit(""))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def tenant(self, workspace_id: str) -> Graph:
        """The graph of one workspace."""
        own = F.col("workspace_id") == workspace_id
        return Graph(self.nodes.where(own), self.edges.where(own))

    def named(self, name: str) -> DataFrame:
        """Nodes with this name or full name."""
        return self.nodes.where((F.col("name") == name) | (F.col("fqn") == name))

    def rel(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("rel").isin(*kinds))

    def hop(self, seeds: DataFrame, kinds: tuple[str, ...], back: bool = False) -> DataFrame:
        """Distinct fqn one directed edge away from seeds(fqn)."""
        a, b = ("dst", "src") if back else ("src", "dst")
        return self.rel(*kinds).join(seeds.select(F.col("fqn").alias(a)), a, "left_semi").select(F.col(b).alias("fqn")).distinct()

    def reach(self, seeds: DataFrame, kinds: tuple[str, ...], depth: int, back: bool = False) -> DataFrame:
        """fqn and depth (the least) of all that 1..depth directed edges reach.

        A seed is in it only if edges lead back to it: hops are held against
        earlier hops, not against the seeds.
        """
        found, front = None, seeds.select("fqn").distinct()
        for d in range(1, depth + 1):
            front = self.hop(front, kinds, back)
            if found is not None:
                front = front.join(found, "fqn", "left_anti")
            if d < depth:  # used twice, by the next hop and in the result
                front = cut(front)
            layer = front.withColumn("depth", F.lit(d))
            found = layer if found is None else found.unionByName(layer)
        return found

    def of(self, ids: DataFrame, *cols: str, with_file: bool = True) -> DataFrame:
        """Columns of the nodes in ids(fqn, ...)."""
        nodes = self.nodes.where("file_path IS NOT NULL") if with_file else self.nodes
        return nodes.hint("merge").join(ids, "fqn").select(*cols)

    # -- named queries ------------------------------------------------------

    def functions_by_name(self, name: str, limit=DEFAULT_LIMIT) -> DataFrame:
        out = self.nodes.where((F.col("label") == "Function") & (F.col("name") == name) & F.col("file_path").isNotNull())
        return first(out.select("fqn", "name", "file_path", "start_line"), limit)

    def callers(self, name: str, depth=1, limit=None) -> DataFrame:
        ids = self.reach(self.named(name), ("CALLS",), clamp(depth, 1, MAX_DEPTH, 1), back=True).select("fqn")
        return first(self.of(ids, "fqn", "name", "file_path", "start_line"), limit)

    def callers_api(self, fqn: str, depth: int = 1, limit=None) -> DataFrame:
        """Functions that reach a function, itself left out; `least` is the true distance. A depth over 10 is an error, over 5 it is 5."""
        if not 1 <= int(depth) <= 10:
            raise ValueError("depth must lie in 1..10")
        functions = self.nodes.where("label = 'Function'")
        own = Graph(functions, self.rel("CALLS"))
        ids = own.reach(functions.where(F.col("fqn") == fqn), ("CALLS",), min(int(depth), MAX_DEPTH), back=True)
        out = functions.join(ids, "fqn").where(F.col("fqn") != fqn)
        return first(out.select("fqn", "name", "file_path", "start_line", F.lit(1).alias("depth"), F.col("depth").alias("least")), limit)

    def callees(self, name: str, limit=None) -> DataFrame:
        return first(self.of(self.hop(self.named(name), ("CALLS",)), "fqn", "name", "file_path"), limit)

    def callees_api(self, fqn: str) -> DataFrame:
        """One row for each stored edge."""
        e = self.rel("CALLS").where(F.col("src") == fqn).select(F.col("dst").alias("fqn"))
        return self.of(e, "fqn", "name", with_file=False).orderBy("name", "fqn")

    def callers_for_prefix(self, prefix: str, depth=1, limit=None) -> DataFrame:
        """Callers from outside of all functions under a prefix."""
        functions = self.nodes.where("label = 'Function'")
        ids = self.reach(functions.where(F.col("fqn").startswith(prefix)), ("CALLS",), clamp(depth, 1, MAX_DEPTH, 1), back=True)
        out = functions.join(ids.select("fqn"), "fqn").where(~F.col("fqn").startswith(prefix))
        return first(out.select("fqn", "name", "file_path", "start_line"), limit)

    def callees_for_prefix(self, prefix: str, limit=None) -> DataFrame:
        seeds = self.nodes.where((F.col("label") == "Function") & F.col("fqn").startswith(prefix))
        out = self.of(self.hop(seeds, ("CALLS",)), "fqn", "name", with_file=False).where(~F.col("fqn").startswith(prefix))
        return first(out, limit, "name", "fqn")

    def trait_implementations(self, name: str, limit=None) -> DataFrame:
        """Implementers of traits by name, or by full name if they have a file: the file test binds to the full name only."""
        traits = self.nodes.where("label = 'Trait'").select(F.col("fqn").alias("dst"), F.col("name").alias("t"))
        hit = self.rel("IMPLEMENTS").join(traits, "dst").select(F.col("src").alias("fqn"), "dst", "t")
        out = self.nodes.join(hit, "fqn").where((F.col("t") == name) | ((F.col("dst") == name) & F.col("file_path").isNotNull()))
        return first(out.select("fqn", "name", "file_path", "start_line"), limit)

    def trait_impls_api(self, name: str, limit=10) -> DataFrame:
        traits = self.nodes.where((F.col("label") == "Trait") & ((F.col("name") == name) | F.col("fqn").contains(name))).select(F.col("fqn").alias("dst"))
        hit = self.rel("IMPLEMENTS").join(traits, "dst", "left_semi").select(F.col("src").alias("fqn")).distinct()
        kind = F.when(F.col("name").contains("_"), F.split_part("name", F.lit("_"), F.lit(2))).otherwise(F.col("name"))
        out = self.nodes.join(hit, "fqn").select(F.col("fqn").alias("impl_fqn"), kind.alias("type_name"), F.lit("").alias("file_path"), "start_line")
        return first(out, limit, "impl_fqn")

    def by_fqn(self, fqn: str, label: str = "Function") -> DataFrame:
        return self.nodes.where((F.col("label") == known_label(label)) & ((F.col("fqn") == fqn) | (F.col("name") == fqn)))

    def neighbours(self, name: str, depth=1, limit=None) -> DataFrame:
        """Distinct (last relationship, node) over undirected paths of 1..depth edges, none used twice in a path.

        A breadth-first search gives every arrival from a node no farther off than
        the one arrived at.  An arrival that leads back towards the start over an
        edge needs another way to that edge's far end; it is looked for backwards,
        for arrivals that nothing else accounts for, and only where the start is
        still near enough.  So paths aren't enumerated, and a hub costs its edges.
        """
        depth = clamp(depth, 1, MAX_DEPTH, 1)
        e = self.edges.select("src", "dst", "rel").distinct().withColumn("e", F.xxhash64("src", "dst", "rel"))
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v"), "rel", "e").union(e.where("src <> dst").select(F.col("dst").alias("u"), F.col("src").alias("v"), "rel", "e"))
        levels = cut(self.named(name).select(F.col("fqn").alias("n")).distinct().withColumn("level", F.lit(0)))
        found, back = None, None
        for d in range(1, depth + 1):
            step = both.join(levels.where(F.col("level") == d - 1).select(F.col("n").alias("u")), "u")
            step = cut(step.join(levels.select(F.col("n").alias("v"), F.col("level").alias("at")), "v", "left"))
            near = F.coalesce("at", F.lit(d)) >= d - 1
            layer, behind = step.where(near).select(F.col("v").alias("fqn"), "rel"), step.where(~near).select("v", "rel", "e", "u")
            found, back = (layer, behind) if found is None else (found.union(layer), back.union(behind))
            if d < depth:
                levels = cut(levels.union(step.where("at IS NULL").select(F.col("v").alias("n"), F.lit(d).alias("level")).distinct()))
        found = found.distinct()
        if depth > 1:
            open_ = back.join(found, (F.col("v") == F.col("fqn")) & (back["rel"] == found["rel"]), "left_anti")
            ways = cut(open_.select("v", "rel", F.col("u").alias("at"), F.array("e").alias("used")).distinct())
            for left in range(depth - 1, 0, -1):  # edges that the other way may still have
                if not ways.take(1):
                    break
                on = both.select(F.col("v").alias("at"), F.col("u").alias("next"), F.col("e").alias("f"))
                ways = ways.join(on, "at").where(~F.array_contains("used", F.col("f")))
                ways = ways.join(levels.where(F.col("level") < left).select(F.col("n").alias("next"), "level"), "next")
                ways = cut(ways.select("v", "rel", F.col("next").alias("at"), F.array_sort(F.array_append("used", F.col("f"))).alias("used"), "level").distinct())
                done = ways.where("level = 0").select(F.col("v").alias("fqn"), "rel").distinct()
                found = cut(found.union(done).distinct())
                ways = ways.drop("level").join(done.withColumnRenamed("fqn", "v"), ["v", "rel"], "left_anti")
        out = self.nodes.join(found, "fqn").select(F.col("rel").alias("relationship"), "fqn", "name", "label")
        return first(out, limit, "fqn", "relationship")

    def with_label(self, label: str, limit=None) -> DataFrame:
        return first(self.nodes.where(F.col("label") == known_label(label)).select("fqn", "name"), limit)

    def module_contents(self, name: str, limit=None) -> DataFrame:
        ids = self.hop(self.named(name).where("label = 'Module'"), ("CONTAINS",))
        return first(self.of(ids, "fqn", "name", "label", with_file=False), limit)

    def crate_overview(self, crate: str) -> DataFrame:
        """Children of a crate by label; a crate without children gives one row of count 0."""
        seeds = self.nodes.where((F.col("label") == "Crate") & (F.col("name") == crate)).select(F.col("fqn").alias("src"))
        kids = self.rel("CONTAINS").join(seeds, "src", "right").select(F.col("dst").alias("fqn"))
        out = kids.join(self.nodes.hint("merge"), "fqn", "left").groupBy("label").agg(F.count("fqn").alias("cnt"))
        return out.orderBy(F.desc("cnt"), F.asc_nulls_last("label"))

    def crate_dependencies(self, crate: str, back: bool = False) -> DataFrame:
        seeds = self.nodes.where((F.col("label") == "Crate") & (F.col("name") == crate))
        return self.of(self.hop(seeds, ("DEPENDS_ON",), back), "fqn", "name", with_file=False).orderBy("name")

    def usages_of_type(self, name: str, limit=None) -> DataFrame:
        types = self.nodes.where(F.col("label").isin(*TYPE_LABELS) & ((F.col("name") == name) | (F.col("fqn") == name) | F.col("fqn").endswith("::" + name)))
        ids = self.hop(types, ("USES_TYPE",), back=True)
        return first(self.of(ids, "fqn", "name", F.col("label").alias("kind"), "file_path", "start_line", with_file=False), limit)

    def label_counts(self) -> DataFrame:
        return self.nodes.groupBy("label").agg(F.count("*").alias("cnt"))

    def relationship_counts(self) -> DataFrame:
        return self.edges.groupBy("rel").agg(F.count("*").alias("cnt"))

    def count_relationship(self, rel: str) -> DataFrame:
        if rel not in COUNTED:
            raise ValueError(f"relationship not counted: {rel}")
        return self.rel(rel).agg(F.count("*").alias("cnt"))

    def count_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == known_label(label)).agg(F.count("*").alias("cnt"))

    def totals(self) -> tuple[DataFrame, DataFrame]:
        return self.nodes.agg(F.count("*").alias("cnt")), self.edges.agg(F.count("*").alias("cnt"))

    def health(self) -> DataFrame:
        """Nodes and edges in one row."""
        return self.nodes.agg(F.count("*").alias("nodes")).crossJoin(self.edges.agg(F.count("*").alias("edges")))

    def has_relationship(self, rel: str) -> DataFrame:
        return self.rel(rel).limit(1).agg((F.count("*") > 0).alias("present"))

    def consistency_fqns(self, crate: str | None = None) -> DataFrame:
        out = self.nodes.where(F.col("label").isin(*ITEM_LABELS))
        if crate is not None:
            out = out.where(crate_of("fqn") == crate)
        return out.select("fqn").distinct()

    def consistency_count(self, crate: str | None = None, merged: bool = True) -> DataFrame:
        """Items of six labels. merged=True gives what the union of equal counts gives (labels that tie count once); False the true sum."""
        out = self.nodes.where(F.col("label").isin(*ITEM_LABELS))
        if crate is not None:
            out = out.where(crate_of("fqn") == crate)
        counts = out.groupBy("label").agg(F.count("*").alias("c")).select("c")
        return (counts.distinct() if merged else counts).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("cnt"))

    def module_tree(self, crate: str) -> DataFrame:
        """fqn, label, parent, depth of all under a crate, by containment; a module without parent hangs below the crate itself."""
        own = self.nodes.where(crate_of("fqn") == crate).select("fqn", "label")
        up = self.rel("CONTAINS").select(F.col("dst").alias("fqn"), F.col("src").alias("parent"))
        flat = own.where("label <> 'Crate'").join(up, "fqn", "left").withColumn("parent", F.coalesce("parent", F.lit(crate)))
        depth = F.size(F.split("fqn", "::")) - 1
        root = own.where("label = 'Crate'").select("fqn", "label", F.lit(None).cast("string").alias("parent"))
        return root.unionByName(flat).withColumn("depth", depth)

    def tree(self, crate: str) -> DataFrame:
        """module_tree() from the root down: fqn, label, parent, depth and path (names from the crate, in order); what hangs below no known module hangs below the crate."""
        flat = cut(self.module_tree(crate).select("fqn", "label", "parent").distinct())
        known = flat.select(F.col("fqn").alias("parent"))
        flat = cut(flat.join(known.withColumn("_k", F.lit(True)), "parent", "left").withColumn("parent", F.when(F.col("label") == "Crate", None).otherwise(F.when(F.col("_k"), F.col("parent")).otherwise(F.lit(crate)))).drop("_k"))
        front = self.nodes.sparkSession.range(1).select(F.lit(crate).alias("fqn"), F.lit("Crate").alias("label"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array(F.lit(crate)).alias("path"))
        out, below = front, flat.where("label <> 'Crate'")
        while True:
            up = front.select(F.col("fqn").alias("parent"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
            front = cut(below.join(up, "parent").where(~F.array_contains("_p", F.col("fqn"))).select("fqn", "label", "parent", (F.col("_d") + 1).alias("depth"), F.array_append("_p", F.col("fqn")).alias("path")))
            if not front.take(1):
                return out
            out = out.unionByName(front)

    def item_detail(self, items: DataFrame, files: DataFrame, fqn: str) -> DataFrame:
        """One row: the item, its file, and sorted lists of callers and callees; those of an impl are of the functions under its type, without these themselves."""
        item = items.where(F.col("fqn") == fqn).join(files, "source_file_id", "left")

        def gathered(ids, name):
            return ids.agg(F.array_sort(F.collect_list("fqn")).alias(name))

        kind = item.select("item_type", method_prefix("fqn", "name", "signature").alias("p")).first() if "item_type" in items.columns else None
        if kind is not None and kind["item_type"] == "impl":
            callers, callees = self.callers_for_prefix(kind["p"], 1).select("fqn"), self.callees_for_prefix(kind["p"]).select("fqn")
        else:
            seeds = self.nodes.where(F.col("fqn") == fqn)
            callers, callees = self.hop(seeds, ("CALLS",), True), self.hop(seeds, ("CALLS",))
        return item.crossJoin(gathered(callers, "callers")).crossJoin(gathered(callees, "callees"))

    def pattern(self, start: dict, *steps: tuple[dict, dict], returns: tuple[str, ...], limit=None) -> DataFrame:
        """Rows for a chain of nodes: a node is given by its variable and wanted properties ({"as": "a", "label": ..., "name": ...}; a text that ends in * is a prefix),
        a step by an edge ({"rel": ..., "back": bool}) and the node it leads to; returns lists `variable.property`. Read-only by its nature, and bounded like the named queries."""
        if len(steps) > MAX_DEPTH:
            raise ValueError(f"at most {MAX_DEPTH} steps")

        def of(spec):
            rows = self.nodes
            for k, v in spec.items():
                if k != "as":
                    rows = rows.where(F.col(k).startswith(v[:-1]) if isinstance(v, str) and v.endswith("*") else F.col(k) == v)
            return rows.select(*[F.col(c).alias(f"{spec['as']}.{c}") for c in self.nodes.columns])

        out, last = of(start), start["as"]
        for edge, node in steps:
            a, b = ("dst", "src") if edge.get("back") else ("src", "dst")
            hop = self.rel(edge["rel"]).select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
            out = out.join(hop, F.col(f"`{last}.fqn`") == F.col("_a")).drop("_a")
            out = out.join(of(node), F.col("_b") == F.col(f"`{node['as']}.fqn`")).drop("_b")
            last = node["as"]
        out = out.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in returns]).distinct()
        return out if limit is None else out.orderBy(*out.columns).limit(clamp(limit, 1, MAX_LIMIT, DEFAULT_LIMIT))

    def query(self, name: str, /, **params) -> DataFrame:
        """A named query with its parameters; aliases of the name parameter are tried in order."""
        who = next((params[k] for k in ("name", "fqn", "function_name", "trait_name", "type_name", "crate", "crate_name", "module", "label") if k in params), None)
        limit = clamp(params.get("limit"), 1, MAX_LIMIT, DEFAULT_LIMIT)
        depth = clamp(params.get("depth"), 1, MAX_DEPTH, 1)
        runs = {
            "find_functions_by_name": lambda: self.functions_by_name(who, limit),
            "find_callers": lambda: self.callers(who, depth, limit),
            "find_callees": lambda: self.callees(who, limit),
            "find_trait_implementations": lambda: self.trait_implementations(who, limit),
            "find_by_fqn": lambda: self.by_fqn(who, params.get("label", "Function")),
            "find_neighbors": lambda: self.neighbours(who, depth, limit),
            "find_nodes_by_label": lambda: self.with_label(who, limit),
            "find_module_contents": lambda: self.module_contents(who, limit),
            "count_by_label": lambda: self.count_label(who),
            "count_label": lambda: self.count_label(who),
            "find_crate_overview": lambda: self.crate_overview(who),
            "find_crate_dependencies": lambda: self.crate_dependencies(who),
            "find_crate_dependents": lambda: self.crate_dependencies(who, True),
            "get_trait_impls_api": lambda: self.trait_impls_api(who, limit),
            "find_usages_of_type": lambda: self.usages_of_type(who, limit),
            "get_module_tree": lambda: self.module_tree(who),
            "get_callers": lambda: self.callers_api(who, depth, limit),
            "get_callers_for_impl": lambda: self.callers_for_prefix(who, depth, limit),
            "get_callees_for_impl": lambda: self.callees_for_prefix(who, limit),
            "get_callees": lambda: self.callees_api(who),
            "consistency_fqns": lambda: self.consistency_fqns(),
            "consistency_fqns_filtered": lambda: self.consistency_fqns(who),
            "consistency_count": lambda: self.consistency_count(who),
            "health_node_edge_counts": lambda: self.health(),
            "consistency_count_system": lambda: self.consistency_count(who, merged=False),
            "count_total_nodes": lambda: self.totals()[0],
            "count_total_relationships": lambda: self.totals()[1],
            "count_relationship": lambda: self.count_relationship(params["rel"]),
            "has_relationship": lambda: self.has_relationship(params["rel"]),
            "ping": lambda: self.nodes.sparkSession.range(1).select(F.lit(1).alias("ok")),
        }
        if name not in runs:
            raise ValueError(f"unknown query: {name}")
        return runs[name]()


def first(df: DataFrame, limit=None, *order: str) -> DataFrame:
    """The first rows in a fixed order (a bounded top-k); all rows without a limit."""
    return df if limit is None else df.orderBy(*(order or ("fqn",))).limit(int(limit))


# Relationships whose missing target becomes a node of its own, and the label it gets.
OPEN_RELS = {"HAS_FIELD": "Type", "HAS_VARIANT": "Enum", "USES_TYPE": "Type", "FOR": "Type", "EXTENDS": "Trait"}


def settled_edges(edges: DataFrame, order: Column) -> DataFrame:
    """One edge for each (src, rel, dst) with `sites`, how many there were; of each further property the last that isn't null, by `order`. An aggregate, so a pair's sites are combined before the shuffle."""
    rest = [c for c in edges.columns if c not in ("src", "rel", "dst")]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    return edges.groupBy("src", "rel", "dst").agg(*last, F.count("*").alias("sites"))


def dangling(nodes: DataFrame, edges: DataFrame, open_rels=tuple(OPEN_RELS)) -> DataFrame:
    """rel, reason, cnt of the edges that with_placeholders() drops: their source is missing, or their target and that makes no node."""
    known = nodes.select("fqn").distinct()
    e = edges.join(known.select(F.col("fqn").alias("src"), F.lit(True).alias("_s")), "src", "left").join(known.select(F.col("fqn").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    reason = F.when(F.col("_s").isNull(), "source").when(F.col("_d").isNull() & ~F.col("rel").isin(*open_rels), "target")
    return e.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("rel", "reason").agg(F.count("*").alias("cnt"))


def with_placeholders(nodes: DataFrame, edges: DataFrame, open_rels=tuple(OPEN_RELS), order: Column | None = None) -> Graph:
    """The graph as it is stored.

    Edges are settled_edges(), the last properties by `order` (without it, by the
    further columns themselves).  One whose source is missing is dropped; a
    missing target becomes a node with external = true if its relationship is of
    open_rels, else its edge is dropped too.  `resolved` tells whether an edge's
    target is an item and not a guess: false if its node is external.
    """
    rest = [c for c in edges.columns if c not in ("src", "rel", "dst")]
    e = settled_edges(edges, F.struct(*(rest or ["dst"])) if order is None else order)
    nodes = nodes if "external" in nodes.columns else nodes.withColumn("external", F.lit(False))
    known = nodes.groupBy("fqn").agg(F.bool_and(F.coalesce("external", F.lit(False))).alias("_external"))
    e = e.join(known.select(F.col("fqn").alias("src")), "src", "left_semi").join(known.withColumnRenamed("fqn", "dst"), "dst", "left")
    e = e.where(F.col("_external").isNotNull() | F.col("rel").isin(*open_rels)).withColumn("resolved", ~F.coalesce("_external", F.lit(True)))
    label = F.coalesce(*[F.when(F.col("rel") == r, F.lit(OPEN_RELS.get(r, "Type"))) for r in open_rels])
    new = e.where("_external IS NULL").groupBy(F.col("dst").alias("fqn")).agg(F.min(label).alias("label")).withColumn("name", F.col("fqn")).withColumn("external", F.lit(True))
    return Graph(nodes.unionByName(new, allowMissingColumns=True), e.drop("_external"))
