"""Reports on what is there: workspace statistics, gap analysis, recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import tenants

# Features, the count that each needs first, and the further counts that make it partial if they are 0.
FEATURES = (
    ("semantic_search", ("points",), ("model",)), ("get_function", ("functions",), ("label_Function",)), ("get_callers", ("rel_CALLS",), ("label_Function",)),
    ("get_trait_impls", ("label_Trait",), ("rel_IMPLEMENTS",)), ("find_usages", ("label_Type",), ("rel_USES_TYPE",)),
    ("module_tree", ("label_Module",), ("label_Crate", "rel_CONTAINS")), ("graph_query", ("ping",), ("nodes",)),
)
SEVERITY = ("critical", "high", "medium", "low")


def counts(items: DataFrame, nodes: DataFrame, edges: DataFrame, points: DataFrame, model: bool = True) -> DataFrame:
    """One row with every count that the features ask for; an aggregate of each store, no join of them."""
    labels = sorted({c[6:] for _, a, b in FEATURES for c in (*a, *b) if c.startswith("label_")})
    rels = sorted({c[4:] for _, a, b in FEATURES for c in (*a, *b) if c.startswith("rel_")})
    one = items.agg(F.count("*").alias("items"), F.count_if(F.col("item_type").isin("function", "method")).alias("functions"))
    two = nodes.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("label") == x).alias(f"label_{x}") for x in labels])
    three = edges.agg(F.count("*").alias("edges"), *[F.count_if(F.col("rel") == x).alias(f"rel_{x}") for x in rels])
    four = points.agg(F.count("*").alias("points"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four).withColumn("model", F.lit(int(model)).cast("long")).withColumn("ping", F.lit(1).cast("long"))


def features(found: DataFrame) -> DataFrame:
    """feature and status of counts(): broken if its first count is null (it could not be asked for), partial if any is 0, else working."""
    def status(first, more):
        return F.when(F.col(first[0]).isNull(), "broken").when(reduce(lambda x, y: x | y, [F.coalesce(F.col(c), F.lit(1)) == 0 for c in (*first, *more)]), "partial").otherwise("working")

    rows = F.array(*[F.struct(F.lit(n).alias("feature"), status(a, b).alias("status")) for n, a, b in FEATURES])
    return found.select(F.explode(rows).alias("r")).select("r.*")


def quality(found: DataFrame) -> DataFrame:
    return found.select("nodes", "edges", "points", "items", (F.col("points") > 0).alias("has_embeddings"), (F.col("rel_CALLS") > 0).alias("has_call_graph"), (F.col("rel_IMPLEMENTS") > 0).alias("has_trait_impls"))


def recommendations(found: DataFrame) -> DataFrame:
    """priority and action, the most urgent first, for what counts() shows to be missing."""
    c = F.col
    partial_types = F.coalesce(c("label_Type"), F.lit(0)).isin(0) | (c("rel_USES_TYPE") == 0)
    rules = [
        (c("points").isNull(), "high", "restore the vector store and the embedding model"), (c("points") == 0, "high", "embed the functions"),
        (c("rel_CALLS") == 0, "high", "extract the call graph"), ((c("rel_IMPLEMENTS") == 0) & c("label_Trait").isNotNull(), "medium", "extract trait implementations"),
        (partial_types, "medium", "extract type usages"), ((c("nodes") == 0) & (c("items") > 0), "high", "build the graph from the tables"), (c("items") == 0, "critical", "ingest the code base"),
        ((c("nodes") > 0) & (c("edges") == 0), "medium", "extract relationships"), (c("items") > c("points") * 2, "low", "embed items again"),
        (F.lit(True), "low", "expand derive macros"), (c("points") > 0, "low", "embed structs, enums and traits too"),
    ]
    rows = F.array(*[F.struct(F.lit(SEVERITY.index(p)).alias("urgency"), F.lit(i).alias("at"), F.lit(p).alias("priority"), F.lit(a).alias("action"), F.coalesce(x, F.lit(False)).alias("holds")) for i, (x, p, a) in enumerate(rules)])
    return found.select(F.explode(rows).alias("r")).where("r.holds").orderBy("r.urgency", "r.at").select("r.priority", "r.action")


def workspace_stats(items: DataFrame, nodes: DataFrame, edges: DataFrame, points: DataFrame, workspace: str, started: Column | None = None, done: Column | None = None) -> DataFrame:
    """One row: what each store holds of a workspace, how far graph and vectors are from the tables (signed), and how well it is apart.

    nodes(id, fqn, labels): a node is of a workspace if it bears its label;
    multi_label counts its nodes that bear another one too, cross_edges the edges
    from its nodes to nodes that don't, shared_fqns its names that stand elsewhere.
    """
    own = F.array_contains("labels", workspace)
    here = nodes.where(own)
    ids = here.select("id")
    out = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_in")), "dst", "left")
    other = nodes.where(~own & (F.size(tenants()) > 0)).select("fqn").distinct()
    rows = items.agg(F.count("*").alias("items_count")).crossJoin(here.agg(F.count("*").alias("nodes_count"), F.count_if(F.size(tenants()) > 1).alias("multi_label")))
    rows = rows.crossJoin(out.agg(F.count_if(F.col("_in")).alias("edges_count"), F.count_if(F.col("_in").isNull()).alias("cross_edges")))
    rows = rows.crossJoin(points.agg(F.count("*").alias("vectors_count"))).crossJoin(here.select("fqn").distinct().join(other, "fqn", "left_semi").agg(F.count("*").alias("shared_fqns")))
    rows = rows.withColumn("graph_delta", F.col("items_count") - F.col("nodes_count")).withColumn("vector_delta", F.col("items_count") - F.col("vectors_count"))
    rows = rows.withColumn("status", F.when((F.col("graph_delta") == 0) & (F.col("vector_delta") == 0), "consistent").otherwise("inconsistent"))
    seconds = F.lit(None).cast("double") if started is None or done is None else (F.unix_micros(done.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6
    return rows.withColumn("index_seconds", seconds)


def advice(pg: Column, graph: Column, vector: Column, lacks: dict[str, Column] | None = None) -> Column:
    """What to do about three counts (tables, graph, vectors) and, in a full report, the pairwise counts pg_graph, pg_vector, graph_pg, vector_pg."""
    parts = [F.when((graph == 0) & (pg > 0), "Graph stage has not been run"), F.when((vector == 0) & (pg > 0), "Embed stage has not been run")]
    if lacks is None:
        parts += [F.when(graph < pg, "The graph has fewer items than the tables - Graph stage may be incomplete"), F.when(vector < pg, "The vectors have fewer items than the tables - Embed stage may be incomplete")]
    else:
        texts = {"pg_graph": "%s items missing from the graph - re-run Graph stage", "pg_vector": "%s items missing from the vectors - re-run Embed stage", "graph_pg": "%s orphaned nodes in the graph - data may need cleanup", "vector_pg": "%s orphaned points in the vectors - data may need cleanup"}
        parts += [F.when(lacks[k] > 0, F.format_string(t, lacks[k].cast("string"))) for k, t in texts.items()]
    found = F.array_compact(F.array(*parts))
    said = F.when(F.size(found) == 0, "All stores are consistent. No action required.").otherwise(F.concat(F.array_join(found, ". "), F.lit(".")))
    return F.when((pg == 0) & (graph == 0) & (vector == 0), "No data found. Run ingestion first.").otherwise(said)
