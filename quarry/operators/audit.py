"""Integrity of a multi-tenant graph and of stores that should agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "Workspace_"
# Rows that a report of details shows, of nodes and of relationships.
MOST_NODES, MOST_EDGES = 500, 200


def tenants(labels: str = "labels"):
    return F.filter(labels, lambda x: x.startswith(PREFIX))


def multi_label(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.size(tenants()) > 1)


def orphans(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.size(tenants()) == 0)


def per_tenant(nodes: DataFrame) -> DataFrame:
    """For each tenant label its nodes, and those that bear another one as well."""
    return nodes.select(F.explode(tenants()).alias("workspace"), (F.size(tenants()) > 1).alias("multi")).groupBy("workspace").agg(F.count("*").alias("nodes"), F.sum(F.col("multi").cast("int")).alias("leaking"))


def capped(rows: DataFrame, *order: str, most: int = MOST_NODES) -> DataFrame:
    """The rows that a report shows, in a fixed order; counts are taken before."""
    return rows.orderBy(*order).limit(most)


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one = nodes.select("id", tenants().alias("ws"))
    a = one.select(F.col("id").alias("src"), F.col("ws").alias("wa"))
    b = one.select(F.col("id").alias("dst"), F.col("ws").alias("wb"))
    return edges.join(a, "src").join(b, "dst")


def cross_tenant(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between nodes that each have one tenant, and not the same."""
    out = _ends(nodes, edges).where((F.size("wa") == 1) & (F.size("wb") == 1)).withColumn("wa", F.col("wa")[0]).withColumn("wb", F.col("wb")[0])
    return out.where("wa <> wb").select("src", "dst", F.col("wa").alias("src_workspace"), F.col("wb").alias("dst_workspace"))


def label_mismatch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each node with neighbours of other tenants, the commonest of these tenants (the smallest of equals)."""
    e = _ends(nodes, edges).where((F.size("wa") == 1) & (F.size("wb") == 1)).select("src", "dst", F.col("wa")[0].alias("wa"), F.col("wb")[0].alias("wb")).where("wa <> wb")
    both = e.select(F.col("src").alias("id"), F.col("wb").alias("other")).union(e.select(F.col("dst").alias("id"), F.col("wa").alias("other")))
    n = both.groupBy("id", "other").agg(F.count("*").alias("cnt"))
    return n.groupBy("id").agg(F.min_by(F.struct("other", "cnt"), F.struct(-F.col("cnt"), F.col("other"))).alias("m")).select("id", F.col("m.other").alias("expected"), F.col("m.cnt").alias("cnt"))


def shared_names(nodes: DataFrame, key: str = "fqn", workspace: str = "workspace_id") -> DataFrame:
    """Names that stand in more than one workspace."""
    return nodes.groupBy(key).agg(F.count_distinct(workspace).alias("workspaces")).where("workspaces > 1")


def pairwise(present: DataFrame, stores: tuple[str, ...]) -> DataFrame:
    """From presence(): for each ordered pair of stores, how many keys the first has and the second lacks."""
    pairs = [(a, b) for a in stores for b in stores if a != b]
    sums = present.agg(*[F.coalesce(F.sum((F.col(f"in_{a}") & ~F.col(f"in_{b}")).cast("long")), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("has"), F.lit(b).alias("lacks"), F.col(f"{a}_{b}").alias("cnt")) for a, b in pairs])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def health(present: DataFrame, group, stores: tuple[str, ...]) -> DataFrame:
    """Counts of each store by group; consistent compares counts, sets_equal the keys themselves."""
    counts = [F.sum(F.col(f"in_{s}").cast("long")).alias(s) for s in stores]
    out = present.groupBy(group).agg(*counts, F.bool_and("synced").alias("sets_equal"))
    same = F.lit(True)
    for s in stores[1:]:
        same = same & (F.col(s) == F.col(stores[0]))
    return out.withColumn("consistent", same)


def retained(df: DataFrame, ts: str, now, days: int) -> DataFrame:
    return df.where(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def feature_status(reachable, count):
    return F.when(~reachable, "broken").when(count == 0, "partial").otherwise("working")
