"""A graph whose edges are stored twice, bucketed by either end, so that hops don't shuffle them.

A hop joins seeds with the copy that is bucketed by the end it starts from: the seeds are
dealt out like its buckets (or broadcast, if Spark finds them small), the edges are read
where they lie.  The copies are external tables of the session's catalog below a folder
that all executors share.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .lineage import cut


@dataclass
class Adjacent(Graph):
    """A Graph with by_src and by_dst, the bucketed copies of its edges."""

    by_src: DataFrame = None
    by_dst: DataFrame = None
    names: tuple[str, ...] = ()

    def hop(self, seeds: DataFrame, kinds: tuple[str, ...], back: bool = False) -> DataFrame:
        a, b, edges = ("dst", "src", self.by_dst) if back else ("src", "dst", self.by_src)
        near = edges.where(F.col("rel").isin(*kinds))
        return near.join(seeds.select(F.col("fqn").alias(a)), a, "left_semi").select(F.col(b).alias("fqn")).distinct()

    def drop(self) -> None:
        """Forgets the tables; their files go with the folder."""
        for n in self.names:
            self.nodes.sparkSession.sql(f"DROP TABLE IF EXISTS {n}")


def stored(g: Graph, path: str, buckets: int = 64) -> Adjacent:
    """g with its edges bucketed by src and by dst below a path."""
    spark, sides, names = g.nodes.sparkSession, [], []
    for end in ("src", "dst"):
        name = f"quarry_edges_{end}_{uuid.uuid4().hex[:8]}"
        g.edges.repartition(buckets, end).write.bucketBy(buckets, end).sortBy(end).option("path", f"{path.rstrip('/')}/{end}").mode("overwrite").saveAsTable(name)
        sides.append(spark.table(name))
        names.append(name)
    return Adjacent(cut(g.nodes), g.edges, *sides, tuple(names))
