"""Graph patterns as joins: fixed and variable-length steps, optional parts, and one tenant's view.

A pattern is built from nodes and steps and read as rows, one for each way it fits:

    match(g).all(N("a", label="Function"), E("CALLS", most=3), N("b", name="x")).rows("a.fqn", "b.fqn")

Within one `all` or `maybe` no edge is used twice, as in graph query languages.  A
variable that stands in several places is one node.  Everything is a read: nodes are
filtered scans, a step is an equi-join with the edges, a variable-length step one for
each length.  With a tenant, its predicate is part of every node's scan, those that a
step passes through too, so nothing outside can be reached or counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import MAX_DEPTH, Graph, known_label
from .lineage import cut


@dataclass(frozen=True)
class N:
    """A node: its variable, a label or several, and properties it must have; a text that ends in * is a prefix, a list is a choice."""

    var: str
    label: str | tuple[str, ...] = ()
    where: dict = field(default_factory=dict)

    def __init__(self, var: str, label: str | tuple[str, ...] = (), **where):
        labels = (label,) if isinstance(label, str) else tuple(label)
        for x in labels:
            known_label(x)
        object.__setattr__(self, "var", var)
        object.__setattr__(self, "label", labels)
        object.__setattr__(self, "where", where)


@dataclass(frozen=True)
class E:
    """A step over edges of some relationships (none: all): forwards, back, or either way, `least` to `most` edges.

    `ends`: only which nodes are joined counts, not by how many ways; then lengths
    must begin at 1, and nodes are searched breadth-first instead of by trails.
    """

    rel: str | tuple[str, ...] = ()
    var: str | None = None
    back: bool = False
    either: bool = False
    least: int = 1
    most: int = 1
    ends: bool = False

    def __post_init__(self):
        if not 1 <= self.least <= self.most <= MAX_DEPTH:
            raise ValueError(f"steps take 1 to {MAX_DEPTH} edges")
        if self.ends and self.least != 1:
            raise ValueError("a step by ends begins at one edge")
        if self.var and self.most > 1:
            raise ValueError("only a step of one edge has a variable")


def _holds(c: Column, v) -> Column:
    if isinstance(v, str) and v.endswith("*"):
        return c.startswith(v[:-1])
    return c.isin(*v) if isinstance(v, (list, tuple, set)) else c.isNull() if v is None else c == v


def _checked(rows: DataFrame, n: N) -> DataFrame:
    """rows whose node, bound before, is also what it is asked to be here."""
    if n.label:
        rows = rows.where(F.col(f"`{n.var}.label`").isin(*n.label))
    for k, v in n.where.items():
        rows = rows.where(_holds(F.col(f"`{n.var}.{k}`"), v))
    return rows


class match:  # noqa: N801
    """A pattern on a graph, or on one tenant's part of it; each call returns a further pattern."""

    def __init__(self, graph: Graph, tenant: str | None = None, column: str = "workspace_id"):
        self.nodes, edges, self.tenant = graph.nodes, graph.edges, None
        if tenant is not None:
            self.tenant = F.col(column) == tenant
            self.nodes = self.nodes.where(self.tenant)
        # One edge for each (src, rel, dst); its number tells it from others in a pattern.
        self.edges = edges.select("src", "dst", "rel").distinct().withColumn("_e", F.xxhash64("src", "dst", "rel"))
        self.found: DataFrame | None = None
        self.bound: tuple[str, ...] = ()

    def _next(self, found: DataFrame, bound: tuple[str, ...]) -> match:
        out = object.__new__(match)
        out.__dict__ |= self.__dict__ | {"found": found, "bound": bound}
        return out

    def _scan(self, n: N) -> DataFrame:
        rows = self.nodes
        if n.label:
            rows = rows.where(F.col("label").isin(*n.label))
        for k, v in n.where.items():
            rows = rows.where(_holds(F.col(k), v))
        return rows.select(*[F.col(c).alias(f"{n.var}.{c}") for c in self.nodes.columns])

    def _steps(self, e: E) -> DataFrame:
        """_a, _b, _e, _r: the edges of a step from either end it may begin at."""
        kinds = (e.rel,) if isinstance(e.rel, str) else e.rel
        rows = self.edges.where(F.col("rel").isin(*kinds)) if kinds else self.edges
        on = rows.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), "_e", F.col("rel").alias("_r"))
        against = rows.select(F.col("dst").alias("_a"), F.col("src").alias("_b"), "_e", F.col("rel").alias("_r"))
        return on.union(against.where("_a <> _b")) if e.either else against if e.back else on

    def _walk(self, rows: DataFrame, start: str, e: E) -> DataFrame:
        """rows with _b, the node that the step from `start` ends at, and the edges it took in _used."""
        steps = self._steps(e)
        inside = self.nodes.select(F.col("fqn").alias("_b"))
        if self.tenant is not None:
            steps = steps.join(inside, "_b", "left_semi")
        if e.ends:
            return self._ends(rows, start, steps, e.most)
        out, at = None, rows.withColumn("_a", F.col(f"`{start}.fqn`"))
        for k in range(1, e.most + 1):
            at = at.join(steps, "_a").where(~F.array_contains("_used", F.col("_e"))).withColumn("_used", F.array_append("_used", F.col("_e")))
            if e.var:
                at = at.withColumn(f"{e.var}.rel", F.col("_r"))
            at = at.drop("_a", "_e", "_r")
            if e.most > 1:
                at = cut(at)
            if k >= e.least:
                out = at if out is None else out.unionByName(at)
            at = at.withColumnRenamed("_b", "_a")
        return out

    def _ends(self, rows: DataFrame, start: str, steps: DataFrame, most: int) -> DataFrame:
        """The nodes within `most` edges of each start, once: a breadth-first search of all starts at a time."""
        front = rows.select(F.col(f"`{start}.fqn`").alias("_s")).distinct().withColumn("_a", F.col("_s"))
        seen = None
        for _ in range(most):
            near = front.join(steps.select("_a", "_b").distinct(), "_a").select("_s", "_b").distinct()
            near = cut(near if seen is None else near.join(seen, ["_s", "_b"], "left_anti"))
            seen = near if seen is None else seen.union(near)
            front = near.withColumnRenamed("_b", "_a")
        return rows.join(seen, F.col(f"`{start}.fqn`") == F.col("_s")).drop("_s")

    def _path(self, rows: DataFrame | None, bound: tuple[str, ...], path: tuple) -> tuple[DataFrame, tuple[str, ...]]:
        nodes, steps = path[::2], path[1::2]
        if not nodes or any(not isinstance(n, N) for n in nodes) or any(not isinstance(s, E) for s in steps) or len(path) % 2 == 0:
            raise ValueError("a path is a node, then steps and nodes in turn")
        if rows is not None and nodes[0].var not in bound:
            if nodes[-1].var not in bound:
                raise ValueError("a further path must begin or end at a node that is known")
            steps = tuple(s if s.either else E(s.rel, s.var, not s.back, False, s.least, s.most, s.ends) for s in reversed(steps))
            nodes = tuple(reversed(nodes))
        if rows is None:
            rows, bound = self._scan(nodes[0]).withColumn("_used", F.array().cast("array<bigint>")), (nodes[0].var,)
        else:
            rows = _checked(rows, nodes[0])
        for before, e, n in zip(nodes, steps, nodes[1:]):
            rows = self._walk(rows, before.var, e)
            if n.var in bound:
                rows = _checked(rows.where(F.col("_b") == F.col(f"`{n.var}.fqn`")), n)
            else:
                rows = rows.join(self._scan(n), F.col("_b") == F.col(f"`{n.var}.fqn`"))
                bound = (*bound, n.var)
            rows = rows.drop("_b")
        return rows, bound

    def all(self, *path) -> match:
        """Rows where the path fits too; its edges differ from each other, not from those of earlier paths."""
        rows = None if self.found is None else self.found.withColumn("_used", F.array().cast("array<bigint>"))
        return self._next(*self._path(rows, self.bound, path))

    def every(self, *paths: tuple) -> match:
        """Rows where all of the paths fit, no edge used twice among them."""
        rows, bound = (None if self.found is None else self.found.withColumn("_used", F.array().cast("array<bigint>"))), self.bound
        for p in paths:
            rows, bound = self._path(rows, bound, p)
        return self._next(rows, bound)

    def maybe(self, *path) -> match:
        """As all(), but a row where the path doesn't fit stays, with nulls for what it would have bound."""
        if self.found is None:
            raise ValueError("an optional path needs a pattern before it")
        base = cut(self.found.drop("_used").withColumn("_row", F.monotonically_increasing_id()))
        rows, bound = self._path(base.withColumn("_used", F.array().cast("array<bigint>")), self.bound, path)
        rest = base.join(rows.select("_row").distinct(), "_row", "left_anti")
        return self._next(rows.unionByName(rest, allowMissingColumns=True).drop("_row"), bound)

    def where(self, holds) -> match:
        """Rows for which holds(p) is true; p("a.name") is a property of a node, or `rel` of a step."""
        return self._next(self.found.where(holds(_property)), self.bound)

    def rows(self, *columns: str, distinct: bool = True, limit: int | None = None, **named) -> DataFrame:
        """`variable.property` columns (named variable_property) and named expressions of p; distinct and, with a limit, in the order of all columns."""
        cols = [_property(c).alias(c.replace(".", "_")) for c in columns] + [f(_property).alias(n) for n, f in named.items()]
        out = self.found.select(*cols)
        out = out.distinct() if distinct else out
        return out if limit is None else out.orderBy(*out.columns).limit(int(limit))

    def counts(self, *by: str, name: str = "cnt", of: str | None = None) -> DataFrame:
        """How many rows there are for each value of the columns `by`; of distinct values of `of`, if that is given, which null isn't."""
        n = F.count("*") if of is None else F.count_distinct(_property(of))
        return self.found.groupBy(*[_property(c).alias(c.replace(".", "_")) for c in by]).agg(n.alias(name))


def _property(name: str) -> Column:
    return F.col(f"`{name}`")
