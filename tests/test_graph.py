"""Traversals on small graphs with cycles, loops and parallel edges."""

import pytest

from quarry.plans.graph import Graph, clamp, with_placeholders


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(f"c::{x}", x, "Function", "f.rs", 1) for x in "abcde"], "fqn string, name string, label string, file_path string, start_line long")
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e")]
    return Graph(nodes, spark.createDataFrame([(f"c::{x}", f"c::{y}", "CALLS") for x, y in edges], "src string, dst string, rel string"))


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_callers_by_depth(g):
    assert names(g.callers("a", 1)) == ["c", "d"]
    assert names(g.callers("a", 2)) == ["b", "c", "d"]
    assert names(g.callers("a", 3)) == ["a", "b", "c", "d"]  # the cycle leads back
    assert names(g.callers("e", 1)) == ["e"]
    assert names(g.callers_api("c::a", 5)) == ["b", "c", "d"]
    with pytest.raises(ValueError):
        g.callers_api("c::a", 11)


def test_neighbours_use_no_edge_twice(g):
    assert names(g.neighbours("d", 1)) == ["a"]
    assert names(g.neighbours("d", 2)) == ["a", "b", "c"]
    assert "d" not in names(g.neighbours("d", 4))


def test_parameters():
    assert clamp("7", 1, 5, 1) == 5 and clamp(None, 1, 100, 25) == 25 and clamp("x", 1, 5, 1) == 1


def test_placeholders(g, spark):
    more = spark.createDataFrame([("c::a", "c::zz", "USES_TYPE"), ("c::a", "c::zz", "CALLS"), ("c::none", "c::a", "USES_TYPE")], "src string, dst string, rel string")
    h = with_placeholders(g.nodes, g.edges.unionByName(more))
    assert [r["fqn"] for r in h.nodes.where("external").collect()] == ["c::zz"]
    assert h.edges.count() == 6


def test_neighbours_against_all_paths(spark):
    """Every trail of up to 4 edges of random small graphs with parallel edges and loops."""
    import random

    rng = random.Random(4)
    for _ in range(3):
        names = "abcdef"
        edges = {(rng.choice(names), rng.choice(names), rng.choice(["CALLS", "USES_TYPE", "FOR"])) for _ in range(8)}
        g = Graph(spark.createDataFrame([(x, x, "Function", "f", 1) for x in names], "fqn string, name string, label string, file_path string, start_line long"), spark.createDataFrame(sorted(edges), "src string, dst string, rel string"))
        for depth in (1, 2, 3, 4):
            want = set()

            def walk(at, used, left):
                for e in edges - used:
                    for u, v in {(e[0], e[1]), (e[1], e[0])}:
                        if u == at:
                            want.add((e[2], v))
                            if left > 1:
                                walk(v, used | {e}, left - 1)

            walk("a", frozenset(), depth)
            assert {(r.relationship, r.fqn) for r in g.neighbours("a", depth).collect()} == want, (edges, depth)


def test_tree_and_pattern(spark):
    nodes = [("c", "c", "Crate"), ("c::m", "m", "Module"), ("c::m::n", "n", "Module"), ("c::m::n::f", "f", "Function"), ("c::x::g", "g", "Function")]
    edges = [("c", "c::m", "CONTAINS"), ("c::m", "c::m::n", "CONTAINS"), ("c::m::n", "c::m::n::f", "CONTAINS"), ("c::x", "c::x::g", "CONTAINS"), ("c::x::g", "c::m::n::f", "CALLS")]
    g = Graph(spark.createDataFrame([(*x, None, 1) for x in nodes], "fqn string, name string, label string, file_path string, start_line long"), spark.createDataFrame(edges, "src string, dst string, rel string"))
    got = {r.fqn: (r.parent, r.depth, len(r.path)) for r in g.tree("c").collect()}
    assert got == {"c": (None, 0, 1), "c::m": ("c", 1, 2), "c::m::n": ("c::m", 2, 3), "c::m::n::f": ("c::m::n", 3, 4), "c::x::g": ("c", 1, 2)}
    rows = g.pattern({"as": "a", "label": "Function"}, ({"rel": "CALLS"}, {"as": "b", "fqn": "c::m*"}), ({"rel": "CONTAINS", "back": True}, {"as": "m"}), returns=("a.name", "b.name", "m.fqn"))
    assert [tuple(r) for r in rows.collect()] == [("g", "f", "c::m::n")]
    with pytest.raises(ValueError):
        g.count_relationship("FOR")
    assert g.count_relationship("CALLS").first()[0] == 1 and g.query("count_label", label="Module").first()[0] == 2 and g.query("consistency_count_system").first()[0] == 2


def test_detail_of_an_impl(spark):
    nodes = [("c::m::Foo::a", "a", "Function"), ("c::m::Foo::b", "b", "Function"), ("c::o", "o", "Function"), ("c::m::Show_Foo", "Show_Foo", "Impl")]
    edges = [("c::o", "c::m::Foo::a", "CALLS"), ("c::m::Foo::a", "c::m::Foo::b", "CALLS"), ("c::m::Foo::b", "c::o", "CALLS")]
    g = Graph(spark.createDataFrame([(*x, "f", 1) for x in nodes], "fqn string, name string, label string, file_path string, start_line long"), spark.createDataFrame(edges, "src string, dst string, rel string"))
    items = spark.createDataFrame([("c::m::Show_Foo", "Show_Foo", "impl", "impl Show for Foo", 1), ("c::o", "o", "function", "fn o()", 1)], "fqn string, name string, item_type string, signature string, source_file_id long")
    files = spark.createDataFrame([(1, "f.rs")], "source_file_id long, path string")
    one, two = (g.item_detail(items, files, x).first() for x in ("c::m::Show_Foo", "c::o"))
    assert (one.callers, one.callees, one.path) == (["c::o"], ["c::o"], "f.rs") and (two.callers, two.callees) == (["c::m::Foo::b"], ["c::m::Foo::a"])


def test_nodes_are_not_sent_through_the_driver(spark):
    """However small they look, nodes that grow are shuffled."""
    nodes = spark.createDataFrame([("a::f", "f", "Function", "x.rs", 1), ("a", "a", "Crate", None, 0)], "fqn string, name string, label string, file_path string, start_line int")
    edges = spark.createDataFrame([("a", "a::f", "CONTAINS")], "src string, dst string, rel string")
    g = Graph(nodes, edges)
    for df in (g.of(edges.select(edges.dst.alias("fqn")), "fqn"), g.crate_overview("a")):
        assert "strategy=merge" in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 1
