"""Graph patterns against a search by hand over small random graphs."""

import random
from collections import Counter

import pytest

from quarry.plans.graph import Graph
from quarry.plans.match import E, N, match


@pytest.fixture(scope="module")
def g(spark):
    random.seed(5)
    nodes = [(f"n{i}", f"x{i % 4}", "Function" if i % 3 else "Struct", f"w{i % 2}") for i in range(12)]
    edges = {(f"n{random.randrange(12)}", f"n{random.randrange(12)}", random.choice(["CALLS", "USES_TYPE"])) for _ in range(40)} | {("n1", "n1", "CALLS")}
    rows = sorted(edges) + [sorted(edges)[0]]  # an edge that is stored twice counts once
    return Graph(spark.createDataFrame(nodes, "fqn string, name string, label string, workspace_id string"), spark.createDataFrame(rows, "src string, dst string, rel string")), nodes, sorted(edges)


def trails(edges, start, least, most, back=False, either=False):
    out = []

    def go(at, used):
        if least <= len(used) <= most:
            out.append((at, used))
        if len(used) < most:
            for e in edges:
                if e in used:
                    continue
                if (e[0] == at and not back) or (either and e[0] == at):
                    go(e[1], (*used, e))
                if (e[1] == at and (back or either)) and not (either and e[0] == e[1]):
                    go(e[0], (*used, e))

    go(start, ())
    return out


@pytest.mark.parametrize("least,most,back,either", [(1, 1, False, False), (1, 3, False, False), (2, 3, True, False), (1, 2, False, True)])
def test_trails(g, least, most, back, either):
    graph, nodes, edges = g
    calls = [e for e in edges if e[2] == "CALLS"]
    got = {(r.a_fqn, r.b_fqn): r.cnt for r in match(graph).all(N("a"), E("CALLS", back=back, either=either, least=least, most=most), N("b")).counts("a.fqn", "b.fqn").collect()}
    assert got == Counter((n[0], end) for n in nodes for end, _ in trails(calls, n[0], least, most, back, either))


def test_ends_are_those_of_trails(g):
    graph, nodes, edges = g
    got = {(r.a_fqn, r.b_fqn) for r in match(graph).all(N("a"), E(most=3, ends=True), N("b")).rows("a.fqn", "b.fqn").collect()}
    assert got == {(n[0], end) for n in nodes for end, _ in trails(edges, n[0], 1, 3)}


def test_paths_meet_and_edges_differ(g):
    graph, nodes, edges = g
    got = match(graph).every((N("a"), E(), N("b")), (N("b"), E(), N("c", "Struct")), (N("a"), E(), N("c"))).rows("a.fqn", "b.fqn", "c.fqn", distinct=False).collect()
    kind = {n[0]: n[2] for n in nodes}
    want = [(x[0], x[1], y[1]) for x in edges for y in edges for z in edges if x[1] == y[0] and z[0] == x[0] and z[1] == y[1] and kind[y[1]] == "Struct" and len({x, y, z}) == 3]
    assert Counter(map(tuple, got)) == Counter(want)


def test_optional_paths_leave_rows(g):
    graph, nodes, edges = g
    got = match(graph).all(N("a", name="x1")).maybe(N("a"), E("USES_TYPE", var="r"), N("b", "Function")).rows("a.fqn", "b.fqn", "r.rel").collect()
    kind = {n[0]: n[2] for n in nodes}
    want = set()
    for n in nodes:
        if n[1] == "x1":
            hit = {(n[0], d, k) for s, d, k in edges if s == n[0] and k == "USES_TYPE" and kind[d] == "Function"}
            want |= hit or {(n[0], None, None)}
    assert {tuple(r) for r in got} == want


def test_a_tenant_sees_no_path_through_others(g):
    graph, nodes, edges = g
    own = {n[0] for n in nodes if n[3] == "w1"}
    inside = [e for e in edges if e[0] in own and e[1] in own]
    for ends in (False, True):
        got = {(r.a_fqn, r.b_fqn) for r in match(graph, tenant="w1").all(N("a"), E(most=3, ends=ends), N("b")).rows("a.fqn", "b.fqn").collect()}
        assert got == {(n, end) for n in own for end, _ in trails(inside, n, 1, 3)}
    assert match(graph, tenant="other").all(N("a"), E(), N("b")).rows("a.fqn").count() == 0


def test_what_a_pattern_refuses(g):
    graph = g[0]
    for bad in (lambda: N("a", "Nothing"), lambda: E(most=9), lambda: E(least=2, most=3, ends=True), lambda: match(graph).all(N("a"), E()), lambda: match(graph).all(N("a")).all(N("b"), E(), N("c")), lambda: match(graph).maybe(N("a"))):
        with pytest.raises(ValueError):
            bad()
    got = match(graph).all(N("a", fqn="n1*")).where(lambda p: p("a.label") != "Struct").rows("a.fqn", limit=2).collect()
    assert [r.a_fqn for r in got] == ["n1", "n10"]
