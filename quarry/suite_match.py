"""Graph patterns on the driver's tables, and recursive SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans.graph import Graph, crate_of
from .plans.match import E, N, match
from .suite import BRAND, NAME, gq

CALLS = "(SELECT src, dst FROM edges WHERE rel = 'CALLS')"

gq("match_callers", f"SELECT a.fqn AS a_fqn, a.start_line AS a_start_line FROM edges e JOIN nodes a ON a.fqn = e.src JOIN nodes b ON b.fqn = e.dst WHERE rel = 'CALLS' AND b.name = '{NAME}' AND a.file_path IS NOT NULL")(
    lambda g: match(g).all(N("a", "Function"), E("CALLS"), N("b", name=NAME)).where(lambda p: p("a.file_path").isNotNull()).rows("a.fqn", "a.start_line")
)
gq("match_within_two", f", near AS (SELECT dst, 1 AS d FROM {CALLS} WHERE src IN (SELECT fqn FROM nodes WHERE name = '{NAME}')), far AS (SELECT dst FROM near UNION SELECT e.dst FROM {CALLS} e JOIN near ON e.src = near.dst) SELECT dst AS b_fqn FROM far")(
    lambda g: match(g).all(N("a", name=NAME), E("CALLS", most=2, ends=True), N("b", "Function")).rows("b.fqn")
)
# Trails: walks over one to three edges, none of them twice.
TRAILS = f""", ce AS (SELECT DISTINCT src, dst FROM {CALLS}), w(a, b, used, k) AS (SELECT src, dst, [src || '>' || dst], 1 FROM ce WHERE src IN (SELECT fqn FROM nodes WHERE name = '{NAME}')
 UNION ALL SELECT a, dst, list_append(used, src || '>' || dst), k + 1 FROM w JOIN ce ON src = b WHERE k < 3 AND NOT list_contains(used, src || '>' || dst))
"""
gq("match_trails", TRAILS + "SELECT b AS b_fqn, count(*) AS cnt FROM w WHERE k >= 2 GROUP BY 1")(lambda g: match(g).all(N("a", name=NAME), E("CALLS", least=2, most=3), N("b")).counts("b.fqn"))
gq("match_chain", f"SELECT DISTINCT c.src AS m_fqn, i.src AS s_fqn FROM edges i JOIN nodes t ON t.fqn = i.dst JOIN edges c ON c.dst = i.src AND c.rel = 'CONTAINS' JOIN nodes m ON m.fqn = c.src AND m.label = 'Module' WHERE i.rel = 'IMPLEMENTS' AND t.name = '{BRAND}'")(
    lambda g: match(g).all(N("m", "Module"), E("CONTAINS"), N("s", "Struct"), E("IMPLEMENTS"), N("t", "Trait", name=BRAND)).rows("m.fqn", "s.fqn")
)
gq("match_shared_types", f", u AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'USES_TYPE') SELECT x.dst AS t_fqn, count(*) AS cnt FROM u x JOIN u y ON x.dst = y.dst AND x.src <> y.src JOIN nodes a ON a.fqn = x.src WHERE a.name = '{NAME}' GROUP BY 1")(
    lambda g: match(g).all(N("a", "Function", name=NAME), E("USES_TYPE"), N("t", "Enum"), E("USES_TYPE", back=True), N("b", "Function")).counts("t.fqn")
)
gq("match_optional", f", i AS (SELECT DISTINCT src, dst FROM edges JOIN nodes ON fqn = dst WHERE rel = 'IMPLEMENTS' AND name = '{BRAND}') SELECT m.fqn AS m_fqn, count(*) AS structs, count(i.dst) AS implementing FROM nodes m JOIN edges c ON c.src = m.fqn AND c.rel = 'CONTAINS' JOIN nodes s ON s.fqn = c.dst AND s.label = 'Struct' LEFT JOIN i ON i.src = s.fqn WHERE m.label = 'Module' AND starts_with(m.fqn, 'ASIA::') GROUP BY 1")(
    lambda g: match(g).all(N("m", "Module", fqn="ASIA::*"), E("CONTAINS"), N("s", "Struct")).maybe(N("s"), E("IMPLEMENTS"), N("t", "Trait", name=BRAND)).rows("m.fqn", "s.fqn", "t.fqn").groupBy("m_fqn").agg(F.count("*").alias("structs"), F.count("t_fqn").alias("implementing"))
)
gq("match_either_way", f", ce AS (SELECT DISTINCT src, dst FROM {CALLS}), s AS (SELECT fqn FROM nodes WHERE name = '{NAME}') SELECT b AS b_fqn, count(*) AS cnt FROM (SELECT dst AS b FROM ce WHERE src IN (SELECT fqn FROM s) UNION ALL SELECT src FROM ce WHERE dst IN (SELECT fqn FROM s) AND src <> dst) GROUP BY 1")(
    lambda g: match(g).all(N("a", name=NAME), E("CALLS", either=True), N("b")).counts("b.fqn")
)
gq("match_inside_module", f", ce AS (SELECT DISTINCT src, dst FROM {CALLS}), co AS (SELECT DISTINCT src, dst FROM edges JOIN nodes ON fqn = src WHERE rel = 'CONTAINS' AND label = 'Module') SELECT x.src AS m_fqn, count(*) AS cnt FROM ce JOIN co x ON x.dst = ce.src JOIN co y ON y.dst = ce.dst AND y.src = x.src WHERE ce.src <> ce.dst GROUP BY 1")(
    lambda g: match(g).every((N("a", "Function"), E("CALLS"), N("b", "Function")), (N("m", "Module"), E("CONTAINS"), N("a")), (N("m"), E("CONTAINS"), N("b"))).counts("m.fqn")
)
gq("match_two_calls_home", f", ce AS (SELECT DISTINCT src, dst FROM {CALLS}), co AS (SELECT DISTINCT src, dst FROM edges JOIN nodes ON fqn = src WHERE rel = 'CONTAINS' AND label = 'Module') SELECT p.src AS m_fqn, count(*) AS cnt FROM ce x JOIN ce y ON x.dst = y.src AND (x.src <> y.src OR x.dst <> y.dst) JOIN co p ON p.dst = x.src JOIN co q ON q.dst = y.dst AND q.src = p.src WHERE x.src <> y.dst GROUP BY 1")(
    lambda g: match(g).every((N("a", "Function"), E("CALLS"), N("b", "Function"), E("CALLS"), N("c", "Function")), (N("m", "Module"), E("CONTAINS"), N("a")), (N("m"), E("CONTAINS"), N("c"))).counts("m.fqn")
)


def _tenants(g: Graph) -> Graph:
    return Graph(g.nodes.withColumn("workspace_id", crate_of("fqn")), g.edges)


TENANT = f", own AS (SELECT fqn FROM nodes WHERE split_part(fqn, '::', 1) = 'ASIA'), ce AS (SELECT DISTINCT src, dst FROM {CALLS} WHERE src IN (SELECT fqn FROM own) AND dst IN (SELECT fqn FROM own))"
gq("match_tenant", TENANT + ", r AS (SELECT src, dst FROM ce UNION SELECT x.src, y.dst FROM ce x JOIN ce y ON x.dst = y.src) SELECT src AS a_fqn, count(*) AS cnt FROM r GROUP BY 1")(
    lambda g: match(_tenants(g), "ASIA").all(N("a", "Function"), E("CALLS", most=2, ends=True), N("b", "Function")).counts("a.fqn")
)
gq("match_relationships", f", e AS (SELECT DISTINCT src, dst, rel FROM edges), s AS (SELECT fqn FROM nodes WHERE name = '{NAME}') SELECT rel AS r_rel, count(*) AS cnt FROM e WHERE src IN (SELECT fqn FROM s) GROUP BY 1")(
    lambda g: match(g).all(N("a", name=NAME), E(var="r"), N("b")).counts("r.rel")
)
