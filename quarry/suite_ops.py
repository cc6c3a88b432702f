"""Queries on runs, reports, listings, evaluations and event kinds, and SQL to hold them against.

Events stand in for stages, calls of services, probes and metrics; orders for tasks,
artifacts and runs; customers for items and workspaces; lineitems for case results.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import audit, evals, eventlog, gaps, listing, metrics, runs, search, tables
from .plans import build
from .plans.graph import crate_of
from .sources import files
from .suite import CRATE, VECTOR, WS, graph_of, query, stores, t, tenant_edges, tenant_nodes
from .suite import G as GRAPH

NOW = "TIMESTAMP '2024-01-20 12:00:00'"


def _now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")


# -- runs ------------------------------------------------------------------------

_STAGE = "CASE event_id % 6 WHEN 0 THEN 'expand' WHEN 1 THEN 'parse' WHEN 2 THEN 'typecheck' WHEN 3 THEN 'extract' WHEN 4 THEN 'graph' ELSE 'embed' END"


def _stage():
    return F.element_at(F.array(*[F.lit(s) for s in runs.STAGES]), (F.col("event_id") % 6 + 1).cast("int"))


def _stages(s, d):
    """One row for each stage of a run: six events in a row are a run."""
    e = t(s, d, "events")
    bad = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)
    return e.select((F.col("event_id") - F.col("event_id") % 6).alias("run_id"), _stage().alias("stage"), F.when(bad, "failed").otherwise("ok").alias("status"), (F.col("event_id") % 50).alias("items_processed"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).cast("long").alias("items_failed"), F.col("value").alias("seconds"))


STAGES = f"SELECT event_id - event_id % 6 AS run_id, event_id, {_STAGE} AS stage, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, event_id % 50 AS items, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS failed, value FROM events"
query("runs_finished", f"""SELECT run_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN sum(failed) > 0 THEN 'partial' ELSE 'completed' END AS status, CAST(sum(items) AS BIGINT) AS items, CAST(sum(failed) AS BIGINT) AS failed, round(sum(value), 3) AS seconds,
 '{{"stages":[' || string_agg('{{"stage":"' || stage || '","status":"' || status || '","items_processed":' || items || '}}', ',' ORDER BY event_id) || ']}}' AS metadata FROM ({STAGES}) GROUP BY run_id""")(lambda s, d: runs.finished(_stages(s, d)))
query("ingestion_progress", f"""SELECT 'partial' AS status, stage, status AS stage_status, items AS items_processed, CAST(event_id % 6 AS INTEGER) AS at FROM ({STAGES}) WHERE run_id = (SELECT max(event_id) - max(event_id) % 6 - 6 FROM events) AND stage <> 'typecheck' UNION ALL SELECT 'partial', 'typecheck', 'unknown', 0, 2""")(lambda s, d: _progress_rows(s, d))


def _progress_rows(s, d):
    last = t(s, d, "events").agg((F.max("event_id") - F.max("event_id") % 6 - 6).alias("last"))
    one = _stages(s, d).withColumn("_at", F.array_position(F.array(*[F.lit(x) for x in runs.STAGES]), F.col("stage")))
    # One stage has neither status nor items, one bears its name as `name`, and one has none.
    entry = F.when(F.col("stage") == "typecheck", F.lit('{"name":"typecheck"}')).otherwise(F.to_json(F.struct("stage", "status", "items_processed")))
    text = F.concat(F.lit('{"stages":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", entry.alias("j")))), lambda x: x["j"]), ","), F.lit(',{"status":"lost"}]}'))
    r = one.groupBy("run_id").agg(text.alias("metadata")).crossJoin(last).where(F.col("run_id") <= F.col("last"))
    r = r.select(F.lit("partial").alias("status"), F.col("run_id").alias("started_at"), F.lit(None).cast("int").alias("crates_processed"), F.lit(None).cast("int").alias("items_extracted"), "metadata")
    return listing.progress(r).select("status", "stage", "stage_status", "items_processed", "at")


ITEMS_OF = "SELECT 'c' || c_nationkey || '::f' || c_custkey AS fqn, CASE WHEN c_custkey % 97 <> 5 THEN c_custkey END AS source_file_id, c_nationkey AS k FROM customer"


def _customers(s, d):
    c = t(s, d, "customer")
    return c.select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("::f"), F.col("c_custkey").cast("string")).alias("fqn"), F.when(F.col("c_custkey") % 97 != 5, F.col("c_custkey")).alias("source_file_id"))


query("gate_before_graph", f"SELECT 'c' || k AS crate_name, count(*) FILTER (WHERE source_file_id IS NULL) AS orphans, count(*) FILTER (WHERE source_file_id IS NULL) = 0 AS passed FROM ({ITEMS_OF}) GROUP BY k")(lambda s, d: runs.items_without_file(_customers(s, d)))
query("gate_before_embed", " UNION ALL ".join(f"SELECT {seed} AS seed, count(*) AS sampled, count(*) FILTER (WHERE k % {m} = 0) AS missing, count(*) FILTER (WHERE k % {m} = 0) = 0 AS passed FROM (SELECT CAST(split_part(fqn, '::f', 2) AS BIGINT) AS k FROM (SELECT 'c' || c_nationkey || '::f' || c_custkey AS fqn FROM customer) ORDER BY md5(fqn || '{seed}'), fqn LIMIT {size})" for seed, m, size in ((0, 4, 10), (1, 1000003, 10), (2, 3, 100))))(
    lambda s, d: reduce(DataFrame.unionByName, [runs.sample_in_graph(_customers(s, d), _customers(s, d).where(F.split_part("fqn", F.lit("::f"), F.lit(2)).cast("long") % m != 0), size, seed).select(F.lit(seed).alias("seed"), "*") for seed, m, size in ((0, 4, 10), (1, 1000003, 10), (2, 3, 100))])
)
query("size_gate", "SELECT doc_id, CASE WHEN strlen(e) <= 2000 AND (length(e) - length(replace(e, 'in ', ''))) / 3 <= 8 THEN length(e) ELSE length(text) END AS n FROM (SELECT doc_id, text, text || chr(10) || text AS e FROM documents)")(
    lambda s, d: files.within_expansion(t(s, d, "documents").select("doc_id", "text", F.concat("text", F.lit("\n"), "text").alias("expanded")), most=2000, blocks=8, head="in ").select("doc_id", F.length("text").cast("long").alias("n"))
)
query("partial_refs", "WITH p AS (SELECT k AS id, k IN (SELECT doc_id FROM documents) AS a, k IN (SELECT doc_id FROM labels) AS b, k IN (SELECT vec_id FROM embeddings) AS c FROM (SELECT doc_id AS k FROM documents UNION SELECT vec_id FROM embeddings)) SELECT id FROM p WHERE (a OR b OR c) AND NOT (a AND b AND c)")(lambda s, d: runs.partial_refs(stores(s, d).select("id", F.col("in_pg").alias("in_tables"), "in_graph", F.col("in_vector").alias("in_vectors"))).select("id"))


@query("cascade_delete", "SELECT 'tables' AS store, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS cnt UNION ALL SELECT 'graph', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) UNION ALL SELECT 'vectors', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def _cascade(s, d):
    left = runs.cascaded({"tables": (t(s, d, "documents"), "doc_id"), "graph": (t(s, d, "labels"), "doc_id"), "vectors": (t(s, d, "embeddings"), "vec_id")}, t(s, d, "labels").where("toxic = 1"), "doc_id")
    out = None
    for name, df in left.items():
        one = df.agg(F.lit(name).alias("store"), F.count("*").alias("cnt"))
        out = one if out is None else out.union(one)
    return out


PRESSURES = "CASE event_id % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'elevated' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'emergency' END"
query("degradation_tiers", f"""WITH e AS (SELECT event_id, {PRESSURES} AS p, value > 20 AS g, event_type = 'error' AS m, {_STAGE} AS stage FROM events), r AS (SELECT *, CASE WHEN p = 'emergency' THEN 'emergency' WHEN p = 'critical' OR (g AND m) THEN 'minimal' WHEN m OR p = 'high' THEN 'reduced' ELSE 'full' END AS tier FROM e)
 SELECT event_id, tier, CASE tier WHEN 'full' THEN true WHEN 'reduced' THEN stage <> 'embed' WHEN 'minimal' THEN stage IN ('expand', 'parse', 'typecheck', 'extract') ELSE stage IN ('expand', 'parse') END AS runs FROM r""")(
    lambda s, d: t(s, d, "events").select("event_id", runs.tier(F.element_at(F.array(*[F.lit(p) for p in runs.PRESSURE]), (F.col("event_id") % 5 + 1).cast("int")), F.col("value") > 20, F.col("event_type") == "error").alias("tier"), _stage().alias("stage")).select("event_id", "tier", runs.runs_at(F.col("tier"), F.col("stage")).alias("runs"))
)
# Calls of a service in order of time: a row at a time down each chain.
CHAIN = "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_type <> 'error' AND event_type <> 'click' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), "
query("circuit_breaker", CHAIN + """c AS (SELECT user_id, r, us, ok, true AS allowed, CASE WHEN ok THEN 0 ELSE 1 END AS bad, 'closed' AS state, CAST(NULL AS BIGINT) AS since FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.r, e.us, e.ok, go, CASE WHEN NOT go THEN bad WHEN e.ok THEN 0 ELSE bad + 1 END, CASE WHEN NOT go THEN c.state WHEN e.ok THEN 'closed' WHEN c.state = 'open' OR bad + 1 >= 5 THEN 'open' ELSE c.state END,
 CASE WHEN go AND NOT e.ok AND (c.state = 'open' OR bad + 1 >= 5) THEN e.us ELSE since END FROM (SELECT *, user_id AS u, r AS q FROM c) c JOIN e ON e.user_id = c.u AND e.r = c.q + 1, LATERAL (SELECT c.state = 'closed' OR e.us - c.since >= 72000000000 AS go))
 SELECT user_id, allowed, state, count(*) AS cnt FROM c GROUP BY ALL""")(
    lambda s, d: runs.breaker(t(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (~F.col("event_type").isin("error", "click")).alias("ok")), "user_id", "ts", "ok", rest=20 * 3600).groupBy("user_id", "allowed", "state").agg(F.count("*").alias("cnt"))
)
query("events_rate_limit", CHAIN.replace("event_type <> 'error' AND event_type <> 'click' AS ok", "ts") + """c AS (SELECT user_id, r, ts, us AS start, 1 AS n FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, e.ts, CASE WHEN e.us - start >= 86400000000 THEN e.us ELSE start END, CASE WHEN e.us - start >= 86400000000 THEN 1 ELSE n + 1 END FROM (SELECT *, user_id AS u, r AS q FROM c) c JOIN e ON e.user_id = c.u AND e.r = c.q + 1)
 SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(greatest(0, 2 - n) AS BIGINT) AS remaining, n <= 2 AS allowed FROM c""")(lambda s, d: eventlog.rate_limited(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 2, 86400).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
query("stale_stages", f"SELECT stage, round((epoch_us({NOW}) - max(epoch_us(ts))) / 1e6, 3) AS seconds, (epoch_us({NOW}) - max(epoch_us(ts))) / 1e6 > CASE stage WHEN 'expand' THEN 600 WHEN 'parse' THEN 30 WHEN 'typecheck' THEN 30 WHEN 'embed' THEN 90 ELSE 60 END AS stale FROM (SELECT {_STAGE} AS stage, ts FROM events WHERE ts < {NOW}) GROUP BY stage")(lambda s, d: runs.stale_stages(t(s, d, "events").where(F.col("ts") < _now()).withColumn("stage", _stage()), _now()).withColumn("seconds", F.round("seconds", 3)))
RUNNING = "SELECT event_id AS id, ts AS started_at, CASE WHEN event_type = 'view' THEN 'running' WHEN event_type = 'click' THEN 'completed' ELSE 'failed' END AS status, 3600 * (event_id % 400) AS timeout_secs, CASE WHEN event_id % 3 > 0 THEN 'x' || event_id END AS container_id, CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL 2 DAY END AS expires_at FROM events"


def _executions(s, d):
    return t(s, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "completed").otherwise("failed").alias("status"), (F.col("event_id") % 400 * 3600).alias("timeout_secs"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("container_id"), F.when(F.col("event_id") % 4 > 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"),
    )


query("executions_timed_out", f"SELECT id FROM ({RUNNING}) WHERE status = 'running' AND started_at + timeout_secs * INTERVAL 1 SECOND < {NOW}")(lambda s, d: runs.timed_out(_executions(s, d), _now()).select("id"))
query("executions_expired", f"SELECT id FROM ({RUNNING}) WHERE status IN ('running', 'completed') AND container_id IS NOT NULL AND expires_at <= {NOW}")(lambda s, d: runs.expired(_executions(s, d), _now()).select("id"))
query("leak_scan", "SELECT 'container' AS kind, CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'volume', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")(
    lambda s, d: runs.leak_scan({"container": (t(s, d, "customer").select(F.col("c_custkey").alias("k")), t(s, d, "orders").select(F.col("o_custkey").alias("k")), "k"), "volume": (t(s, d, "part").select(F.col("p_partkey").alias("k")), t(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k")), "k")})
)
GAUGES = "SELECT CASE event_type WHEN 'view' THEN 'multi_label_nodes' WHEN 'click' THEN 'orphan_nodes' WHEN 'error' THEN 'leak_scan_age_seconds' ELSE 'memory_share' END AS gauge, ts, CASE WHEN event_type = 'error' THEN value * 1000 WHEN event_type IN ('view', 'click') THEN floor(value) ELSE value / 40 END AS value FROM events"


def _gauges(s, d):
    e, k, v = t(s, d, "events"), F.col("event_type"), F.col("value")
    return e.select(F.when(k == "view", "multi_label_nodes").when(k == "click", "orphan_nodes").when(k == "error", "leak_scan_age_seconds").otherwise("memory_share").alias("gauge"), "ts", F.when(k == "error", v * 1000).when(k.isin("view", "click"), F.floor(v).cast("double")).otherwise(v / 40).alias("value"))


RULES = "(VALUES ('multi_label_nodes', 0.0, 30, 'critical'), ('orphan_nodes', 3.0, 60, 'warning'), ('leak_scan_age_seconds', 100.0, 240, 'warning'), ('memory_share', 0.01, 1, 'warning')) r(gauge, threshold, minutes, severity)"
query("alerts", f"""WITH g AS (SELECT * FROM ({GAUGES}) JOIN {RULES} USING (gauge) WHERE ts <= {NOW}), w AS (SELECT *, ts > {NOW} - minutes * INTERVAL 1 MINUTE AS late FROM g)
 SELECT gauge, severity, arg_max(value, (ts, value)) AS value FROM w GROUP BY gauge, severity HAVING coalesce(bool_and(value > threshold) FILTER (WHERE late), true) AND coalesce(arg_max(value > threshold, (ts, value)) FILTER (WHERE NOT late), false)""")(
    lambda s, d: runs.alerts(_gauges(s, d), _now(), (("multi_label_nodes", 0, 30, "critical"), ("orphan_nodes", 3, 60, "warning"), ("leak_scan_age_seconds", 100, 240, "warning"), ("memory_share", 0.01, 1, "warning")))
)
query("health_rollup", "WITH p AS (SELECT event_type AS dependency, arg_max(value > 5, event_id) AS healthy FROM events GROUP BY 1) SELECT CASE WHEN bool_and(healthy) THEN 'healthy' ELSE 'degraded' END AS status, coalesce(string_agg(dependency, ',' ORDER BY dependency) FILTER (WHERE NOT healthy), '') AS failing FROM p")(lambda s, d: runs.rollup(t(s, d, "events").groupBy(F.col("event_type").alias("dependency")).agg(F.max_by(F.col("value") > 5, "event_id").alias("healthy"))))
query("metric_rates", "WITH c AS (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS was FROM events) SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS bucket, round(sum(CASE WHEN was IS NULL THEN 0 WHEN value >= was THEN value - was ELSE value END) / 300, 6) AS rate FROM c GROUP BY 1, 2")(
    lambda s, d: metrics.rates(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", 5, "event_type", tie="event_id").select("event_type", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), F.round("rate", 6).alias("rate"))
)
# Durations of requests as a histogram that is scraped each minute; rates of its counters over five minutes, summed over users' parity, and quantiles of these.
BOUNDS = [0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]
_LES = ", ".join(f"({b}::DOUBLE)" for b in (*BOUNDS, "'Infinity'"))
HISTOGRAM = f"""WITH le AS (SELECT * FROM (VALUES {_LES}) v(le)), o AS (SELECT event_type, user_id % 2 AS side, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS ts, value FROM events WHERE value IS NOT NULL),
 n AS (SELECT event_type, side, ts, le, count(*) FILTER (value <= le) AS n FROM o, le GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type, side, le ORDER BY ts) AS c FROM n),
 r AS (SELECT event_type, side, le, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, coalesce(c - lag(c) OVER (PARTITION BY event_type, side, le ORDER BY ts), 0) AS d FROM c),
 s AS (SELECT event_type, bucket, le, sum(d) / 300 AS n FROM r GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY event_type, bucket) AS total, coalesce(lag(n) OVER w, 0) AS under, coalesce(lag(le) OVER w, 0) AS low FROM s WINDOW w AS (PARTITION BY event_type, bucket ORDER BY le))
"""


def _quantile_sql(q):
    return f"SELECT event_type, bucket, arg_min(CASE WHEN le = 'Infinity' THEN low ELSE low + (le - low) * ({q} * total - under) / (n - under) END, le) AS v FROM m WHERE total > 0 AND n >= {q} * total GROUP BY 1, 2"


def _observed(s, d):
    e = t(s, d, "events").select("event_type", (F.col("user_id") % 2).alias("side"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return metrics.observed(e, "ts", "value", BOUNDS, "1 minute", "event_type", "side")


query("metric_quantiles", HISTOGRAM + f"SELECT a.event_type, strftime(a.bucket, '%Y-%m-%d %H:%M') AS bucket, round(a.v, 6) AS p50, round(b.v, 6) AS p95 FROM ({_quantile_sql(0.5)}) a JOIN ({_quantile_sql(0.95)}) b USING (event_type, bucket) UNION ALL SELECT DISTINCT event_type, strftime(bucket, '%Y-%m-%d %H:%M'), NULL::DOUBLE, NULL::DOUBLE FROM m WHERE total = 0")(
    lambda s, d: metrics.histogram_quantiles(metrics.rates(_observed(s, d), "ts", "count", 5, "event_type", "side", "le"), "rate", {"p50": 0.5, "p95": 0.95}, "event_type", "bucket").select("event_type", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
)
query("metric_histogram", HISTOGRAM + "SELECT event_type, side, strftime(ts, '%Y-%m-%d %H:%M') AS ts, le, CAST(c AS BIGINT) AS count FROM c")(lambda s, d: _observed(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm")))

# -- reports ---------------------------------------------------------------------


@query("workspace_stats", f"WITH n AS ({WS}), h AS (SELECT * FROM n WHERE list_contains(ws, 'Workspace_3')), e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 13 + o_orderkey % 3) % (SELECT count(*) FROM customer) AS dst FROM orders), c AS (SELECT (SELECT count(*) FROM supplier WHERE s_nationkey = 3) AS items_count, (SELECT count(*) FROM h) AS nodes_count, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM h) AND dst IN (SELECT id FROM h)) AS edges_count, (SELECT count(*) FROM embeddings WHERE label = 3) AS vectors_count, (SELECT count(*) FROM h WHERE len(ws) > 1) AS multi_label, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM h) AND dst NOT IN (SELECT id FROM h)) AS cross_edges) SELECT *, 0 AS shared_fqns, items_count - nodes_count AS graph_delta, items_count - vectors_count AS vector_delta, CASE WHEN items_count = nodes_count AND items_count = vectors_count THEN 'consistent' ELSE 'inconsistent' END AS status, 7200.0::DOUBLE AS index_seconds FROM c")
def _workspace(s, d):
    one = gaps.workspace_stats(t(s, d, "supplier").where("s_nationkey = 3"), tenant_nodes(s, d), tenant_edges(s, d), t(s, d, "embeddings").where("label = 3"), "Workspace_3", F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 02:00:00").cast("timestamp"))
    return one.withColumn("shared_fqns", F.col("shared_fqns").cast("int"))


def _counts(s, d):
    g = graph_of(s, d)
    items = t(s, d, "part").select(F.when(F.col("p_size") > 25, "function").otherwise("struct").alias("item_type"))
    return gaps.counts(items, g.nodes, g.edges, t(s, d, "embeddings"))


query("gap_features", GRAPH + "SELECT 'semantic_search' AS feature, CASE WHEN EXISTS (SELECT 1 FROM embeddings) THEN 'working' ELSE 'partial' END AS status UNION ALL SELECT 'get_function' AS feature, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_size > 25) AND EXISTS (SELECT 1 FROM nodes WHERE label = 'Function') THEN 'working' ELSE 'partial' END AS status UNION ALL SELECT 'get_callers' AS feature, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE rel = 'CALLS') AND EXISTS (SELECT 1 FROM nodes WHERE label = 'Function') THEN 'working' ELSE 'partial' END AS status UNION ALL SELECT 'get_trait_impls' AS feature, CASE WHEN EXISTS (SELECT 1 FROM nodes WHERE label = 'Trait') AND EXISTS (SELECT 1 FROM edges WHERE rel = 'IMPLEMENTS') THEN 'working' ELSE 'partial' END AS status UNION ALL SELECT 'find_usages' AS feature, CASE WHEN EXISTS (SELECT 1 FROM nodes WHERE label = 'Type') AND EXISTS (SELECT 1 FROM edges WHERE rel = 'USES_TYPE') THEN 'working' ELSE 'partial' END AS status UNION ALL SELECT 'module_tree' AS feature, CASE WHEN EXISTS (SELECT 1 FROM nodes WHERE label = 'Module') AND EXISTS (SELECT 1 FROM nodes WHERE label = 'Crate') AND EXISTS (SELECT 1 FROM edges WHERE rel = 'CONTAINS') THEN 'working' ELSE 'partial' END AS status UNION ALL SELECT 'graph_query' AS feature, CASE WHEN EXISTS (SELECT 1 FROM nodes) THEN 'working' ELSE 'partial' END AS status")(lambda s, d: gaps.features(_counts(s, d)))
query("gap_quality", GRAPH + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM embeddings) AS points, (SELECT count(*) FROM part) AS items, true AS has_embeddings, EXISTS (SELECT 1 FROM edges WHERE rel = 'CALLS') AS has_call_graph, EXISTS (SELECT 1 FROM edges WHERE rel = 'IMPLEMENTS') AS has_trait_impls")(lambda s, d: gaps.quality(_counts(s, d)))
query("gap_recommendations", "SELECT priority, action FROM (VALUES ('medium', 'extract type usages', true), ('low', 'embed items again', (SELECT count(*) FROM part) > 2 * (SELECT count(*) FROM embeddings)), ('low', 'expand derive macros', true), ('low', 'embed structs, enums and traits too', true)) v(priority, action, holds) WHERE holds")(lambda s, d: gaps.recommendations(_counts(s, d)))
IN3 = "SELECT id % 10 AS crate, count(*) FILTER (WHERE a) AS pg, count(*) FILTER (WHERE b) AS gr, count(*) FILTER (WHERE c) AS ve, count(*) FILTER (WHERE a AND NOT b) AS pg_, count(*) FILTER (WHERE a AND NOT c) AS pv, count(*) FILTER (WHERE b AND NOT a) AS gp, count(*) FILTER (WHERE c AND NOT a) AS vp FROM (SELECT k AS id, k IN (SELECT doc_id FROM documents) AS a, k IN (SELECT doc_id FROM labels) AS b, k IN (SELECT vec_id FROM embeddings) AS c FROM (SELECT doc_id AS k FROM documents UNION SELECT vec_id FROM embeddings UNION SELECT doc_id FROM labels)) GROUP BY 1"
query("consistency_advice", f"""SELECT crate, CASE WHEN gr < pg THEN 'The graph has fewer items than the tables - Graph stage may be incomplete' || CASE WHEN ve < pg THEN '. The vectors have fewer items than the tables - Embed stage may be incomplete' ELSE '' END || '.' WHEN ve < pg THEN 'The vectors have fewer items than the tables - Embed stage may be incomplete.' ELSE 'All stores are consistent. No action required.' END AS summary,
 array_to_string(list_filter([CASE WHEN pg_ > 0 THEN pg_ || ' items missing from the graph - re-run Graph stage' END, CASE WHEN pv > 0 THEN pv || ' items missing from the vectors - re-run Embed stage' END, CASE WHEN gp > 0 THEN gp || ' orphaned nodes in the graph - data may need cleanup' END, CASE WHEN vp > 0 THEN vp || ' orphaned points in the vectors - data may need cleanup' END], lambda x: x IS NOT NULL), '. ') || '.' AS full_ FROM ({IN3})""")(lambda s, d: _advice(s, d))


def _advice(s, d):
    p = stores(s, d).withColumn("crate", F.col("id") % 10)
    n = lambda a, b=None: F.count_if(F.col(f"in_{a}") if b is None else F.col(f"in_{a}") & ~F.col(f"in_{b}"))
    c = p.groupBy("crate").agg(n("pg").alias("pg"), n("graph").alias("graph"), n("vector").alias("vector"), n("pg", "graph").alias("pg_graph"), n("pg", "vector").alias("pg_vector"), n("graph", "pg").alias("graph_pg"), n("vector", "pg").alias("vector_pg"))
    of = lambda lacks=None: gaps.advice(F.col("pg"), F.col("graph"), F.col("vector"), lacks)
    return c.select("crate", of().alias("summary"), of({k: F.col(k) for k in ("pg_graph", "pg_vector", "graph_pg", "vector_pg")}).alias("full_"))


query("audit_log_workspaces", "SELECT r_name AS workspace, count(*) AS entries FROM events JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")(lambda s, d: t(s, d, "events").join(t(s, d, "nation"), F.col("user_id") % 25 == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("workspace")).agg(F.count("*").alias("entries")))
query("audit_capped", f"SELECT id FROM ({WS}) WHERE len(ws) = 1 ORDER BY id LIMIT 500")(lambda s, d: audit.capped(tenant_nodes(s, d).where(F.size(audit.tenants()) == 1).select("id"), "id"))

# -- listings --------------------------------------------------------------------

TASKS = "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS agent, CAST(o_custkey % 5 AS VARCHAR) AS phase, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS class, o_orderdate AS updated_at FROM orders"


def _tasks(s, d):
    return t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("agent"), (F.col("o_custkey") % 5).cast("string").alias("phase"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("class"), F.col("o_orderdate").alias("updated_at"))


query("list_tasks", f"SELECT id, status, class FROM ({TASKS}) WHERE status = 'F' AND class = 'a' ORDER BY updated_at DESC, id LIMIT 100")(lambda s, d: listing.tasks(_tasks(s, d), status="F", kind="a", limit=500).select("id", "status", "class"))
query("list_artifacts", f"SELECT id, producer FROM (SELECT id, phase AS task_id, class AS type, status, agent AS producer, updated_at AS created_at FROM ({TASKS})) WHERE task_id = '3' AND producer = '5-LOW' ORDER BY created_at DESC, id LIMIT 20")(lambda s, d: listing.artifacts(_tasks(s, d).select("id", F.col("phase").alias("task_id"), F.col("class").alias("type"), "status", F.col("agent").alias("producer"), F.col("updated_at").alias("created_at")), task_id="3", producer="5-LOW", limit=20).select("id", "producer"))
query("list_tasks_nulls", f"SELECT id FROM (SELECT id, CASE WHEN id % 200 <> 0 THEN updated_at END AS updated_at FROM ({TASKS})) ORDER BY updated_at DESC NULLS FIRST, id LIMIT 90")(lambda s, d: listing.tasks(_tasks(s, d).withColumn("updated_at", F.when(F.col("id") % 200 != 0, F.col("updated_at"))), limit=90).select("id"))
query("soft_delete", f"SELECT id, 'archived' AS status FROM ({TASKS})")(lambda s, d: _tasks(s, d).withColumn("status", F.when(F.col("id") % 3 == 0, "archived").otherwise(F.col("status"))).select("id", listing.archived().alias("status")))
query("validator_runs", "SELECT l_orderkey AS run_index, l_linenumber AS created_at FROM lineitem WHERE l_suppkey = 7 AND l_partkey % 10 = 3")(lambda s, d: listing.validator_runs(t(s, d, "lineitem").select(F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("repo"), (F.col("l_partkey") % 10).alias("pr_number"), F.col("l_orderkey").alias("run_index"), F.col("l_linenumber").alias("created_at")), "r7", 3).select("run_index", "created_at"))
query("bench_runs", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")(lambda s, d: listing.bench_runs(t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("suite_name"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at")), suite="1-URGENT").select("id"))
query("bench_run", "SELECT o_orderkey AS id, (SELECT string_agg(l_partkey || ':' || l_linenumber || ':' || p_size, ',' ORDER BY l_partkey, l_linenumber) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey) AS cases FROM orders WHERE o_orderkey = (SELECT max(l_orderkey) FROM lineitem)")(lambda s, d: _bench_run(s, d))
query("eval_suite_sizes", "SELECT p_brand AS suite_name, count(*) AS case_count FROM part GROUP BY 1")(lambda s, d: listing.suites(t(s, d, "part").withColumnRenamed("p_brand", "suite_name")))


def _bench_run(s, d):
    last = t(s, d, "lineitem").agg(F.max("l_orderkey")).first()[0]
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("bench_run_id"), F.col("l_partkey").alias("eval_case_id"), F.col("l_linenumber").alias("run_index"), F.col("l_quantity").alias("composite"), (F.col("l_quantity") > 40).alias("pass"), F.col("l_tax").alias("cost_usd"))
    out = listing.bench_run(t(s, d, "orders").withColumnRenamed("o_orderkey", "id"), li, t(s, d, "part").select(F.col("p_partkey").alias("eval_case_id"), F.col("p_size").alias("weight")), last)
    return out.select("id", F.array_join(F.transform("case_results", lambda x: F.concat_ws(":", x["eval_case_id"].cast("string"), x["run_index"].cast("string"), x["weight"].cast("string"))), ",").alias("cases"))


# -- evaluation --------------------------------------------------------------------

query("eval_first_metadata", "SELECT l_returnflag AS suite, l_partkey % 50 AS c, count(*) AS runs, arg_min(l_linestatus || l_suppkey, l_orderkey * 10 + l_linenumber) AS model FROM lineitem GROUP BY 1, 2")(
    lambda s, d: evals.cases(t(s, d, "lineitem").select(F.col("l_returnflag").alias("suite"), (F.col("l_partkey") % 50).alias("c"), F.col("l_quantity").alias("composite"), F.lit(True).alias("passed"), F.col("l_tax").alias("cost"), F.concat("l_linestatus", F.col("l_suppkey").cast("string")).alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_index")), "suite", "c", ("model",)).select("suite", "c", "runs", "model")
)
DIMS = "['file_precision', 'file_recall', 'logical_equivalence', 'code_quality', 'edge_case_handling', 'approach_validity']"
query("eval_dimensions", f"WITH s AS (SELECT l_orderkey % 500 AS run, ({DIMS})[l_linenumber % 5 + 1] AS dimension, l_quantity AS score FROM lineitem), r AS (SELECT DISTINCT run FROM s), k AS (SELECT run, unnest({DIMS}) AS dimension FROM r) SELECT run, dimension, round(coalesce(avg(score), 0), 6) AS mean, round(coalesce(stddev_pop(score), 0), 6) AS std FROM k LEFT JOIN s USING (run, dimension) GROUP BY 1, 2")(
    lambda s, d: evals.dimensions(t(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("run"), F.element_at(F.array(*[F.lit(n) for n, _ in evals.WEIGHTS]), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("dimension"), F.col("l_quantity").alias("score")), "run").select("run", "dimension", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
)
query("eval_all_weights", "SELECT l_orderkey, l_linenumber, round(0.15 * l_tax + 0.15 * l_discount + 0.30 * l_quantity / 10 + 0.20 * l_linenumber + 0.10 * coalesce(CASE WHEN l_returnflag <> 'N' THEN l_quantity / 20 END, 0) + 0.10 * (l_partkey % 5), 6) AS composite FROM lineitem")(
    lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(evals.weighted({"file_precision": F.col("l_tax"), "file_recall": F.col("l_discount"), "logical_equivalence": F.col("l_quantity") / 10, "code_quality": F.col("l_linenumber"), "edge_case_handling": F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 20), "approach_validity": F.col("l_partkey") % 5}), 6).alias("composite"))
)
query("eval_structure", "SELECT l_orderkey, l_linenumber, CAST(m AS DOUBLE) AS score, CASE WHEN l_returnflag = 'R' THEN m < 0.35 ELSE m >= 0.5 END AS passed FROM (SELECT *, 0.3 * CAST(l_tax * 10 AS DECIMAL(12, 6)) + 0.3 * CAST(l_discount * 10 AS DECIMAL(12, 6)) + 0.4 * CAST(l_quantity / 50 AS DECIMAL(12, 6)) AS m FROM lineitem)")(
    lambda s, d: t(s, d, "lineitem").withColumn("m", evals.structure(F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity") / 50)).select("l_orderkey", "l_linenumber", F.col("m").cast("double").alias("score"), evals.structure_passes(F.col("m"), F.col("l_returnflag") == "R").alias("passed"))
)
query("eval_totals", "SELECT l_returnflag AS suite, CAST(sum(l_suppkey) AS BIGINT) AS tokens, CAST(sum(CASE WHEN l_linenumber <> 3 THEN CAST(l_tax AS DECIMAL(10, 6)) ELSE 0 END) AS VARCHAR) AS cost FROM lineitem GROUP BY 1")(lambda s, d: evals.totals(t(s, d, "lineitem").select(F.col("l_returnflag").alias("suite"), F.col("l_suppkey").alias("tokens"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("cost")), "suite").withColumn("cost", F.col("cost").cast("string")))


def _diffs(s, d, side):
    """A unified diff for each part: two files in `.rs` and one more, of which the other side has its own."""
    k, n = F.col("p_partkey"), F.col("p_name")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    own = "x" if side else "y"
    second = F.when(k % 3 == 0, F.lit("")).otherwise(text("diff --git a/s.rs b/s.rs\n@@ -1 +1,2 @@\n-old\n", F.when((k % 4 == 0) & F.lit(side), F.lit("")).otherwise(text("+gone ", k, "\n"))))
    return t(s, d, "part").select(F.col("p_partkey").alias("k"), text("diff --git a/m.rs b/m.rs\n--- a/m.rs\n+++ b/m.rs\n+before\n@@ -1,2 +1,3 @@\n context\n+", n, "\n", "+" + ("same" if side else "name"), "\n", "+more\n" if side else "", second, f"diff --git a/{own}.md b/{own}.md\n@@ -0,0 +1 @@\n+text\n").alias("patch"))


query("diff_files", """SELECT p_partkey AS k, f.path, f.hunks, f.added AS lines_added, f.removed AS lines_removed FROM part, LATERAL (SELECT 'm.rs' AS path, 1 AS hunks, 3 AS added, 0 AS removed UNION ALL SELECT 'x.md', 1, 1, 0 UNION ALL SELECT 's.rs', 1, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END, 1 WHERE p_partkey % 3 <> 0) f""")(lambda s, d: evals.diff_files(_diffs(s, d, True), "k", "patch").drop("added"))
query("diff_compare", """WITH m AS (SELECT p_partkey AS k, (1.0 + jaro_winkler_similarity('same', 'name')) / 3 AS a, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 1.0 END AS b FROM part)
 SELECT k, round(CASE WHEN b IS NULL THEN 0.5 ELSE 2.0 / 3 END, 6) AS file_precision, round(CASE WHEN b IS NULL THEN 0.5 ELSE 2.0 / 3 END, 6) AS file_recall, round(CASE WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS line_similarity, 'x.md,y.md' AS other_files FROM m""")(
    lambda s, d: evals.compare_diffs(evals.diff_files(_diffs(s, d, True), "k", "patch"), evals.diff_files(_diffs(s, d, False), "k", "patch"), "k").select("k", F.round("file_precision", 6).alias("file_precision"), F.round("file_recall", 6).alias("file_recall"), F.round("line_similarity", 6).alias("line_similarity"), F.array_join("other_files", ",").alias("other_files"))
)

# -- events --------------------------------------------------------------------------

TYPED = """SELECT event_id, event_id AS id, user_id, CASE event_id % 9 WHEN 0 THEN 'reasoning' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'agent_dispatch' WHEN 3 THEN 'error' WHEN 4 THEN 'file_edit' WHEN 5 THEN 'phase_change' WHEN 6 THEN 'container_kept_alive' WHEN 7 THEN 'odd' ELSE 'tool_call' END AS event_type FROM events"""


def _log(s, d):
    kinds = ["reasoning", "tool_call", "agent_dispatch", "error", "file_edit", "phase_change", "container_kept_alive", "odd", "tool_call"]
    k, v = F.col("event_id") % 9, F.col("event_type")
    say = lambda f: F.concat(F.lit(f.split("%s")[0]), v, F.lit(f.split("%s")[1]))
    texts = ['{"agent":"a","text":"I %s now"}', '{"agent":"a","tool":"grep","result":"Error: %s"}', '{"agent":"%s"}', '{"stage":"%s"}', '{"path":"src/%s.rs"}', '{"phase":"%s"}', '{"container_id":"%s"}', '{"x":"%s"}', '"not an object %s"']
    content = F.element_at(F.array(*[say(x) for x in texts]), (k + 1).cast("int"))
    return t(s, d, "events").select("event_id", F.col("event_id").alias("id"), "user_id", F.element_at(F.array(*[F.lit(x) for x in kinds]), (k + 1).cast("int")).alias("event_type"), v.alias("v"), content.alias("content"))


query("events_decoded", f"SELECT event_id, CASE WHEN event_id % 9 IN (7, 8) THEN 'unknown' ELSE event_type END AS kind, event_id % 9 NOT IN (7, 8) AS known FROM ({TYPED})")(lambda s, d: eventlog.typed(_log(s, d)).select("event_id", "decoded.kind", F.col("raw").isNull().alias("known")))
query("events_search", f"SELECT event_id FROM ({TYPED}) JOIN (SELECT event_id, event_type AS v FROM events) USING (event_id) WHERE event_id % 9 NOT IN (7, 8) AND v = 'click' OR contains(event_type, 'click')")(lambda s, d: eventlog.matching(eventlog.typed(_log(s, d)), " CLICK ").select("event_id"))
query("events_search_empty", "SELECT event_id FROM events WHERE false")(lambda s, d: eventlog.matching(eventlog.typed(_log(s, d)), "  ").select("event_id"))
LABELS = "CASE event_id % 9 WHEN 0 THEN CASE WHEN n = 1 THEN 'reasoning' ELSE n || ' reasoning events' END WHEN 1 THEN CASE WHEN n = 1 THEN 'tool: grep → error' ELSE n || ' tool calls (grep…)' END WHEN 2 THEN CASE WHEN n = 1 THEN 'dispatch ' || v ELSE n || ' agent dispatches' END WHEN 3 THEN CASE WHEN n = 1 THEN 'error' ELSE n || ' errors' END WHEN 4 THEN CASE WHEN n = 1 THEN 'file: src/' || v || '.rs' ELSE n || ' file edits' END WHEN 5 THEN CASE WHEN n = 1 THEN 'phase: ' || v ELSE n || ' phase changes' END WHEN 6 THEN CASE WHEN n = 1 THEN 'container heartbeat' ELSE n || ' container heartbeats' END ELSE CASE WHEN n = 1 THEN 'unknown event' ELSE n || ' unknown events' END END"
query("events_labels", f"SELECT event_id, {LABELS} AS label FROM (SELECT event_id, event_type AS v, event_id % 2 + 1 AS n FROM events)")(lambda s, d: eventlog.typed(_log(s, d)).select("event_id", (F.col("event_id") % 2 + 1).alias("n"), F.col("decoded.kind").alias("kind"), F.col("decoded").alias("first")).select("event_id", eventlog.labels().alias("label")))
query("events_tool_status", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'error' ELSE 'completed' END AS status FROM events")(lambda s, d: t(s, d, "events").withColumn("r", F.element_at(F.array(F.lit(None).cast("string"), F.lit("  ERROR x"), F.lit('{"is_error":true}'), F.lit('{"error":"boom"}'), F.lit("errors none"), F.lit('{"error":"","ok":1}')), (F.col("event_id") % 6 + 1).cast("int"))).select("event_id", eventlog.tool_status(F.col("r")).alias("status")))
query("events_parts", "SELECT CASE event_id % 6 WHEN 4 THEN 'tool_call' WHEN 5 THEN 'unknown' ELSE 'reasoning' END AS event_type, CASE event_id % 6 WHEN 0 THEN '{\"agent\":\"a\",\"text\":\"t\"}' WHEN 1 THEN '{\"agent\":\"a\",\"reasoning\":\"r\"}' WHEN 2 THEN '{\"agent\":\"a\",\"step_start\":\"s\"}' WHEN 3 THEN '{\"agent\":\"a\",\"step_finish\":\"stop\"}' WHEN 4 THEN '{\"agent\":\"a\",\"tool\":\"grep\",\"args\":\"{\\\"q\\\":1}\",\"result\":\"out\"}' ELSE '{\"raw_type\":\"img\",\"raw\":\"{\\\"type\\\":\\\"img\\\"}\"}' END AS content, count(*) AS cnt FROM events GROUP BY 1, 2")(
    lambda s, d: eventlog.parts(t(s, d, "events").select(F.lit("a").alias("agent"), F.element_at(F.array(*[F.lit(x) for x in ('{"type":"text","text":"t"}', '{"type":"reasoning","text":"r"}', '{"type":"step-start","id":"s"}', '{"type":"step-finish","reason":"stop"}', '{"type":"tool","tool":"grep","args":{},"state":{"input":{"q":1},"output":"out"}}', '{"type":"img"}')]), (F.col("event_id") % 6 + 1).cast("int")).alias("part"))).groupBy("event_type", "content").agg(F.count("*").alias("cnt"))
)
query("events_after_id", "SELECT event_id, seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS seq FROM events) WHERE user_id = 8 AND event_id > 1000")(lambda s, d: _reversed(s, d))
query("events_oldest", "SELECT user_id, min(event_id) AS oldest_seq, count(*) AS held FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY 1")(lambda s, d: eventlog.oldest(t(s, d, "events"), "user_id", "event_id", 10))
query("audit_recent", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25")(lambda s, d: eventlog.recent(t(s, d, "events").select("event_id", "ts", F.col("event_type").alias("operation"), F.lit("ok").alias("status")), 25, operation="error").select("event_id"))


def _reversed(s, d):
    """Numbers that run against the ids, as where rows were written late."""
    log = tables.ranked(t(s, d, "events").withColumn("id", F.col("event_id")), ["user_id"], [F.desc("event_id")], "seq")
    return eventlog.after_id(log, "user_id", 8, 1000).select("event_id", F.col("seq").cast("long"))


# -- vectors and nodes ---------------------------------------------------------------

query("vector_count", "SELECT count(*) AS cnt FROM embeddings WHERE label = 3")(lambda s, d: tables.counted(t(s, d, "embeddings"), label=3, vec_id=None))
query("vector_page", "SELECT vec_id FROM embeddings WHERE label <> 3 AND vec_id > 40 ORDER BY vec_id LIMIT 30")(lambda s, d: tables.page(t(s, d, "embeddings").where("label <> 3"), "vec_id", 40, 30).select("vec_id"))
query("vector_upsert", "SELECT coalesce(n.vec_id, e.vec_id) AS vec_id, coalesce(n.label, e.label) AS label FROM embeddings e FULL JOIN (SELECT vec_id + 50 AS vec_id, label + 100 AS label FROM embeddings) n USING (vec_id)")(lambda s, d: tables.upsert(t(s, d, "embeddings").select("vec_id", "label", "embedding"), t(s, d, "embeddings").select((F.col("vec_id") + 50).alias("vec_id"), (F.col("label") + 100).alias("label"), "embedding"), ["vec_id"]).select("vec_id", "label"))
query("collection_stats", "SELECT label, count(*) AS points, 64 AS dims FROM embeddings GROUP BY 1")(lambda s, d: search.collections(t(s, d, "embeddings"), "label"))
query("search_hits_complete", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_mktsegment <> 'BUILDING'")(lambda s, d: search.complete(t(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("fqn")), ("name", "fqn")).select("c_custkey"))
query("search_without_vector", "SELECT p_partkey, round(1.0 - 0.01 * (r - 1), 2)::DOUBLE AS score FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS r FROM part WHERE p_name ILIKE '%ring%') WHERE r <= 10")(
    lambda s, d: search.semantic_or_keyword(t(s, d, "embeddings"), None, t(s, d, "part").select("p_partkey", "p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("b")), "ring", ("p_name",), "p_name", "b").select("p_partkey", "score")
)
query("embedding_cache", "SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS cached FROM documents")(lambda s, d: search.cached(t(s, d, "documents").select("doc_id", "text"), t(s, d, "documents").where("doc_id % 3 = 0").select(search.cache_key("m", "text").alias("cache_key"), F.array(F.lit(1.0)).alias("vector")), "m").select("doc_id", F.col("vector").isNotNull().alias("cached")))
query("node_overlay", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, c_mktsegment AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'b=2' ELSE 'b=1' END || CASE WHEN c_custkey % 3 = 0 THEN ',c=3' ELSE '' END AS props FROM customer")(lambda s, d: _overlay(s, d))


def _overlay(s, d):
    c = t(s, d, "customer")
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), one("b", 1).alias("props"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    new = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "new").alias("name"), F.lit(None).cast("string").alias("kind"), F.when(F.col("c_custkey") % 2 == 0, one("b", 2)).otherwise(empty).alias("props"))
    more = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), one("c", 3).alias("props"))
    out = tables.overlay(tables.overlay(old, new, ["id"]), more, ["id"])
    props = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return out.select("id", "name", "kind", props.alias("props"))


# -- items, files and the rest of the graph -----------------------------------------

query("items_to_files", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'src/' || n_name || '.rs' WHEN c_custkey % 3 = 1 THEN 'src/' || n_name || '.rs' ELSE 'src/' || r_name || '.rs' END AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(lambda s, d: _linked(s, d))


def _linked(s, d):
    """A third of the items know their file, the rest go by the longest module path that their name begins with."""
    n = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = lambda c: F.concat(F.lit("src/"), F.col(c), F.lit(".rs"))
    files = n.select(F.concat("r_name", F.lit("::"), "n_name").alias("module_path"), path("n_name").alias("file_path")).union(n.select("r_name", path("r_name")).distinct()).withColumn("id", F.xxhash64("file_path"))
    c = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    third = F.col("c_custkey") % 3
    items = c.select(F.col("c_custkey").alias("k"), F.when(third == 0, F.concat("r_name", F.lit("::elsewhere::f"))).when(third == 1, F.concat_ws("::", "r_name", "n_name", F.lit("deep"), F.lit("f"))).otherwise(F.concat_ws("::", "r_name", F.concat(F.col("n_name"), F.lit("x")), F.lit("f"))).alias("fqn"), F.when(third == 0, path("n_name")).alias("file_path"))
    return build.linked(items, files).join(files.select("id", F.col("file_path").alias("path")), F.col("source_file_id") == F.col("id")).select("k", "path")


query("graph_tree", GRAPH + f"SELECT fqn, label, CAST(len(string_split(fqn, '::')) - 1 AS INTEGER) AS depth, regexp_replace(fqn, '::', '/', 'g') AS path FROM nodes WHERE split_part(fqn, '::', 1) = '{CRATE}'")(lambda s, d: graph_of(s, d).tree(CRATE).select("fqn", "label", "depth", F.array_join(F.transform("path", lambda x: F.substring_index(x, "::", -1)), "/").alias("path")))
query("graph_pattern", GRAPH + f"SELECT DISTINCT a.name AS a_name, m.fqn AS m_fqn, tr.name AS t_name FROM nodes a JOIN edges e ON e.src = a.fqn AND e.rel = 'IMPLEMENTS' JOIN nodes tr ON tr.fqn = e.dst AND tr.label = 'Trait' JOIN edges c ON c.dst = a.fqn AND c.rel = 'CONTAINS' JOIN nodes m ON m.fqn = c.src WHERE a.label = 'Struct' AND starts_with(a.fqn, '{CRATE}::') AND tr.name = 'Brand#7'")(
    lambda s, d: _pattern(graph_of(s, d))
)
query("graph_count_label", GRAPH + "SELECT count(*) AS cnt FROM nodes WHERE label = 'Struct'")(lambda s, d: graph_of(s, d).query("count_by_label", label="Struct"))
query("graph_count_relationship", GRAPH + "SELECT count(*) AS cnt FROM edges WHERE rel = 'IMPLEMENTS'")(lambda s, d: graph_of(s, d).query("count_relationship", rel="IMPLEMENTS"))
query("graph_count_totals", GRAPH + "SELECT count(*) AS cnt FROM nodes UNION ALL SELECT count(*) FROM edges")(lambda s, d: graph_of(s, d).query("count_total_nodes").union(graph_of(s, d).query("count_total_relationships")))
query("graph_consistency_system", GRAPH + "SELECT count(*) AS cnt FROM nodes WHERE label IN ('Function','Struct','Enum','Trait','Impl','TypeAlias')")(lambda s, d: graph_of(s, d).consistency_count(merged=False))
query("semantic_search_limit", f"SELECT vec_id FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], [{','.join(map(str, VECTOR))}]::DOUBLE[]) DESC, vec_id LIMIT 3")(lambda s, d: search.semantic(t(s, d, "embeddings"), VECTOR, 3).select("vec_id"))


def _pattern(g):
    kids = ({"rel": "IMPLEMENTS"}, {"as": "t", "label": "Trait", "name": "Brand#7"})
    rows = g.pattern({"as": "m"}, ({"rel": "CONTAINS"}, {"as": "a", "label": "Struct", "fqn": f"{CRATE}::*"}), kids, returns=("a.name", "m.fqn", "t.name"))
    return rows

query("agg_crate_items", GRAPH + "SELECT split_part(fqn, '::', 1) AS crate, count(*) AS cnt FROM nodes GROUP BY 1")(lambda s, d: graph_of(s, d).nodes.groupBy(crate_of("fqn").alias("crate")).agg(F.count("*").alias("cnt")))
query("metric_lines", "SELECT 'events{event_type=\"' || event_type || '\",day=\"' || strftime(ts, '%d') || '\"} ' || count(*) AS line FROM events GROUP BY event_type, strftime(ts, '%d')")(lambda s, d: runs.metric_lines(t(s, d, "events").groupBy("event_type", F.date_format("ts", "dd").alias("day")).agg(F.count("*").alias("n")).withColumn("name", F.lit("events")), "name", "n", "event_type", "day"))
query("key_holder", "SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000007'")(lambda s, d: listing.key_holder(t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("key_hash"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("expires_at")), hashlib.sha256(b"Customer#000000007").hexdigest(), _now()).select("id"))
query("aggregate_search_source", f"WITH top AS (SELECT vec_id, label FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], [{','.join(map(str, VECTOR))}]::DOUBLE[]) DESC, vec_id LIMIT 10) SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN CAST(vec_id AS INTEGER) ELSE label END AS label, text AS body_source FROM top LEFT JOIN documents ON doc_id = vec_id")(
    lambda s, d: search.aggregate(t(s, d, "embeddings"), t(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("int")).alias("label"), F.col("text").alias("body_source")), None, VECTOR, source="body_source").drop("score")
)
