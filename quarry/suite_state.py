"""Queries on stored layouts, on progress and on streams, and SQL to hold them against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import locate, progress, search, stored
from .plans import adjacent
from .plans.lineage import cut, folder
from .streaming import sinks, stateful, tail
from .suite import NAME, PREFIX, SQL, VECTOR, graph_of, query, t
from .suite import _score as scored
from .suite_ops import CHAIN

# -- stored layouts ----------------------------------------------------------------


def _upserted(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("src"))
    table = stored.Keyed(s, folder(s, "keyed"), ["k"], 32).create(c)
    changed = t(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k"), F.concat(F.lit("new "), "c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("S")).alias("src"))
    more = t(s, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("src"))
    table.upsert(changed, ("src",))
    table.upsert(more)
    table.upsert(more)  # again, as after a failure
    table.delete(t(s, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("k")))
    return table.rows()


query("upsert_touched", "SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 THEN 'new ' || c_name ELSE c_name END AS name, CASE WHEN c_nationkey = 3 AND c_custkey % 2 = 0 THEN 'S' ELSE c_mktsegment END AS src FROM customer WHERE c_nationkey <> 5 UNION ALL SELECT s_suppkey + 10000000, s_name, 'supplier' FROM supplier")(_upserted)
query("semantic_search_cells", SQL["semantic_search"])(lambda s, d: scored(stored.Vectors(t(s, d, "embeddings"), folder(s, "cells"), 16).search(VECTOR)))


def _postings(s, d):
    p = t(s, d, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("b"), "p_brand", "p_type")
    hit = stored.Trigrams(p, folder(s, "grams"), "p_partkey", ("p_name", "p_type")).like("ring")
    return search.keyword(hit, "ring", ("p_name", "p_type"), "p_name", "b").drop("b")


query("keyword_search_postings", SQL["keyword_search"])(_postings)
query("like_postings", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ll_b%lt%' OR p_type ILIKE '%ll_b%lt%' UNION ALL SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%Economy%' OR p_type ILIKE '%Economy%'")(lambda s, d: _likes(s, d))


def _likes(s, d):
    index = stored.Trigrams(t(s, d, "part").select("p_partkey", "p_name", "p_type"), folder(s, "grams"), "p_partkey", ("p_name", "p_type"))
    return index.like("ll_b%lt").union(index.like("Economy")).select("p_partkey", "p_name")


_bucketed: dict[tuple, adjacent.Adjacent] = {}


def bucketed(s, d):
    """graph_of() with its edges bucketed by both ends, stored once for each graph."""
    g = graph_of(s, d)
    if (s.sparkContext.applicationId, d, id(g)) not in _bucketed:
        _bucketed[s.sparkContext.applicationId, d, id(g)] = adjacent.stored(g, folder(s, "adjacent"), 16)
    return _bucketed[s.sparkContext.applicationId, d, id(g)]


query("graph_callers_bucketed", SQL["graph_callers"])(lambda s, d: bucketed(s, d).callers(NAME, 3))
query("graph_callers_for_prefix_bucketed", SQL["graph_callers_for_prefix"])(lambda s, d: bucketed(s, d).callers_for_prefix(PREFIX, 2))

# -- a cache of query vectors, before and after a day of requests --------------------

TTL, CAPACITY = 5 * 86400, 40
CACHE = f"""WITH c AS (SELECT 'k' || user_id AS k, min(event_id) AS v, min(ts) AS inserted, max(ts) AS used FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), n AS (SELECT TIMESTAMP '2024-01-10' AS now),
 r AS (SELECT 'k' || (user_id * 2) AS k, event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'), live AS (SELECT c.* FROM c, n WHERE inserted + INTERVAL {TTL} SECOND > now)
"""


def _cache(s, d):
    e = t(s, d, "events")
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    day, next_day = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-11 00:00:00"))
    cache = e.where(F.col("ts") < day).groupBy(key(F.col("user_id")).alias("cache_key")).agg(F.min("event_id").alias("vector"), F.min("ts").alias("inserted"), F.max("ts").alias("used"))
    asked = e.where((F.col("ts") >= day) & (F.col("ts") < next_day)).select(key(F.col("user_id") * 2).alias("cache_key"), "event_id", "ts")
    return cache, asked, day


query("cache_lookup", CACHE + "SELECT event_id, r.k AS cache_key, v AS vector FROM r LEFT JOIN live ON live.k = r.k")(lambda s, d: stored.looked_up(*(lambda c, r, now: (r, c, now))(*_cache(s, d)), TTL).select("event_id", "cache_key", "vector"))
query("cache_refreshed", CACHE + f""", u AS (SELECT k, min(ts) AS a, max(ts) AS b, min(event_id) AS e FROM r GROUP BY k), x AS (SELECT live.k, v, inserted, greatest(used, b) AS used FROM live LEFT JOIN u ON u.k = live.k UNION ALL SELECT k, -e, a, b FROM u WHERE k NOT IN (SELECT k FROM live))
 SELECT k AS cache_key, v AS vector, strftime(inserted, '%Y-%m-%d %H:%M:%S') AS inserted, strftime(used, '%Y-%m-%d %H:%M:%S') AS used FROM x ORDER BY x.used DESC, k LIMIT {CAPACITY}""")(lambda s, d: _refreshed(s, d))


def _refreshed(s, d):
    cache, asked, now = _cache(s, d)
    missing = stored.looked_up(asked, cache, now, TTL).where("vector IS NULL").groupBy("cache_key").agg(F.negative(F.min("event_id")).alias("vector"))
    out = stored.refreshed(cache, asked, missing, now, TTL, CAPACITY)
    return out.select("cache_key", "vector", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("inserted", "used")])


# -- progress -----------------------------------------------------------------------

LOG = "SELECT 'r' || user_id AS run_id, event_type AS last_stage, CAST(user_id % 8 AS INTEGER) AS batch, event_type = 'purchase' AS cleared, event_id AS seq FROM events"


def _log(s, d):
    return t(s, d, "events").select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("last_stage"), (F.col("user_id") % 8).cast("int").alias("batch"), (F.col("event_type") == "purchase").alias("cleared"), F.col("event_id").alias("seq"))


query("checkpoint_latest", f"SELECT * FROM (SELECT run_id, arg_max(last_stage, seq) AS last_stage, arg_max(batch, seq) AS batch, arg_max(cleared, seq) AS cleared, max(seq) AS seq FROM ({LOG}) GROUP BY run_id) WHERE NOT cleared")(lambda s, d: progress.latest(_log(s, d)))
query("checkpoint_resumable", f"SELECT run_id, last_stage, seq FROM ({LOG}) l WHERE seq = (SELECT max(seq) FROM ({LOG}) m WHERE m.run_id = l.run_id) AND NOT cleared ORDER BY seq DESC LIMIT 1")(lambda s, d: progress.resumable(_log(s, d)).select("run_id", "last_stage", "seq"))
query("checkpoint_completed", f"SELECT DISTINCT last_stage, batch FROM ({LOG}) WHERE run_id = 'r12' AND seq > coalesce((SELECT max(seq) FROM ({LOG}) WHERE run_id = 'r12' AND cleared), -1)")(lambda s, d: progress.completed(_log(s, d), "r12"))


class _Stopped(Exception):
    pass


def _resumed(s, d):
    """Documents through three stages, stopped in the second and gone on with by a new run object that only knows the log."""
    docs = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text", "source")
    left = [2]

    def second(rows):
        if left[0] == 0:
            left[0] = -1
            raise _Stopped
        left[0] -= 1
        return rows.where("n > 50")

    stages = [("parse", lambda r: r.select("file_path", "source", F.size(F.split("text", " ")).alias("n"))), ("extract", second), ("count", lambda r: r.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("words")))]
    root = folder(s, "progress")
    try:
        progress.Run(s, root, f"run-{uuid.uuid4().hex}", stages, batches=4).go(docs)
    except _Stopped:
        pass
    found = progress.resumable(progress.checkpoints(s, root)).first()
    out = progress.Run(s, root, found["run_id"], stages, batches=4).go(docs)
    return out.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))


query("resumed_run", "SELECT source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM (SELECT source, len(string_split(text, ' ')) AS n FROM documents) WHERE n > 50 GROUP BY source")(_resumed)

# -- items of two finders --------------------------------------------------------------

SPANS = "WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'f' || l_suppkey AS f, 'n' || (l_partkey % 9) AS name, l_partkey % 997 AS s, l_partkey % 997 + CAST(l_quantity AS BIGINT) AS e FROM li WHERE l_linenumber % 2 = 1), b AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'f' || l_suppkey AS f, 'n' || (l_partkey % 9) AS name, l_partkey % 991 AS s, l_partkey % 991 + CAST(l_quantity AS BIGINT) % 7 AS e FROM li WHERE l_linenumber % 2 = 0)"


def _spans(s, d):
    li = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").cast("long").alias("q"))
    li = cut(li)  # read by each side several times

    def side(odd, m, length):
        rows = li.where(F.col("l_linenumber") % 2 == odd)
        own = F.col("l_partkey") % m
        return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file_path"), F.concat(F.lit("n"), (F.col("l_partkey") % 9).cast("string")).alias("name"), own.alias("start_line"), (own + length).alias("end_line"), F.when(F.lit(bool(odd)) & (F.col("l_partkey") % 2 == 0), F.lit("")).otherwise(F.concat(F.lit("doc "), F.col("l_orderkey").cast("string"))).alias("doc"))

    return side(1, 997, F.col("q")), side(0, 991, F.col("q") % 7)


query("item_overlaps", SPANS + " SELECT f AS file_path, count(*) AS pairs, CAST(sum(i) AS BIGINT) AS i, CAST(sum(j) AS BIGINT) AS j FROM (SELECT a.f, a.id AS i, b.id AS j FROM a JOIN b ON a.f = b.f AND a.s <= b.e AND b.s <= a.e) GROUP BY f")(
    lambda s, d: locate.overlaps(*_spans(s, d), with_file=True).groupBy(F.col("file").alias("file_path")).agg(F.count("*").alias("pairs"), F.sum("i").alias("i"), F.sum("j").alias("j"))
)
query("items_merged", SPANS.replace("AS e FROM li WHERE l_linenumber % 2 = 1", "AS e, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'doc ' || l_orderkey END AS doc FROM li WHERE l_linenumber % 2 = 1").replace("AS e FROM li WHERE l_linenumber % 2 = 0", "AS e, 'doc ' || l_orderkey AS doc FROM li WHERE l_linenumber % 2 = 0") + """, p AS (SELECT a.id AS i, b.id AS j, a.name = b.name AS same, b.doc, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM a JOIN b ON a.f = b.f AND a.s <= b.e AND b.s <= a.e),
 o AS (SELECT i, arg_max(doc, (shared, -j)) AS doc FROM p WHERE same GROUP BY i) SELECT id, CASE WHEN a.doc = '' THEN coalesce(o.doc, '') ELSE a.doc END AS doc, false AS partial FROM a LEFT JOIN o ON i = id UNION ALL SELECT id, doc, true FROM b WHERE id NOT IN (SELECT j FROM p)""")(
    lambda s, d: locate.merged(*_spans(s, d)).select("id", "doc", "partial")
)

# -- streams -----------------------------------------------------------------------------


def _sliced(s, d, *cols, slices=4):
    """The events as files in order of time, one a batch: the stream and its folder."""
    path = folder(s, "events")
    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(*cols)
    us = F.unix_micros("ts")
    at = e.agg(F.percentile_approx(us, [i / slices for i in range(1, slices)], 1000)).first()[0]
    for i, (a, b) in enumerate(zip([None, *at], [*at, None])):
        part = e.where((us > a) if a is not None else F.lit(True)).where((us <= b) if b is not None else F.lit(True))
        part.coalesce(1).write.parquet(f"{path}/{i:03d}")
    return s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), path


def _streamed(s, d, op, *cols):
    """What op makes of the events as a stream, once all is read."""
    stream, path = _sliced(s, d, *cols)
    before = s.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.with_state_store(s)
    try:
        tail.drain(op(stream), f"{path}-out", f"{path}-mark")
    finally:
        s.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return s.read.parquet(f"{path}-out")


query("stream_rate_limit", SQL["events_rate_limit"])(lambda s, d: _streamed(s, d, lambda e: stateful.rate_limited(e, "user_id", "ts", 2, 86400), "user_id", "ts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
query("stream_breaker", SQL["circuit_breaker"])(
    lambda s, d: _streamed(s, d, lambda e: stateful.breaker(e.withColumn("ok", ~F.col("event_type").isin("error", "click")), "user_id", "ts", "ok", rest=20 * 3600), "user_id", "ts", "event_type").where("state <> 'half_open'").groupBy("user_id", "allowed", "state").agg(F.count("*").alias("cnt"))
)
query("stream_sessions", CHAIN.rstrip().rstrip(",").replace("WITH RECURSIVE", "WITH") + """, g AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 43200000000 THEN 0 ELSE 1 END AS new FROM e))
 SELECT user_id, min(us) AS start, max(us) AS last, count(*) AS cnt FROM g GROUP BY user_id, g HAVING max(us) + 43200000000 <= (SELECT max(us) FROM e)""")(
    lambda s, d: _streamed(s, d, lambda e: stateful.expired_sessions(e, "user_id", "ts", 43200), "user_id", "ts").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "cnt")
)


def _audited(s, d):
    path = folder(s, "audit")
    stream, _ = _sliced(s, d, "event_id", "event_type", "ts")
    for _ in range(2):  # a second start goes on behind the first and adds nothing
        sinks.audited(stream.select("event_id", "event_type"), path, f"{path}-mark", key="event_id").awaitTermination()
    return sinks.entries(s, path, "event_id").groupBy("event_type").agg(F.count("*").alias("cnt"), F.sum("event_id").alias("ids"))


query("stream_audit", "SELECT event_type, count(*) AS cnt, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")(_audited)
