"""Stored layouts: what is read and rewritten, and that results are those of the plain operators; sinks that are asked twice."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import search, stored, tables
from quarry.plans import adjacent
from quarry.plans.graph import Graph
from quarry.streaming import sinks

random.seed(3)


def files(path):
    import glob

    return {f for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_an_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, f"n{i}", "s" if i % 2 else None) for i in range(200)], "k long, name string, src string")
    table = stored.Keyed(spark, path, ["k"], 16).create(old)
    before = files(path)
    new = spark.createDataFrame([(3, "new", None), (900, "more", "x")], "k long, name string, src string")
    want = sorted(map(str, tables.upsert(old, new, ["k"], ("src",)).collect()))
    touched = table.upsert(new, ("src",))
    assert 1 <= len(touched) <= 2 and sorted(map(str, table.rows().collect())) == want
    kept = {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched}
    assert kept <= files(path) and len(kept) >= 14
    assert table.upsert(new, ("src",)) == touched and sorted(map(str, table.rows().collect())) == want  # again
    assert table.upsert(new.where("false")) == []
    # A bucket that loses all its rows.
    gone = table._stored().where(F.col("_bucket") == touched[0]).select("k")
    n = gone.count()
    assert table.delete(gone) == [touched[0]] and table.rows().count() == 201 - n
    over = spark.createDataFrame([(5, None, "late")], "k long, name string, src string")
    table.overlay(over)
    assert [tuple(r) for r in table.rows().where("k = 5").collect()] in ([(5, "n5", "late")], [])


def test_cells_find_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 8)) * 3
    rows = [(i, [float(x) for x in middle[i % 20] + rng.normal(size=8) * 0.2]) for i in range(2000)] + [(5000, None), (5001, [0.0] * 8), (5002, [float(x) for x in middle[0]])]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = stored.Vectors(points, str(tmp_path / "v"), cells=20, sample=500)
    hits = 0
    for q in [middle[3], -middle[5], rng.normal(size=8), rng.normal(size=8)]:
        q = [float(x) for x in q]
        want = [(r.vec_id, round(r.score, 9)) for r in search.semantic(points, q, 12).collect()]
        assert [(r.vec_id, round(r.score, 9)) for r in index.search(q, 12, probes=2).collect()] == want
        hits += len({r.vec_id for r in index.search(q, 12, probes=6, exact=False).collect()} & {i for i, _ in want})
    assert hits >= 0.9 * 48
    index.search([float(x) for x in middle[3]], 5, probes=2)
    assert len(index.read) < 10
    assert index.search([float(x) for x in middle[3]], 3000).count() == 2001


def test_trigrams_find_what_like_finds(spark, tmp_path):
    words = ["Polished", "ring", "Ärger", "brass", "strIng", "on", "a_b", "50%"]
    rows = [(i, " ".join(random.choices(words, k=3)) if i % 9 else None, random.choice(words)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    index = stored.Trigrams(df, str(tmp_path / "g"), "k", ("a", "b"), 8)
    for q in ("ring", "RING", "r_ng", "ol%shed", "ärger", "on", "", "zzz", "shed br", "%", "s r"):
        hit = F.coalesce(F.col("a").ilike(f"%{q}%"), F.lit(False)) | F.coalesce(F.col("b").ilike(f"%{q}%"), F.lit(False))
        assert sorted(map(str, index.like(q).collect())) == sorted(map(str, df.where(hit).collect())), q
    assert stored.Trigrams.grams("on") == [] and index.candidates("on") is None and stored.Trigrams.grams("r_ngs%abcd") == ["abc", "bcd", "ngs"]
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket#\d+ (IN|INSET|=)", index.candidates("ring")._jdf.queryExecution().executedPlan().toString())


def test_hops_do_not_shuffle_edges(spark, tmp_path):
    edges = [(f"n{random.randrange(300)}", f"n{random.randrange(300)}", "CALLS") for _ in range(2000)]
    g = Graph(spark.createDataFrame([(f"n{i}", f"x{i % 50}", "Function", "f", 1) for i in range(300)], "fqn string, name string, label string, file_path string, start_line int"), spark.createDataFrame(edges, "src string, dst string, rel string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    h = adjacent.stored(g, str(tmp_path / "a"), 4)
    try:
        for back in (False, True):
            seeds = h.nodes.where("name = 'x7'")
            near = h.hop(seeds, ("CALLS",), back)
            plan = near._jdf.queryExecution().executedPlan().toString()
            join = plan[plan.index("SortMergeJoin") :]
            side = join[: join.index("Exchange")] if "Exchange" in join else join
            assert "SelectedBucketsCount: 4 out of 4" in side  # the edges come first, and no exchange stands above them
            assert sorted(r.fqn for r in near.collect()) == sorted(r.fqn for r in g.hop(g.named("x7"), ("CALLS",), back).collect())
        assert sorted(map(str, h.callers("x7", 3).collect())) == sorted(map(str, g.callers("x7", 3).collect()))
        assert sorted(map(str, h.callees("x7").collect())) == sorted(map(str, g.callees("x7").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        h.drop()


def test_cache_expires_and_evicts(spark):
    at = lambda x: F.timestamp_seconds(F.lit(x))
    made = lambda rows, kind, *ts: spark.createDataFrame(rows, kind).select("*", *[F.timestamp_seconds(c).alias(n) for c, n in ts]).drop(*[c for c, _ in ts])
    cache = made([("a", 1, 0, 90), ("b", 2, 50, 60), ("c", 3, 50, 55)], "cache_key string, vector int, i int, u int", ("i", "inserted"), ("u", "used"))
    asked = made([("a", 100), ("b", 101), ("d", 102), ("d", 103)], "cache_key string, t int", ("t", "ts"))
    found = stored.looked_up(asked, cache, at(100), 100)
    assert sorted((r.cache_key, r.vector or 0) for r in found.collect()) == [("a", 0), ("b", 2), ("d", 0), ("d", 0)]
    fresh = spark.createDataFrame([("a", 10), ("d", 40), ("d", 40)], "cache_key string, vector int")
    after = stored.refreshed(cache, asked, fresh, at(100), 100, 3).collect()
    assert [(r.cache_key, r.vector) for r in after] == [("d", 40), ("b", 2), ("a", 10)]  # c was used least recently


def test_a_batch_that_is_run_again_is_there_once(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([(i, f"x{i % 3}") for i in range(150)] + [(1, "x1")], "id long, what string")
    for _ in range(2):
        sinks.put(rows, 0, path, key="id")
    sinks.put(rows.where("id < 10").withColumn("what", F.lit("late")), 1, path, key="id")
    assert sinks.entries(spark, path).count() == 160 and sinks.entries(spark, path, "id").where("what = 'late'").count() == 0
    assert sinks.entries(spark, path, "id").count() == 150
    parts = list((tmp_path / "audit" / "batch=0").glob("*.parquet"))
    assert max(spark.read.parquet(str(p)).count() for p in parts) <= sinks.AUDIT_ROWS


def test_jobs_run_on_a_clock(spark, tmp_path):
    q = sinks.scheduled(spark, "1 second", {"gauges": lambda: spark.range(3).withColumn("v", F.lit(1.0)), "leaks": lambda: spark.range(1)}, str(tmp_path / "out"), str(tmp_path / "mark"))
    try:
        end = time.time() + 60
        while time.time() < end and len(list((tmp_path / "out").glob("leaks/batch=*/_SUCCESS"))) < 3:
            time.sleep(0.3)
    finally:
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out" / "gauges")).groupBy("tick").count().collect()
    assert len(got) >= 2 and all(r["count"] == 3 for r in got)
