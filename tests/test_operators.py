import decimal
import uuid

import pytest
from pyspark.sql import functions as F

from quarry import suite
from quarry.functions import chunks
from quarry.functions import scalar as S
from quarry.operators import eventlog, tables
from quarry.plans import sqlgate


def test_scalars(spark):
    df = spark.createDataFrame([("customer",), ("ä" * 300,), ("",)], "t string")
    rows = df.select("t", S.uuid5("t").alias("u"), S.clip_bytes("t").alias("c")).collect()
    for r in rows:
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["t"]))
    assert rows[1]["c"] == "ä" * 250 + "..."
    assert spark.createDataFrame([("x" + "ä" * 300,)], "t string").select(S.clip_bytes("t")).first()[0] == "x" + "ä" * 249 + "..."


def test_body_preview(spark):
    long = "\n".join(f"l{i}" for i in range(60))
    a, b = (r[0] for r in spark.createDataFrame([("x\ny",), (long,)], "t string").select(S.body_preview("t")).collect())
    assert a == "   1: x\n   2: y"
    assert b.split("\n")[13] == "  ... (40 lines omitted) ..." and len(b.split("\n")) == 21


def test_jaro_winkler():
    pairs = [("", "", 1.0), ("a", "", 0.0), ("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("dwayne", "duane", 0.84), ("abc", "xyz", 0.0), ("naïve é", "naive é", 0.92381), ("x" * 300, "x" * 300, 1.0)]
    got = S.jaro_winkler_of([a for a, _, _ in pairs], [b for _, b, _ in pairs])
    assert all(abs(g - w) < 1e-6 for g, (_, _, w) in zip(got, pairs)), got


def test_chunks():
    assert chunks.text_chunks(None) == [] and chunks.text_chunks("a\n\nb") == ["a\n\nb"]
    long = ". ".join("word" * 10 for _ in range(40)) + "."
    assert all(len(c.encode()) <= 500 for c in chunks.text_chunks(long))
    assert chunks.text_chunks("a" * 200 + "\n\n" + "b" * 298 + "\n\nc") == ["a" * 200 + "\n\n" + "b" * 298, "c"]
    assert chunks.text_chunks("p\n\n" + "s. " * 200 + "\n\nq")[0] == "p" and chunks.text_chunks("p\n\n" + "s. " * 200 + "\n\nq")[-1] == "q"
    assert chunks.filled([3, 3, 3, 9, 1], 6) == [(0, 2), (2, 3), (3, 4), (4, 5)] and chunks.filled([], 5) == []
    assert chunks.markdown_chunks("# A\n" + "x" * 300 + "\n## B\nshort", "d/f.md") == [("A / B", "File: d/f.md > A\n\n# A\n" + "x" * 300 + "\n\n## B\nshort")]
    long = "\n\n".join("y" * 1000 for _ in range(4))
    assert [len(c) for _, c in chunks.markdown_chunks("intro\n# H\n" + long, "f.md")] == [len("File: f.md\n\nintro"), len("File: f.md > H\n\n# H\n") + 2002, len("File: f.md > H\n\n") + 2002]
    assert chunks.html_chunks("Short. " + "w" * 600 + ". " + "End of it is here, at long last. More.") == ["w" * 600 + ".", "End of it is here, at long last. More."]


def test_html_sections(spark):
    pages = [
        "<h1>T</h1><p>a</p><script>if (x < 3) { '</p>' }</script><h2>U</h2>b", "lead <b>x</b> &amp; y<!-- <h1>no</h1> --><H3 class='q'>One <i>two</i></H3> z &lt;p&gt;", "<head><h1>no</h1></head><h4></h4>t<h2>K</h2>u<h2></h2>v",
        None, "", "<nav>a<nav>", "<header>seen</header>&nbsp; w<footer>x</footer>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, p string")
    got: dict = {}
    for r in chunks.sections(df, "k", "p").orderBy("k", "section").collect():
        got.setdefault(r.k, []).append((r.heading, r.text))
    assert got == {0: [("T", "a"), ("U", "b")], 1: [("", "lead x & y"), ("two", "z <p>")], 2: [("", "t"), ("K", "u"), ("K", "v")], 6: [("", "seen w")]}


def test_upsert_and_stale(spark):
    old = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "k int, v string, src string")
    new = spark.createDataFrame([(2, None, None), (3, "c", None)], "k int, v string, src string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], ("src",)).collect()) == [(1, "a", "s"), (2, None, "s"), (3, "c", None)]
    assert tables.stale(old, old.where("false"), "k").count() == 0
    assert [r[0] for r in tables.stale(old, new, "k").collect()] == [1]


def test_log_has_no_gaps(spark):
    e = spark.createDataFrame([(1, i, f"c{i % 7}") for i in range(20)], "x int, id long, h string")
    log = eventlog.append(e.union(e.limit(5)), "x", "id", "h")
    assert sorted(r["seq"] for r in log.collect()) == list(range(1, 8))
    assert eventlog.gaps(log, "x").count() == 0 and eventlog.after(log, "x", 1, 99).count() == 0


def test_ordered_scans_cross_partitions(spark):
    """A key that fills many partitions, keys within one, and a null key: previous rows and running values as a window per key gives them."""
    from pyspark.sql import Window

    from quarry.operators import ordered

    rows = [(0 if i % 3 else i % 11, i, i % 7 - 3) for i in range(600)] + [(None, i, 1) for i in range(5)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        r = ordered.ranged(df, "k", "o")
        assert r.select(F.shiftright("_i", 33)).distinct().count() > 2
        out = ordered.running(ordered.running(ordered.previous(r, "k", "o", "v"), "k", F.col("v"), "s"), "k", F.col("v"), "m", most=True)
        w = Window.partitionBy("k").orderBy("o")
        want = df.select("k", "o", F.lag("o").over(w).alias("po"), F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
        assert sorted(map(str, out.select("k", "o", F.col("_was.o").alias("po"), "s", "m").collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_circuit_breaker_against_a_plain_loop(spark):
    import random

    import numpy as np

    from quarry.operators import runs

    rng = random.Random(5)
    for _ in range(200):
        t = np.cumsum([rng.randint(0, 9) for _ in range(60)])
        good = np.array([rng.random() < 0.4 for _ in t])
        allowed, opened, held = np.ones(60, bool), np.zeros(60, bool), (False, 0, 0)
        cuts = sorted(rng.sample(range(61), 3))
        for x, y in zip([0, *cuts], [*cuts, 60]):
            held = runs.settled(t[x:y], good[x:y], allowed[x:y], opened[x:y], *held, 3, 20)
        state, bad, since = False, 0, 0
        for i in range(60):
            go = not state or t[i] - since >= 20
            if go and good[i]:
                state, bad = False, 0
            elif go:
                bad += 1
                if state or bad >= 3:
                    state, since = True, t[i]
            assert (allowed[i], opened[i]) == (go, state)
        assert held[0] == state


def test_sql_gate(spark):
    spark.range(3).createOrReplaceTempView("ok")
    spark.range(3).createOrReplaceTempView("secret")
    assert sqlgate.sql(spark, "WITH c AS (SELECT id AS last_update FROM ok) SELECT * FROM c WHERE last_update < :n", ["ok"], {"n": 2}).count() == 2
    for q in ("SELECT * FROM ok, secret", "SELECT * FROM ok WHERE id IN (SELECT id FROM secret)", "CREATE TABLE x AS SELECT 1", "DROP TABLE ok", "INSERT INTO ok VALUES (1)"):
        with pytest.raises(sqlgate.NotAllowed):
            sqlgate.sql(spark, q, ["ok"])


def test_sql_gate_knows_functions_and_recursion(spark):
    spark.range(3).createOrReplaceTempView("ok")
    for q in (
        "SELECT java_method('java.lang.System', 'getenv', 'PATH')", "SELECT reflect('java.lang.System', 'getenv', 'PATH') FROM ok",
        "SELECT id FROM ok WHERE length(try_reflect('java.lang.System', 'getenv', 'PATH')) > 0", "SELECT upper(java_method('a', 'b')) FROM ok",
        "SELECT * FROM (SELECT max(reflect('a', 'b')) OVER (PARTITION BY id) FROM ok)", "SELECT id, (SELECT input_file_name()) FROM ok", "SELECT * FROM stack(1, reflect('a', 'b'))",
        "SELECT * FROM ok LATERAL VIEW stack(1, 2) t AS x", "SELECT * FROM ok ORDER BY java_method('a', 'b')", "SELECT count(*) FROM ok GROUP BY id HAVING reflect('a', 'b') = '1'",
    ):
        with pytest.raises(sqlgate.NotAllowed):
            sqlgate.sql(spark, q, ["ok"])
    q = "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 4) SELECT sum(n) AS s FROM c JOIN ok ON n > id"
    assert sqlgate.sql(spark, q, ["ok"]).first()["s"] == 26
    assert sqlgate.tables_of(spark, "SELECT * FROM range(3) LEFT JOIN ok USING (id) WHERE EXISTS (SELECT 1 FROM other)") == {"ok", "other"}
    assert sqlgate.sql(spark, "SELECT x, round(avg(id), 1) AS a FROM ok LATERAL VIEW explode(array(1, 2)) t AS x GROUP BY x", ["ok"]).count() == 2


def test_sql_names_are_compared_part_by_part(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("ok")
    path = str(tmp_path / "x.parquet")
    spark.range(7).write.parquet(path)
    spark.range(2).createOrReplaceGlobalTempView("hidden")
    for q in (
        f"WITH `parquet.{path}` AS (SELECT 1 AS x) SELECT * FROM parquet.`{path}`", f"SELECT * FROM parquet.`{path}`", "WITH `global_temp.hidden` AS (SELECT 1) SELECT * FROM global_temp.hidden", "SELECT * FROM default.ok",
        f"WITH c AS (SELECT * FROM parquet.`{path}`) SELECT * FROM c", "WITH c AS (SELECT 1) SELECT * FROM (SELECT * FROM x.c)", f"SELECT (SELECT max(id) FROM parquet.`{path}`) FROM ok", f"SELECT * FROM ok WHERE EXISTS (SELECT 1 FROM parquet.`{path}` p)",
    ):
        with pytest.raises(sqlgate.NotAllowed):
            sqlgate.sql(spark, q, ["ok", f"parquet.{path}"])
        with pytest.raises(sqlgate.NotAllowed):
            sqlgate.scoped(spark, q, {}, {"ok": spark.range(3)}, "w1")
    spark.range(3).createOrReplaceTempView("ok")
    assert sqlgate.sql(spark, "SELECT * FROM global_temp.hidden", ["global_temp.hidden"]).count() == 2
    assert sqlgate.sql(spark, "WITH `a.b` AS (SELECT * FROM ok) SELECT * FROM `a.b`", ["ok"]).count() == 3
    assert sqlgate.tables_of(spark, "SELECT * FROM parquet.`/x`, ok") == {"parquet.`/x`", "ok"}
    spark.catalog.dropGlobalTempView("hidden")


def test_sql_of_a_tenant(spark):
    items = spark.createDataFrame([("w1", 1), ("w2", 2), ("w1", 3)], "workspace_id string, k int")
    shared, hidden = spark.createDataFrame([(9,)], "k int"), spark.createDataFrame([("w1", 4)], "workspace_id string, k int")
    q = "SELECT k FROM items UNION ALL SELECT k FROM plans"
    out = sqlgate.scoped(spark, q, {"items": items}, {"items": shared, "plans": shared}, "w1")
    assert sorted(r.k for r in out.collect()) == [1, 3, 9]
    assert not spark.catalog.tableExists("items")
    hidden.createOrReplaceTempView("secrets")
    with pytest.raises(sqlgate.NotAllowed):
        sqlgate.scoped(spark, "SELECT * FROM secrets", {"items": items}, {}, "w1")


def test_sql_stops_in_time(spark):
    assert sqlgate.rows(spark.range(2)) == ['{"id":0}', '{"id":1}']
    slow = spark.range(0, 8, 1, 8).select((F.col("id") + F.expr("java_method('java.lang.Thread', 'sleep', 20000L)").isNotNull().cast("int")).alias("x"))
    with pytest.raises(TimeoutError):
        sqlgate.rows(slow, seconds=1.0)
    assert sqlgate.rows(spark.range(1)) == ['{"id":0}']


def test_streaming_matches_batch(spark, tmp_path):
    from quarry.streaming import tail

    e = spark.range(200).select("id", (F.col("id") % 5).alias("user"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 10)).alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    s = tail.tail(spark, str(tmp_path / "in"), e.schema)
    q = tail.tumbling(tail.timed(s, "ts", "1 minute"), "ts", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("cnt")).first()[0] == 200
    q = tail.rate_limit(s, "user", "ts", 2, 600).writeStream.format("memory").queryName("r").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = eventlog.rate_limited(e, "user", "ts", 2, 600).groupBy("user").agg(F.count_if("allowed").alias("passed"))
    assert sorted(map(tuple, spark.table("r").select("user", "passed").collect())) == sorted(map(tuple, batch.collect()))


def test_evaluation_of_the_whole_table(spark):
    duckdb, d = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{d}/lineitem.parquet'")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert sum(r.runs for r in suite.QUERIES["eval_cases"](spark, d).collect()) == rows
    for name in ("eval_cases", "eval_suites", "eval_compare"):
        got = suite.QUERIES[name](spark, d)
        want = con.execute(suite.SQL[name])
        at = [got.columns.index(c[0]) for c in want.description]
        show = lambda r: [round(float(x), 4) + 0.0 if isinstance(x, (float, decimal.Decimal)) else x for x in r]
        assert sorted(map(str, (show([r[i] for i in at]) for r in got.collect()))) == sorted(map(str, map(show, want.fetchall()))), name
