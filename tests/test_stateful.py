"""Stream state with timers against the batch operators, for any cut of ordered rows into batches; progress; items by location."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import eventlog, locate, progress, runs
from quarry.streaming import stateful, tail

random.seed(9)


@pytest.fixture(scope="module")
def state(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield stateful.with_state_store(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def rows_of(spark):
    out, at = [], 0
    for i in range(300):
        at += random.choice([0, 1, 1, 2, 5, 40])
        out.append((i, random.choice("abc"), at, random.random() < 0.4))
    return spark.createDataFrame(out, "id long, k string, secs int, ok boolean").withColumn("ts", F.timestamp_seconds("secs"))


def streamed(spark, df, op, tmp_path, cuts):
    """op over df as a stream of files, one for each stretch of rows between the cuts."""
    path, schema = str(tmp_path / "in"), df.schema
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 10**9])):
        df.where(F.col("id").between(a, b - 1)).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    tail.drain(op(s), str(tmp_path / "out"), str(tmp_path / "mark"))
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.mark.parametrize("cuts", [[], [17, 90, 91, 230]])
def test_limiter_and_breaker_equal_the_batch_operators(state, tmp_path, cuts):
    df = rows_of(state)
    want = sorted(map(tuple, eventlog.rate_limited(df, "k", "ts", 3, 20).collect()))
    got = streamed(state, df, lambda s: stateful.rate_limited(s, "k", "ts", 3, 20), tmp_path / "l", cuts)
    assert sorted(map(tuple, got)) == want
    want = sorted((r.k, r.ts, r.ok, r.allowed, r.state) for r in runs.breaker(df, "k", "ts", "ok", 3, 15.0).collect())
    got = streamed(state, df, lambda s: stateful.breaker(s, "k", "ts", "ok", 3, 15.0), tmp_path / "b", cuts)
    assert sorted((r.k, r.ts, r.ok, r.allowed, r.state) for r in got if r.state != "half_open") == want
    if cuts:
        assert any(r.state == "half_open" and r.ok is None for r in got)


@pytest.mark.parametrize("cuts", [[], [40, 41, 200]])
def test_sessions_expire_by_timers(state, tmp_path, cuts):
    df = rows_of(state).union(state.createDataFrame([(300, "end", 10**6, True)], "id long, k string, secs int, ok boolean").withColumn("ts", F.timestamp_seconds("secs")))
    want = []
    for k in "abc":
        t = sorted(r.secs for r in df.where(F.col("k") == k).collect())
        run = [t[0]]
        for x in t[1:]:
            if x - run[-1] >= 30:
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(x)
        want.append((k, run[0], run[-1], len(run)))
    got = streamed(state, df, lambda s: stateful.expired_sessions(s, "k", "ts", 30), tmp_path, cuts)
    assert sorted((r.k, int(r.start.timestamp()), int(r.last.timestamp()), r.cnt) for r in got if r.k != "end") == sorted(want)


def test_keys_share_blocks(state, tmp_path):
    """Many keys of one block, long and null ones, are kept apart in one row of state."""
    big = 2**40 + 1
    rows = [(i, None if i % 41 == 0 else big + i % 40, i // 3 + 1, i % 5 > 1) for i in range(600)]
    df = state.createDataFrame(rows, "id long, k long, secs int, ok boolean").withColumn("ts", F.timestamp_seconds("secs"))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = streamed(state, df, lambda s: stateful.rate_limited(s, "k", "ts", 2, 50, blocks=2), tmp_path / "l", [201, 432])
    assert order(got) == order(eventlog.rate_limited(df, "k", "ts", 2, 50).collect())
    got = streamed(state, df, lambda s: stateful.breaker(s, "k", "ts", "ok", 2, 20.0, blocks=2), tmp_path / "b", [201, 432])
    want = [(r.k, r.ts, r.ok, r.allowed, r.state) for r in runs.breaker(df, "k", "ts", "ok", 2, 20.0).collect()]
    assert order(r for r in got if r.state != "half_open") == order(want)
    told = [(r.k, r.ts) for r in got if r.state == "half_open"]
    assert told and len(told) == len(set(told))


def test_sessions_need_no_python_and_part_at_the_gap(state, tmp_path):
    rows = [(i, k, t, True) for i, (k, t) in enumerate([("a", 0), (None, 5), ("a", 29), ("a", 59), ("a", 60), (None, 34), ("z", 1000)])]
    df = state.createDataFrame(rows, "id long, k string, secs int, ok boolean").withColumn("ts", F.timestamp_seconds("secs"))
    op = lambda s: stateful.expired_sessions(s, "k", "ts", 30)
    got = streamed(state, df, op, tmp_path, [2, 4])
    assert sorted((r.k or "", int(r.start.timestamp()), int(r.last.timestamp()), r.cnt) for r in got) == [("", 5, 34, 2), ("a", 0, 29, 2), ("a", 59, 60, 2)]
    assert "InPandas" not in op(df)._jdf.queryExecution().optimizedPlan().toString()


class Stop(Exception):
    pass


@pytest.mark.parametrize("at", [(0, 1), (1, 0), (2, 2), None])
def test_a_run_goes_on_where_it_stopped(spark, tmp_path, at):
    files = spark.createDataFrame([(f"f{i}", "x " * (i % 7)) for i in range(60)], "file_path string, text string")
    calls = []

    def stage(n, f):
        def run(df):
            calls.append(n)
            if at and n == at[0] and not stopped and sum(c == n for c in calls) > at[1]:
                stopped.append(1)
                raise Stop
            return f(df)

        return run

    stopped = []
    stages = [("parse", stage(0, lambda d: d.withColumn("n", F.size(F.split("text", " "))))), ("extract", stage(1, lambda d: d.where("n > 2"))), ("count", stage(2, lambda d: d.groupBy("file_path").agg(F.sum("n").alias("n"))))]
    root = str(tmp_path)
    run = progress.Run(spark, root, "r1", stages, batches=3)
    if at:
        with pytest.raises(Stop):
            run.go(files)
        log = progress.checkpoints(spark, root)
        if at != (0, 0):
            assert progress.resumable(log).first().run_id == "r1" and progress.latest(log, "r1").first().seq == log.count()
        run = progress.Run(spark, root, progress.resumable(log).first().run_id, stages, batches=3)
    out = run.go(files)
    assert sorted(map(tuple, out.collect())) == sorted((f"f{i}", i % 7 + 1) for i in range(60) if i % 7 + 1 > 2)
    assert len(calls) == 9 + bool(at)  # no batch that a checkpoint names is done again
    assert progress.checkpoints(spark, root).agg(F.sum("files_processed")).first()[0] == 120 + sum(1 for i in range(60) if i % 7 + 1 > 2)
    run.clear()
    assert progress.resumable(progress.checkpoints(spark, root)).count() == 0 and progress.completed(progress.checkpoints(spark, root), "r1").count() == 0


def test_overlaps_by_bins(spark):
    def made(n):
        return [(i, f"f{random.randrange(3)}", s := random.randrange(200), s + random.choice([0, 1, 3, 10, 100, -2])) for i in range(n)]

    a, b = made(80), made(90)
    df = [spark.createDataFrame(x, "id long, file_path string, start_line int, end_line int") for x in (a, b)]
    got = {tuple(r) for r in locate.overlaps(*df).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[3] >= x[2] and y[3] >= y[2]}


def test_items_of_two_finders(spark):
    kind = "id long, file_path string, name string, start_line int, end_line int, doc string, args array<string>"
    a = spark.createDataFrame([(1, "f", "x", 1, 9, "", ["u"]), (2, "f", "y", 20, 30, "own", [])], kind)
    b = spark.createDataFrame([(1, "f", "x", 2, 3, "far", ["v"]), (2, "f", "x", 1, 8, "doc", ["v"]), (3, "f", "z", 25, 26, "inner", []), (4, "f", "w", 40, 41, "new", []), (5, "g", "x", 1, 9, "other file", [])], kind)
    got = sorted((r.name, r.file_path, r.start_line, r.doc, tuple(r.args), r.partial) for r in locate.merged(a, b).collect())
    assert got == [("w", "f", 40, "new", (), True), ("x", "f", 1, "doc", ("u",), False), ("x", "g", 1, "other file", (), True), ("y", "f", 20, "own", (), False)]


def test_overlaps_by_few_classes(spark):
    """A pair for each pair of rows, ids repeated or not; lengths around the bounds of classes; starts are sent once for all short ranges."""
    lengths = [1, 2, 63, 64, 65, 4095, 4096, 4097, 300_000]
    a = [(i // 2, "f", s := 37 * i, s + n - 1) for i, n in enumerate(lengths * 4)]
    b = [(i, "f", s := 61 * i, s + n - 1) for i, n in enumerate(reversed(lengths * 4))]
    df = [spark.createDataFrame(x, "id long, file_path string, start_line long, end_line long") for x in (a, b)]
    want = sorted(("f", x[0], y[0]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])
    assert sorted(map(tuple, locate.overlaps(*df, with_file=True).collect())) == want
    short = locate._spans(df[0].where("end_line - start_line < 64"), "file_path", "start_line", "end_line", i="id")
    bins, spots = locate._binned(short, locate._begins(short))
    assert spots.count() == short.count() and bins.count() <= 2 * short.count()


def test_merged_makes_no_pairs_of_unlike_names(spark):
    cols = lambda doc: ["id", F.concat(F.lit("f"), F.col("id") % 2).alias("file_path"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 2 + 1).alias("start_line"), (F.col("id") % 2 + 9).alias("end_line"), F.lit(doc).alias("doc")]
    out = locate.merged(*(spark.range(4000).select(*cols(doc)) for doc in ("", "doc")))
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, " in x and "bin#" in x]
    assert len(joins) == 2 and all("name#" in x for x in joins)
    assert [tuple(r) for r in out.groupBy("doc", "partial").count().collect()] == [("doc", False, 4000)]
