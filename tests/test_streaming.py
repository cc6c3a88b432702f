"""The event log as a stream: tail, windows, deduplication, sinks that resume, and following until the end."""

import pytest
from pyspark.sql import functions as F

from quarry.streaming import tail

T0 = "2024-01-01 00:00:00"


def events(spark, rows):
    df = spark.createDataFrame(rows, "id long, user long, secs int, kind string, workspace_id string")
    return df.select("id", "user", (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("secs"))).alias("ts"), "kind", "workspace_id")


@pytest.fixture
def folder(spark, tmp_path):
    one = events(spark, [(1, 1, 0, "a", "w1"), (2, 1, 5, "a", "w2"), (3, 2, 10, "b", "w1"), (3, 2, 10, "b", "w1"), (4, 1, 100, "a", "w1")])
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), one.schema


def collected(stream, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_tail_filters_a_workspace(spark, folder):
    assert sorted(r.id for r in collected(tail.of_workspace(tail.tail(spark, *folder, files=1), "w1"), "t1")) == [1, 3, 3, 4]


def test_repeated_requests_count_once(spark, folder):
    s = tail.once(tail.timed(tail.tail(spark, *folder), "ts", "1 minute"), ["id"])
    assert sorted(r.id for r in collected(s, "t2")) == [1, 2, 3, 4]


def test_sessions_end_after_a_gap(spark, folder):
    s = tail.sessions(tail.timed(tail.tail(spark, *folder), "ts", "0 seconds"), "ts", "30 seconds", "user")
    got = sorted((r.user, r.cnt) for r in collected(s, "t3", "complete"))
    assert got == [(1, 1), (1, 2), (2, 2)]


def test_sliding_windows(spark, folder):
    s = tail.tumbling(tail.timed(tail.tail(spark, *folder), "ts", "0 seconds"), "ts", "20 seconds", "user", slide="10 seconds")
    got = {(r.user, r.bucket.second): r.cnt for r in collected(s, "t4", "complete")}
    assert got[1, 0] == 2 and got[2, 0] == 2 and got[2, 10] == 2


def test_drain_goes_on_where_it_stopped(spark, folder, tmp_path):
    path, schema = folder
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    tail.drain(tail.tail(spark, path, schema), out, mark)
    assert spark.read.parquet(out).count() == 5
    events(spark, [(9, 9, 200, "a", "w1")]).coalesce(1).write.mode("append").parquet(path)
    tail.drain(tail.tail(spark, path, schema), out, mark)
    assert spark.read.parquet(out).count() == 6


def test_follow_drains_and_ends_at_a_terminal_event(spark, folder, tmp_path):
    path, schema = folder
    seen = []
    events(spark, [(10, 1, 300, "done", "w1"), (11, 1, 301, "a", "w1")]).coalesce(1).write.mode("append").parquet(path)
    ended = tail.follow(tail.tail(spark, path, schema, files=1), "kind", ("done",), lambda b, n: seen.extend(r.id for r in b.collect()), str(tmp_path / "mark"), "100 milliseconds", 60)
    assert ended and sorted(seen) == [1, 2, 3, 3, 4, 10, 11]
    assert not tail.follow(tail.tail(spark, path, schema), "kind", ("never",), lambda b, n: None, str(tmp_path / "mark2"), "100 milliseconds", 3)
