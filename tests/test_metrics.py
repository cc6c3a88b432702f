"""Histograms, quantiles, rates over ranges and sketches against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics

random.seed(11)


def test_quantiles_of_buckets_interpolate(spark):
    inf = float("inf")
    rows = [("a", 1.0, 2.0), ("a", 2.0, 6.0), ("a", inf, 8.0), ("b", 1.0, 0.0), ("b", inf, 0.0), ("c", 1.0, 0.0), ("c", inf, 4.0), ("d", -1.0, 3.0), ("d", inf, 3.0), ("e", inf, 3.0), ("f", 1.0, 4.0), ("f", 2.0, 3.0), ("f", inf, 4.0)]
    got = {r.k: (r.p25, r.p50, r.p95) for r in metrics.histogram_quantiles(spark.createDataFrame(rows, "k string, le double, n double"), "n", {"p25": 0.25, "p50": 0.5, "p95": 0.95}, "k").collect()}
    assert got["a"] == (1.0, 1.5, 2.0) and got["b"] == (None,) * 3 and got["c"] == (1.0,) * 3 and got["d"] == (-1.0,) * 3 and got["e"] == (None,) * 3
    assert got["f"][1] == 0.5  # a count that falls along the bounds is raised


def test_labels_are_summed_before_the_quantile(spark):
    rows = [("x", i, le, float(n)) for i, ns in enumerate(((1, 2), (3, 6))) for le, n in zip((10.0, float("inf")), ns)]
    df = spark.createDataFrame(rows, "k string, pod int, le double, n double")
    assert metrics.histogram_quantiles(df, "n", {"p50": 0.5}, "k").first().p50 == pytest.approx(10.0)


def test_observed_counters_only_grow(spark):
    rows = [(random.choice("ab"), 60 * random.randint(0, 30) + random.randint(0, 59), random.random() * 20) for _ in range(400)] + [("a", 5, None)]
    df = spark.createDataFrame(rows, "k string, secs int, v double").withColumn("ts", F.timestamp_seconds("secs"))
    got = metrics.observed(df, "ts", "v", [1.0, 5.0, 10.0], "1 minute", "k").collect()
    for r in got:
        end = r.ts.timestamp()
        assert r["count"] == sum(k == r.k and s < end and v is not None and v <= r.le for k, s, v in rows)


def test_rates_of_a_busy_series_span_partitions(spark):
    rows, count = [], 0
    for i in range(3000):
        count = 0 if i % 700 == 699 else count + random.randint(0, 3)
        rows.append((i, "hot" if i % 10 else "cold", i // 2, float(count)))
    df = spark.createDataFrame(rows, "id long, k string, secs int, v double").withColumn("ts", F.timestamp_seconds("secs")).repartition(7)
    want, last = {}, {}
    for i, k, secs, v in rows:
        was = last.get(k)
        want[k, secs // 300 * 300] = want.get((k, secs // 300 * 300), 0) + (0 if was is None else v - was if v >= was else v)
        last[k] = v
    got = {(r.k, int(r.bucket.timestamp())): r.rate for r in metrics.rates(df, "ts", "v", 5, "k", tie="id").collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x] / 300) for x in want)


def test_exact_quantiles(spark):
    rows = [(random.choice(["hot"] * 8 + ["b", None]), random.choice([random.random(), 1.0, None, float("nan")])) for _ in range(2000)] + [("none", None), ("one", 3.0)]
    got = {r.k: (r.a, r.b) for r in metrics.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), "k", "v", {"a": 0.5, "b": 0.95}).collect()}
    for k in {k for k, _ in rows}:
        x = sorted(v for kk, v in rows if kk == k and v is not None and not math.isnan(v))
        for q, v in zip((0.5, 0.95), got[k]):
            at = (len(x) - 1) * q
            assert v is None if not x else v == pytest.approx(x[math.floor(at)] + (x[math.ceil(at)] - x[math.floor(at)]) * (at - math.floor(at)))


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 60).alias("minute"), (F.rand(3) * 100).alias("v"))
    got = metrics.merged_quantiles(metrics.sketches(df, "v", "k", "minute"), {"p50": 0.5, "p95": 0.95}, "k").collect()
    assert len(got) == 3 and all(abs(r.p50 - 50) < 4 and abs(r.p95 - 95) < 3 for r in got)


def test_mean_gap_is_that_of_neighbours(spark):
    rows = [("a", i, 10 * i * i) for i in range(9)] + [("b", 1, 5), ("c", 2, 7), ("c", 1, 1)]
    df = spark.createDataFrame(rows, "k string, id long, secs int").withColumn("ts", F.timestamp_seconds("secs"))
    assert {r.k: r.m for r in metrics.mean_gap(df, "k", "ts", "id", "m").collect()} == {"a": 80.0, "b": None, "c": 6.0}


def test_observed_with_null_labels_and_nan(spark):
    rows = [(None, 1, 2.0), (None, 2, 1.0), ("a", 1, float("nan")), ("a", 70, 2.0), ("a", 71, None)]
    df = spark.createDataFrame(rows, "k string, secs int, v double").withColumn("ts", F.timestamp_seconds("secs"))
    got = {(r.k, r.ts.minute, r.le, r["count"]) for r in metrics.observed(df, "ts", "v", [1.0], "1 minute", "k").collect()}
    assert got == {(None, 1, 1.0, 1), (None, 1, metrics.INF, 2), ("a", 1, 1.0, 0), ("a", 1, metrics.INF, 0), ("a", 2, 1.0, 0), ("a", 2, metrics.INF, 1)}
