"""Counters, histograms and quantiles as dashboards read them, without a task for each series.

A histogram is a family of counters, one for each upper bound `le` (the last is
infinite), each counting what lies at or under it.  Series are spread over ranges of
(series, time), so a busy one fills several partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

INF = float("inf")


def rates(samples: DataFrame, ts: str, value: str, minutes: int, *by: str, tie: str | None = None) -> DataFrame:
    """Increase a second of a counter over windows of minutes, by series; a fall is a restart and counts from 0. Samples of one time stand by `tie`."""
    rows = samples.select(*by, F.col(ts).alias("_ts"), F.col(value).cast("double").alias("_value"), F.struct(*by).alias("_by"), F.struct(ts, *([tie] if tie else [])).alias("_at"))
    rows = ordered.previous(ordered.ranged(rows, "_by", "_at"), "_by", "_value")
    was = F.col("_was._value")
    rows = rows.withColumn("_d", F.when(was.isNull(), 0.0).when(F.col("_value") >= was, F.col("_value") - was).otherwise(F.col("_value")))
    return rows.groupBy(F.window("_ts", f"{minutes} minutes")["start"].alias("bucket"), *by).agg((F.sum("_d") / (60.0 * minutes)).alias("rate"))


def observed(samples: DataFrame, ts: str, value: str, bounds: list[float], scrape: str, *by: str) -> DataFrame:
    """The counters of a histogram as a scraper sees them: ts (end of each scrape interval with samples), by, le, count so far."""
    # Null labels are labels, and an interval whose samples lie in no bucket (NaN) has its counters too.
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= F.lit(float(b))).alias("n")) for b in (*bounds, INF)]
    rows = samples.where(F.col(value).isNotNull()).groupBy(*by, F.window(ts, scrape)["end"].alias("ts")).agg(F.array(*counts).alias("_c"))
    rows = rows.select(*by, "ts", F.inline("_c")).withColumn("_by", F.struct(*by, "le"))
    return ordered.running(ordered.ranged(rows, "_by", "ts"), "_by", F.col("n"), "count").select(*by, "ts", "le", "count")


def quantile_of(buckets: Column, q: float) -> Column:
    """The quantile of sorted cumulative buckets (array of le, n) by interpolation inside the bucket it falls in.

    The first bucket begins at 0 (or is its bound, if that isn't above 0); in the
    infinite one the last finite bound stands.  Null without any count.
    """
    last = F.size(buckets)
    total = F.element_at(buckets, -1)["n"]
    rank = total * q
    at = F.array_position(F.transform(buckets, lambda b: b["n"] >= rank), True).cast("int")
    here = F.element_at(buckets, at)
    below = F.when(at > 1, F.element_at(buckets, F.greatest(at - 1, F.lit(1))))
    low, under = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["n"], F.lit(0.0))
    inside = low + (here["le"] - low) * (rank - under) / (here["n"] - under)
    return F.when((last < 2) | (total <= 0), None).when(at == last, F.element_at(buckets, F.greatest(last - 1, F.lit(1)))["le"]).when((at == 1) & (here["le"] <= 0), here["le"]).otherwise(inside)


def histogram_quantiles(rows: DataFrame, n: str, quantiles: dict[str, float], *by: str, le: str = "le") -> DataFrame:
    """by and a column for each quantile, of rows(by, le, n): counts or rates of cumulative buckets, summed over all other labels first."""
    sums = rows.groupBy(*by, le).agg(F.sum(n).alias("n"))
    found = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(le).cast("double").alias("le"), F.col("n").cast("double").alias("n")))).alias("_b"))  # a struct for each bound
    # Counts that fall along the bounds, as rates of unequal restarts may, are raised to what is under them.
    up = F.transform("_b", lambda b, i: F.struct(b["le"].alias("le"), F.array_max(F.transform(F.slice(F.col("_b"), F.lit(1), i + 1), lambda x: x["n"])).alias("n")))
    found = found.withColumn("_b", up)
    return found.select(*by, *[quantile_of(F.col("_b"), q).alias(name) for name, q in quantiles.items()])


def exact_quantiles(rows: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """key and a column for each quantile, exact and interpolated between two rows: by places in a range sort, so no task holds a group. Nulls and NaN don't count; a group of these alone has none."""
    rows = rows.select(key, F.col(value).cast("double").alias("_x"))
    keys = rows.select(key).distinct()
    rows = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    placed = ordered.running(ordered.ranged(rows, key, "_x"), key, F.lit(1), "_at").select(key, "_x", "_at")
    many = placed.groupBy(F.col(key).alias("_k")).agg(F.max("_at").alias("_n"))
    want = F.array(*[f((F.col("_n") - 1) * q).cast("long") + 1 for q in quantiles.values() for f in (F.floor, F.ceil)])
    few = placed.join(many, placed[key].eqNullSafe(many["_k"])).where(F.array_contains(want, F.col("_at")))
    cols = []
    for name, q in quantiles.items():
        at = (F.col("_n") - 1) * q + 1
        low, high = F.max(F.when(F.col("_at") == F.floor(at), F.col("_x"))), F.max(F.when(F.col("_at") == F.ceil(at), F.col("_x")))
        cols.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    found = few.groupBy(F.col(key).alias("_key")).agg(*cols)
    return keys.join(found, keys[key].eqNullSafe(found["_key"]), "left").select(key, *quantiles)


def sketches(rows: DataFrame, value: str, *by: str, k: int = 200) -> DataFrame:
    """by and `sketch`, a KLL sketch of the values: bounded in size and made before the shuffle, to be stored and merged."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(rows: DataFrame, quantiles: dict[str, float], *by: str) -> DataFrame:
    """by and a column for each quantile of the sketches(by, ...) that fall together, as of minutes into hours."""
    merged = rows.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*by, *[F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(n) for n, q in quantiles.items()])


def mean_gap(rows: DataFrame, key: str, ts: str, order: str, name: str) -> DataFrame:
    """key and the mean seconds from a row to the next: the time between the first and the last, over the gaps between them, which needs no window. Null for a single row."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    some = rows.where(F.col(ts).isNotNull()).groupBy(key).agg(F.min_by(at, order).alias("_a"), F.max_by(at, order).alias("_b"), (F.count("*") - 1).alias("_n"))
    return some.select(key, F.when(F.col("_n") > 0, (F.col("_b") - F.col("_a")) / F.col("_n") / 1e6).alias(name))
