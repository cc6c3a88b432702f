"""Ingestion runs: bookkeeping, gates between stages, degradation, watching, alerts, and what is left behind."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chain

# The stages, seconds after which each is stale, what runs at each tier, failures that open a breaker and its rest in seconds, names a gate samples.
STAGES = ("expand", "parse", "typecheck", "extract", "graph", "embed")
STALE_SECONDS = dict(zip(STAGES, (600, 30, 30, 60, 60, 90)))
TIERS = {"full": STAGES, "reduced": STAGES[:5], "minimal": STAGES[:4], "emergency": STAGES[:2]}
PRESSURE = ("normal", "elevated", "high", "critical", "emergency")
FAILURES, REST_SECONDS, SAMPLE = 5, 30, 10
# Alerts as a gauge, a threshold that is exceeded, minutes it must last, and a severity.
ALERTS = (
    ("multi_label_nodes", 0, 1, "critical"), ("orphan_nodes", 0, 5, "warning"), ("orphan_volumes", 0, 5, "warning"), ("orphan_containers", 0, 5, "warning"),
    ("leak_scan_age_seconds", 3600, 10, "warning"), ("cross_workspace_relationships", 0, 1, "critical"), ("label_mismatches", 0, 5, "warning"), ("memory_share", 0.85, 5, "warning"),
)


# -- bookkeeping ---------------------------------------------------------------


def finished(stages: DataFrame) -> DataFrame:
    """One row for each run of stages(run_id, stage, status, items_processed, items_failed, seconds): totals, status, and metadata as JSON in the order of the stages."""
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    one = F.struct(at.alias("at"), "stage", "status", "items_processed")
    rows = stages.groupBy("run_id").agg(
        F.sum("items_processed").alias("items"), F.sum("items_failed").alias("failed"), F.round(F.sum("seconds"), 3).alias("seconds"),
        F.bool_or(F.col("status") == "failed").alias("_bad"), F.array_sort(F.collect_list(one)).alias("_s"),
    )
    listed = F.transform("_s", lambda x: F.struct(x["stage"].alias("stage"), x["status"].alias("status"), x["items_processed"].alias("items_processed")))
    status = F.when(F.col("_bad"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    return rows.select("run_id", status.alias("status"), "items", "failed", "seconds", F.to_json(F.struct(listed.alias("stages"))).alias("metadata"))


# -- gates -----------------------------------------------------------------------


def items_without_file(items: DataFrame) -> DataFrame:
    """Gate before the graph: items of each crate without a source file; a crate passes with 0."""
    rows = items.groupBy(F.split_part("fqn", F.lit("::"), F.lit(1)).alias("crate_name")).agg(F.count_if(F.col("source_file_id").isNull() & F.col("fqn").contains("::")).alias("orphans"))
    return rows.withColumn("passed", F.col("orphans") == 0)


def sample_in_graph(items: DataFrame, nodes: DataFrame, size: int = SAMPLE, seed: int = 0) -> DataFrame:
    """Gate before embedding: of `size` items by a seeded random order, how many the graph lacks; it passes with 0, or without items."""
    some = items.select("fqn").orderBy(F.md5(F.concat("fqn", F.lit(str(seed))).cast("binary")), "fqn").limit(size)
    held = some.join(nodes.select("fqn", F.lit(True).alias("_in")).distinct(), "fqn", "left")
    return held.agg(F.count("*").alias("sampled"), F.count_if(F.col("_in").isNull()).alias("missing")).withColumn("passed", F.col("missing") == 0)


def partial_refs(refs: DataFrame) -> DataFrame:
    """References that stand in some stores but not in all."""
    held = [F.col(c).cast("int") for c in ("in_tables", "in_graph", "in_vectors")]
    return refs.where(reduce(lambda x, y: x + y, held).between(1, 2))


def cascaded(stores: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each store without the rows of keys in `gone`; stores are (table, its column for the key)."""
    return {n: df.join(gone.select(F.col(key).alias(c)).distinct(), c, "left_anti") for n, (df, c) in stores.items()}


# -- degradation -------------------------------------------------------------------


def tier(pressure: Column, graph_open: Column, model_open: Column) -> Column:
    """What still runs, from memory pressure and the breakers of the graph and the model."""
    level = F.array_position(F.array(*[F.lit(p) for p in PRESSURE]), pressure)
    return (
        F.when(level >= 5, "emergency").when((level >= 4) | (graph_open & model_open), "minimal").when(model_open | (level >= 3), "reduced").otherwise("full")
    )


def runs_at(tier_: Column, stage: Column) -> Column:
    allowed = F.create_map(*[x for t, s in TIERS.items() for x in (F.lit(t), F.array(*[F.lit(y) for y in s]))])
    return F.array_contains(allowed[tier_], stage)


def breaker(calls: DataFrame, service: str, ts: str, ok: str, failures: int = FAILURES, rest: float = REST_SECONDS) -> DataFrame:
    """Each call of calls with allowed and state (after it) of its service's circuit breaker.

    Closed: calls pass, and `failures` failed ones in a row open it.  Open: calls
    are refused until `rest` seconds after the last failure; then one passes as a
    probe.  A probe that succeeds closes it, one that fails opens it anew.  Decided in
    parallel stretches, so a busy service is spread over as many tasks as its calls
    fill; calls without time or outcome are left out.
    """
    rows = calls.where(F.col(ts).isNotNull() & F.col(ok).isNotNull())
    return chain.decided(rows, service, ts, chain.Break(failures, int(rest * 1e9), settled), "allowed boolean, state string", ok)


def settled(t: np.ndarray, good: np.ndarray, allowed: np.ndarray, opened: np.ndarray, is_open: bool, bad: int, since: int, failures: int, gap: int) -> tuple[bool, int, int]:
    """Fills allowed and opened for calls of one service in order, a stretch of one state at a time; returns the state after them."""
    place, i = np.arange(len(t)), 0
    # The last success up to each place; before any, those that a first stretch brought along count.
    ok_at = np.maximum.accumulate(np.where(good, place, -1))
    while i < len(t):
        if is_open:
            j = int(np.searchsorted(t, since + gap, "left"))
            allowed[i:j], opened[i:j] = False, True
            i = max(i, j)
            if i < len(t):  # the probe
                is_open, bad = not good[i], 0 if good[i] else bad + 1
                opened[i] = is_open
                since = int(t[i]) if is_open else since
                i += 1
        else:
            row = np.where(ok_at[i:] >= i, place[i:] - ok_at[i:], place[i:] - i + 1 + bad)
            trips = np.flatnonzero(row >= failures)
            if not len(trips):
                return False, int(row[-1]), since
            i += int(trips[0])
            is_open, bad, since, opened[i] = True, int(row[trips[0]]), int(t[i]), True
            i += 1
    return is_open, bad, since


# -- watching ------------------------------------------------------------------------


def stale_stages(beats: DataFrame, now: Column, stage: str = "stage", ts: str = "ts") -> DataFrame:
    """stage, seconds since its last sign of life, and whether that is too long for the stage; unknown stages are never stale."""
    limit = F.create_map(*[x for s, n in STALE_SECONDS.items() for x in (F.lit(s), F.lit(n))])
    last = beats.groupBy(stage).agg(F.max(ts).alias("_last"))
    gone = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))
    return last.select(stage, (gone / 1e6).alias("seconds"), F.coalesce(gone / 1e6 > limit[F.col(stage)], F.lit(False)).alias("stale"))


def timed_out(executions: DataFrame, now: Column) -> DataFrame:
    """Running executions whose time is up."""
    end = F.col("started_at").cast("timestamp") + F.make_dt_interval(secs=F.col("timeout_secs"))
    return executions.where((F.col("status") == "running") & (end < now.cast("timestamp")))


def expired(executions: DataFrame, now: Column) -> DataFrame:
    """Executions whose container was kept alive, and isn't to be any longer."""
    return executions.where(F.col("status").isin("completed", "running") & F.col("container_id").isNotNull() & (F.col("expires_at").cast("timestamp") <= now.cast("timestamp")))


def left_behind(actual: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Resources that exist but nobody tracks."""
    return actual.join(tracked.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def leak_scan(kinds: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """kind, name of each resource left behind; kinds are (actual, tracked, key)."""
    parts = [left_behind(a, t, k).select(F.lit(n).alias("kind"), F.col(k).cast("string").alias("name")) for n, (a, t, k) in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def alerts(gauges: DataFrame, now: Column, rules=ALERTS, tie: str = "value") -> DataFrame:
    """gauge, value, severity of rules that hold: every sample since the rule's minutes began is above its threshold, and so is the last one before; of samples of one time the last by `tie`."""
    spec = gauges.sparkSession.createDataFrame([(g, float(v), m, s) for g, v, m, s in rules], "gauge string, threshold double, minutes int, severity string")
    rows = gauges.where(F.col("ts").cast("timestamp") <= now.cast("timestamp")).join(spec, "gauge")
    since = now.cast("timestamp") - F.make_dt_interval(mins=F.col("minutes"))
    late, over = F.col("ts").cast("timestamp") > since, F.col("value") > F.col("threshold")
    out = rows.groupBy("gauge", "severity").agg(
        F.max_by("value", F.struct("ts", tie)).alias("value"), F.bool_and(F.when(late, over)).alias("_since"), F.max_by(F.when(~late, over), F.when(~late, F.struct("ts", tie))).alias("_before"),
        F.bool_or(late).alias("_any"),
    )
    return out.where("coalesce(_since, true) AND coalesce(_before, false)").select("gauge", "value", "severity")


def rollup(probes: DataFrame) -> DataFrame:
    """healthy if every dependency is, else degraded, with the names of those that aren't."""
    bad = F.array_sort(F.collect_set(F.when(~F.coalesce(F.col("healthy"), F.lit(False)), F.col("dependency"))))
    return probes.agg(F.when(F.bool_and(F.coalesce("healthy", F.lit(False))), "healthy").otherwise("degraded").alias("status"), F.array_join(bad, ",").alias("failing"))


def metric_lines(gauges: DataFrame, name: str, value: str, *labels: str) -> DataFrame:
    """line: each gauge as the text that scrapers read, `name{label="value",...} number`, in order."""
    marks = [F.concat(F.lit(f'{x}="'), F.regexp_replace(F.coalesce(F.col(x).cast("string"), F.lit("")), r'(["\\\\])', r"\\\\$1"), F.lit('"')) for x in labels]
    held = F.concat(F.lit("{"), F.concat_ws(",", *marks), F.lit("}")) if labels else F.lit("")
    return gauges.select(F.concat(F.col(name), held, F.lit(" "), F.col(value).cast("string")).alias("line")).orderBy("line")
