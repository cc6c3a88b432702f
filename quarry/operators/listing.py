"""Listings with optional filters, and the type queries over call sites and trait implementations.

Nulls stand last in rising order and first in falling order, as the listings' stores have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most rows of a listing, of bench runs (and what they give if not asked), and of a type query's default.
MOST, MOST_RUNS, RUNS, TYPE_ROWS = 100, 200, 50, 10


def matching(df: DataFrame, **by) -> DataFrame:
    """Rows that equal each value that isn't None."""
    for c, v in by.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def tasks(df: DataFrame, status=None, agent=None, phase=None, kind=None, limit: int = MOST) -> DataFrame:
    """Tasks, the one changed last first; equal times by id."""
    return matching(df, status=status, agent=agent, phase=phase, **{"class": kind}).orderBy(F.desc_nulls_first("updated_at"), F.asc_nulls_last("id")).limit(min(int(limit), MOST))


def artifacts(df: DataFrame, task_id=None, kind=None, status=None, producer=None, limit: int = MOST) -> DataFrame:
    """Artifacts, newest first; equal times by id."""
    return matching(df, task_id=task_id, type=kind, status=status, producer=producer).orderBy(F.desc_nulls_first("created_at"), F.asc_nulls_last("id")).limit(min(int(limit), MOST))


def archived(status: Column | str = "status") -> Column:
    """The status after a soft delete: archived, whatever it was."""
    c = F.col(status) if isinstance(status, str) else status
    return F.when(c != "archived", "archived").otherwise(c)


def validator_runs(df: DataFrame, repo: str, pr: int) -> DataFrame:
    return matching(df, repo=repo, pr_number=pr).orderBy(F.asc_nulls_last("run_index"), F.asc_nulls_last("created_at"))


def bench_runs(df: DataFrame, suite=None, status=None, limit: int | None = None) -> DataFrame:
    return matching(df, suite_name=suite, status=status).orderBy(F.desc_nulls_first("started_at"), F.asc_nulls_last("id")).limit(min(RUNS if limit is None else int(limit), MOST_RUNS))


def bench_run(runs: DataFrame, results: DataFrame, cases: DataFrame, run_id) -> DataFrame:
    """One run with its case results in order of case and run index, each with the weight of its case."""
    own = results.where(F.col("bench_run_id") == run_id).join(cases.select("eval_case_id", "weight"), "eval_case_id")
    one = F.struct("eval_case_id", "run_index", "composite", "pass", "cost_usd", "weight")
    listed = own.agg(F.array_sort(F.collect_list(one)).alias("case_results"))  # a run's cases are few
    return runs.where(F.col("id") == run_id).crossJoin(listed)


def suites(cases: DataFrame) -> DataFrame:
    return cases.groupBy("suite_name").agg(F.count("*").alias("case_count")).orderBy("suite_name")


def progress(runs: DataFrame) -> DataFrame:
    """status, started_at, stage, stage_status, items_processed of the latest run, a row for each stage that its metadata names; a stage without status is unknown, without items 0."""
    latest = runs.orderBy(F.desc("started_at")).limit(1)
    stages = F.from_json(F.get_json_object("metadata", "$.stages"), "array<struct<stage: string, name: string, status: string, items_processed: bigint>>")
    rows = latest.select("status", "started_at", F.coalesce("crates_processed", F.lit(0)).alias("crates_processed"), F.coalesce("items_extracted", F.lit(0)).alias("items_extracted"), F.posexplode(stages).alias("at", "s"))
    name = F.coalesce("s.stage", "s.name")
    return rows.where(name.isNotNull()).select("status", "started_at", "crates_processed", "items_extracted", "at", name.alias("stage"), F.coalesce("s.status", F.lit("unknown")).alias("stage_status"), F.coalesce("s.items_processed", F.lit(0)).alias("items_processed"))


def json_text(args: str = "concrete_type_args") -> Column:
    """Type arguments as a stored JSON text renders them: keys by length, a blank after each comma and colon."""
    one = lambda a: F.concat(F.lit('{"param_name": "'), a["param_name"], F.lit('", "concrete_type": "'), a["concrete_type"], F.lit('"}'))
    return F.concat(F.lit("["), F.array_join(F.transform(args, one), ", "), F.lit("]"))


def calls_with_type(sites: DataFrame, type_name: str, callee: str | None = None, limit: int = TYPE_ROWS) -> DataFrame:
    """Call sites whose type arguments hold a text (case counts; % and _ are wildcards), by file and line; the concrete types are listed."""
    rows = sites.where(json_text().like(f"%{type_name}%"))
    if callee is not None:
        rows = rows.where(F.col("callee_fqn").like(f"%::{callee}"))
    top = rows.orderBy(*[F.asc_nulls_last(c) for c in ("file_path", "line_number", "caller_fqn", "callee_fqn")]).limit(min(int(limit), MOST))
    types = F.transform("concrete_type_args", lambda a: a["concrete_type"])
    return top.select("caller_fqn", "callee_fqn", "file_path", "line_number", types.alias("concrete_type_args"), "is_monomorphized", F.coalesce("quality", F.lit("unknown")).alias("quality"))


def impls_for_type(impls: DataFrame, type_name: str, limit: int = TYPE_ROWS) -> DataFrame:
    """Trait implementations whose self type holds a text, by trait."""
    top = impls.where(F.col("self_type").like(f"%{type_name}%")).orderBy("trait_fqn", "impl_fqn").limit(min(int(limit), MOST))
    return top.select("trait_fqn", "self_type", "impl_fqn", "file_path", "line_number", F.coalesce("quality", F.lit("unknown")).alias("quality"))


def key_holder(keys: DataFrame, digest: str, now: Column) -> DataFrame:
    """The active key with this digest that hasn't expired, its last use set to now."""
    live = keys.where((F.col("key_hash") == digest) & F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at").cast("timestamp") > now.cast("timestamp"))))
    return live.withColumn("last_used", now)
