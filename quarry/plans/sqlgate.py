"""Read-only SQL over allowed tables: what is asked is read from the parsed plan, not from the text.

A statement passes if every node of its plan reads, every table is allowed (a name
that a WITH clause binds is none) and every function is on the list below; so
neither a write nor a function that reaches outside the tables can be asked for.
Names are compared part by part, as the parser gives them: a WITH clause binds only
names of one part, so a file or another schema's table can't pass for one.
"""

from __future__ import annotations

import re
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import as_json

MOST_ROWS, SECONDS = 500, 10.0
# Nodes of a parsed plan that read.
_READS = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Join", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "OneRowRelation", "WithWindowDefinition", "Generate", "LateralJoin", "Window", "Pivot", "UnresolvedSubqueryColumnAliases", "Expand", "UnresolvedTableValuedFunction", "Range", "Sample", "RepartitionByExpression", "UnresolvedHint", "WithCTE", "CTERelationDef", "CTERelationRef"}
# Functions that may be called, all without effects and without a look outside their arguments.
FUNCTIONS = frozenset(
    """
    abs array array_agg array_contains array_distinct array_except array_intersect array_join array_max array_min array_position
    array_sort array_union ascii avg base64 bool_and bool_or btrim cardinality ceil ceiling char_length character_length coalesce
    collect_list collect_set concat concat_ws contains corr count count_if cube current_date current_timestamp date date_add
    date_diff date_format date_part date_sub date_trunc datediff day dayofweek dayofyear decode dense_rank element_at elt endswith
    every exists exp explode explode_outer extract filter first first_value flatten floor format_number format_string from_json
    from_unixtime get_json_object greatest grouping grouping_id hash hex hour if ifnull initcap instr isnan isnotnull isnull
    json_array_length json_object_keys kurtosis lag last last_day last_value lead least left length levenshtein like listagg ln
    locate log log10 log2 lower lpad ltrim map map_entries map_from_arrays map_keys map_values max max_by md5 mean median min
    min_by minute mod mode month months_between named_struct nanvl not now ntile nullif nvl nvl2 octet_length overlay
    percent_rank percentile percentile_approx percentile_cont percentile_disc pmod posexplode position pow power quarter rand rank
    regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse right rlike rollup round
    row_number rpad rtrim second sequence sha1 sha2 sign size skewness slice some sort_array split split_part sqrt startswith
    std stddev stddev_pop stddev_samp string_agg struct substr substring substring_index sum to_date to_json to_timestamp
    transform translate trim trunc try_cast try_divide unix_timestamp upper var_pop var_samp variance weekofyear xxhash64 year
    """.split()
)
_TABLE_FUNCTIONS = frozenset(("range", "explode", "posexplode"))


class NotAllowed(ValueError):
    """The statement writes, calls what isn't on the list, or reads a table that isn't allowed."""


def _each(seq):
    return (seq.apply(i) for i in range(seq.length()))


def _written(parts: list[str]) -> str:
    """A name of several parts as text; a part that is no plain word is quoted, so no other name is written alike."""
    return ".".join(p if re.fullmatch(r"\w+", p) else f"`{p.replace('`', '``')}`" for p in parts)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _called(name: str, known: frozenset[str]) -> None:
    if name.lower() not in known:
        raise NotAllowed(f"function not allowed: {name}")


def _expression(e) -> None:
    kind = _kind(e)
    if kind == "UnresolvedFunction":
        _called(e.nameParts().mkString("."), FUNCTIONS)
    elif kind == "UnresolvedGenerator":
        _called(e.name().unquotedString(), FUNCTIONS)
    elif kind.startswith(("CallMethodViaReflection", "PythonUDF", "ScalaUDF", "ScriptTransformation", "Invoke", "StaticInvoke")):
        raise NotAllowed(f"expression not allowed: {kind}")
    for c in _each(e.children()):
        _expression(c)


def _walk(plan, names: set[str], bound: frozenset[str]) -> None:
    kind = plan.nodeName().strip("'")
    if kind not in _READS:
        raise NotAllowed(f"not a read: {kind}")
    if kind == "UnresolvedWith":
        known = set(bound)
        for pair in _each(plan.cteRelations()):
            own = pair._1().lower()
            _walk(pair._2(), names, frozenset(known | {own}) if plan.allowRecursion() else frozenset(known))
            known.add(own)
        bound = frozenset(known)
    if kind == "UnresolvedTableValuedFunction":
        _called(plan.name().mkString("."), _TABLE_FUNCTIONS)
    if kind == "UnresolvedRelation":
        parts = [p.lower() for p in _each(plan.multipartIdentifier())]
        if len(parts) > 1 or parts[0] not in bound:
            names.add(_written(parts))
    for e in _each(plan.expressions()):
        _expression(e)
    if kind == "Generate":
        _expression(plan.generator())
    for c in _each(plan.children()):
        _walk(c, names, bound)
    for c in _each(plan.subqueries()):
        _walk(c, names, bound)


def tables_of(spark: SparkSession, query: str) -> set[str]:
    """Names of all tables a query reads, in any clause, their parts joined by dots (quoted unless plain words); a common table expression's name isn't one."""
    names: set[str] = set()
    _walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(query), names, frozenset())
    return names


def sql(spark: SparkSession, query: str, allowed, args=None, most: int = MOST_ROWS) -> DataFrame:
    """Runs a read over allowed tables, at most `most` rows of it; parameters are bound, never pasted."""
    wrong = tables_of(spark, query) - {t.lower() for t in allowed}
    if wrong:
        raise NotAllowed(f"tables not allowed: {', '.join(sorted(wrong))}")
    return spark.sql(query, args=args).limit(most)


@contextmanager
def _views(spark: SparkSession, tables: dict[str, DataFrame]):
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


def scoped(spark: SparkSession, query: str, own: dict[str, DataFrame], public: dict[str, DataFrame], workspace_id: str, args=None, most: int = MOST_ROWS) -> DataFrame:
    """sql() as one tenant sees it: tables of `own`, cut to its rows, go before tables of `public` with the same name; others don't exist."""
    seen = public | {n: df.where(df["workspace_id"] == workspace_id) for n, df in own.items()}
    with _views(spark, seen):  # a DataFrame is analysed when it is made, so the names are needed no longer
        return sql(spark, query, seen, args, most)


def rows(df: DataFrame, seconds: float = SECONDS, most: int = MOST_ROWS) -> list[str]:
    """The rows of a query as JSON texts; after `seconds` its jobs are cancelled and TimeoutError is raised."""
    sc, group, late = df.sparkSession.sparkContext, f"sql-{uuid.uuid4().hex}", threading.Event()
    sc.setJobGroup(group, "read-only SQL", interruptOnCancel=True)

    def stop():
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        out = [r[0] for r in as_json(df, most).collect()]
    except Exception:
        if late.is_set():
            raise TimeoutError(f"query timed out after {seconds} seconds") from None
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out
