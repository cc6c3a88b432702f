"""An append-only event log by execution: dense sequence numbers, replay, grouping and watching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chain
from .ordered import previous, ranged, running

# The frame limit in bytes, and how many stale checks lead to which step.
FRAME_BYTES = 65536


def content_hash(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def append(events: DataFrame, execution: str, order: str, digest: str) -> DataFrame:
    """Drops later rows of equal content of an execution, then numbers what is left from 1 without gaps."""
    kept = events.groupBy(execution, digest).agg(F.min_by(F.struct(*events.columns), F.col(order)).alias("_r")).select("_r.*")
    return running(ranged(kept, execution, order), execution, F.lit(1), "seq").drop("_i")


def after(log: DataFrame, execution: str, value, seq: int = 0) -> DataFrame:
    """Replay of one execution behind a cursor."""
    return log.where((F.col(execution) == value) & (F.col("seq") > seq)).orderBy("seq")


def frames(log: DataFrame, content: str, limit: int = FRAME_BYTES) -> DataFrame:
    """Adds frame: the content, or a short notice with its seq and size if it has more bytes than limit."""
    size = F.octet_length(content)
    notice = F.to_json(F.struct(F.lit(True).alias("truncated"), F.col("seq").alias("full_payload_seq"), size.alias("original_size")))
    return log.withColumn("frame", F.when(size > limit, notice).otherwise(F.col(content)))


def gaps(log: DataFrame, execution: str) -> DataFrame:
    """Places where seq jumps: expected and found."""
    out = previous(ranged(log.select(execution, "seq"), execution, "seq"), execution, "seq").where(F.col("seq") - F.col("_was.seq") > 1)
    return out.select(execution, (F.col("_was.seq") + 1).alias("expected"), F.col("seq").alias("found"))


def grouped(log: DataFrame, execution: str, order: str, kind: str, alone: str = "tool_call") -> DataFrame:
    """Runs of neighbours of one kind, but each row of the kind `alone` is a run of its own."""
    rows = previous(ranged(log.select(execution, order, kind), execution, order), execution, kind)
    same = F.col("_was").isNotNull() & F.col(f"_was.{kind}").eqNullSafe(F.col(kind)) & (F.col(kind) != alone)
    g = running(rows, execution, F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1), "grp")
    return g.groupBy(execution, "grp").agg(F.first(kind).alias(kind), F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def stuck(checks: DataFrame, key: str, order: str, progressed: str) -> DataFrame:
    """Checks in a row without progress, and the step each leads to; progress starts anew."""
    g = running(ranged(checks, key, order), key, (~F.col(progressed)).cast("int"), "_n")
    # Those up to the last progress, which grow along a key, so their maximum is the last one.
    g = running(g, key, F.when(F.col(progressed), F.col("_n")), "_done", most=True)
    stale = (F.col("_n") - F.coalesce("_done", F.lit(0))).cast("long")
    step = F.when(F.col("stale") == 0, "ok").when(F.col("stale") == 1, "warning").when(F.col("stale") <= 3, "diagnostic").otherwise("circuit_break")
    return g.withColumn("stale", stale).withColumn("step", step).drop("_n", "_done", "_i")


def transitions(rows: DataFrame, key: str, order: str, status: str, allowed: list[tuple[str, str]], always: str = "escalated") -> DataFrame:
    """Each status change with valid: whether it is in the table, or leads to `always`."""
    moved = previous(ranged(rows, key, order), key, status).withColumn("was", F.col(f"_was.{status}")).drop("_was", "_i").where(F.col("was").isNotNull())
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    return moved.withColumn("valid", F.array_contains(pairs, F.concat_ws(">", "was", status)) | (F.col(status) == always))


def ring(log: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """The last `capacity` rows of each key."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where(F.col("_r") <= capacity).drop("_r")


def backoff_ms(attempt: str, base: int = 1000, most: int = 30000) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.col(attempt))).cast("long")


def buckets(events: DataFrame, ts: str, unit: str, *by: str) -> DataFrame:
    return events.groupBy(F.date_trunc(unit, ts).alias("bucket"), *by).agg(F.count("*").alias("cnt"))


def rate_limited(requests: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """key, ts, remaining, allowed: a window opens at a key's first request and the first one after it has passed opens the next.

    Decided in parallel stretches, so a busy key is spread over as many tasks as
    its rows fill; requests without a time are left out.
    """
    return chain.decided(requests.where(F.col(ts).isNotNull()), key, ts, chain.Limit(limit, seconds * 10**9), "remaining long, allowed boolean")


# -- kinds of events ---------------------------------------------------------

# Kinds of typed events, and the fields each must have and may have.
KINDS = {
    "reasoning": ("agent string, text string, reasoning string", ("agent",)), "tool_call": ("agent string, tool string, args string, result string", ("agent", "tool")), "agent_dispatch": ("agent string", ("agent",)),
    "error": ("error string, stage string", ()), "file_edit": ("path string", ("path",)), "phase_change": ("phase string", ("phase",)), "container_kept_alive": ("container_id string", ()),
}


def typed(log: DataFrame, kind: str = "event_type", content: str = "content") -> DataFrame:
    """Adds decoded (kind, and the fields of all kinds) and raw: a kind that isn't known, content that is no object, or one without what its kind must have is `unknown` and keeps its raw text."""
    owners: dict[str, list[str]] = {}
    for k, (fields, _) in KINDS.items():
        for f in fields.split(", "):
            owners.setdefault(f.split()[0], []).append(k)
    rows = log.withColumn("_j", F.from_json(content, ", ".join(f"{n} string" for n in ["kind", *sorted(owners)])))
    rows = rows.withColumn("_k", F.coalesce("_j.kind", kind))
    needed = F.create_map(*[x for k, (_, must) in KINDS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in must]).cast("array<string>"))])
    has = F.array_compact(F.array(*[F.when(F.col(f"_j.{n}").isNotNull(), F.lit(n)) for n in sorted(owners)]))
    is_object = F.col(content).rlike(r"^\s*\{") & F.try_parse_json(content).isNotNull()
    rows = rows.withColumn("_ok", F.coalesce(is_object & (F.size(F.array_except(needed[F.col("_k")], has)) == 0), F.lit(False)))
    fields = [F.when(F.col("_ok") & F.col("_k").isin(*owners[n]), F.col(f"_j.{n}")).alias(n) for n in sorted(owners)]
    decoded = F.struct(F.when(F.col("_ok"), F.col("_k")).otherwise("unknown").alias("kind"), *fields)
    return rows.withColumn("decoded", decoded).withColumn("raw", F.when(~F.col("_ok"), F.col(content))).drop("_j", "_k", "_ok")


def parts(messages: DataFrame, part: str = "part") -> DataFrame:
    """event_type and content (JSON) of the parts of agent messages, one text of JSON each: what a part is goes by its type, unknown types stay whole."""
    at = lambda *n: F.coalesce(*[F.nullif(F.get_json_object(part, f"$.{x}"), F.lit("{}")) for x in n])
    kind = F.get_json_object(part, "$.type")
    agent = F.col("agent")
    event = F.when(kind.isin("text", "reasoning", "step-start", "step-finish"), "reasoning").when(kind.isin("tool", "tool-invocation"), "tool_call").otherwise("unknown")
    content = (
        F.when(kind == "text", F.to_json(F.struct(agent.alias("agent"), at("text").alias("text")))).when(kind == "reasoning", F.to_json(F.struct(agent.alias("agent"), at("text").alias("reasoning"))))
        .when(kind == "step-start", F.to_json(F.struct(agent.alias("agent"), at("id").alias("step_start")))).when(kind == "step-finish", F.to_json(F.struct(agent.alias("agent"), at("reason").alias("step_finish"))))
        .when(kind.isin("tool", "tool-invocation"), F.to_json(F.struct(agent.alias("agent"), at("toolName", "tool").alias("tool"), at("args", "state.input").alias("args"), at("result", "state.output").alias("result"))))
        .otherwise(F.to_json(F.struct(F.coalesce(kind, F.lit("")).alias("raw_type"), F.col(part).alias("raw"))))
    )
    return messages.withColumn("event_type", event).withColumn("content", content)


def tool_status(result: Column) -> Column:
    """pending without a result, error if it is a text that begins so or an object that says so, else completed."""
    is_object = F.coalesce(result.rlike(r"^\s*\{"), F.lit(False))
    err = F.get_json_object(result, "$.error")
    wrong = F.when(is_object, (F.get_json_object(result, "$.is_error") == "true") | (err != "")).otherwise(result.rlike(r"(?i)^\s*error\b"))
    return F.when(result.isNull(), "pending").when(F.coalesce(wrong, F.lit(False)), "error").otherwise("completed")


def labels() -> Column:
    """The line that stands for a group of n events of a kind; `first` are the decoded fields of its first event."""
    n, f = F.col("n"), lambda c: F.col(f"first.{c}")
    many = lambda what: F.concat(n.cast("string"), F.lit(f" {what}"))
    one = lambda k, single, plural: F.when(F.col("kind") == k, F.when(n == 1, single).otherwise(many(plural) if isinstance(plural, str) else plural))
    tool = F.concat(F.lit("tool: "), f("tool"), F.lit(" → "), tool_status(f("result")))
    return F.when(n == 0, "empty group").otherwise(F.coalesce(
        one("tool_call", tool, F.concat(n.cast("string"), F.lit(" tool calls ("), f("tool"), F.lit("…)"))), one("reasoning", F.lit("reasoning"), "reasoning events"),
        one("agent_dispatch", F.concat(F.lit("dispatch "), f("agent")), "agent dispatches"), one("phase_change", F.concat(F.lit("phase: "), f("phase")), "phase changes"), one("error", F.lit("error"), "errors"),
        one("file_edit", F.concat(F.lit("file: "), f("path")), "file edits"), one("container_kept_alive", F.lit("container heartbeat"), "container heartbeats"), F.when(n == 1, F.lit("unknown event")).otherwise(many("unknown events")),
    ))


def matching(log: DataFrame, query: str, kind: str = "event_type", decoded: str = "decoded") -> DataFrame:
    """Events whose kind or shown fields hold a text, whatever its case; an empty query finds nothing."""
    q = query.strip().lower()
    if not q:
        return log.where(F.lit(False))
    fields = [f.name for f in log.schema[decoded].dataType.fields if f.name != "kind"]
    return log.where(F.lower(F.concat_ws(" ", F.col(kind), *[F.col(f"{decoded}.{n}") for n in fields])).contains(q))


def after_id(log: DataFrame, execution: str, value, last: int) -> DataFrame:
    """Replay behind an id: rows are chosen by id and come by seq, so they may differ from after() where ids and numbers disagree."""
    return log.where((F.col(execution) == value) & (F.col("id") > last)).orderBy("seq")


def oldest(log: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """The smallest number that a ring of each key still holds, and how many it holds."""
    return ring(log, key, seq, capacity).groupBy(key).agg(F.min(seq).alias("oldest_seq"), F.count("*").alias("held"))


def recent(audit: DataFrame, limit: int, operation: str | None = None, status: str | None = None, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest audit entries, of an operation or status if one is given; entries of one time by the later columns of `order`."""
    for c, v in (("operation", operation), ("status", status)):
        if v is not None:
            audit = audit.where(F.col(c) == v)
    return audit.orderBy(*[F.desc(c) for c in order]).limit(int(limit))
