"""Limits, circuit breakers and sessions as stream operators with kept state, timers and expiry.

State lives in the state store and outlasts a restart.  Limiters and breakers keep it by
blocks of keys (hashes), so a batch costs a call for each block, not for each key.
Rows of a key that come in one batch are taken in order of time; between batches the
order is that of arrival.  A timer ends what has run its course: a limiter's window is
dropped, a breaker that has rested is reported as half open.  Sessions are Spark's own
session windows.  Results are those of the batch operators for any way that ordered
rows are cut into batches.  Needs the RocksDB state store (`with_state_store`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import runs

BLOCKS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _times(x: pd.Series) -> np.ndarray:
    """Nanoseconds."""
    return x.astype("datetime64[ns]").to_numpy().astype(np.int64)


class _Blocks(StatefulProcessor):
    """State by blocks of keys: one row of arrays and one timer for all keys of a block, so that a batch costs a block, not each of its keys, a call.

    `fields` are what is held of a key, all longs; a subclass takes a key's rows of a batch and says when a key is due.
    """

    fields: tuple[str, ...]

    def __init__(self, key: str, ts: str):
        self.key, self.ts = key, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", ", ".join(["keys array<string>", *(f"{f} array<bigint>" for f in self.fields)]))

    def _held(self) -> dict:
        return {k: x for k, *x in zip(*self.state.get())} if self.state.exists() else {}

    def _keep(self, held: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if not held:
            self.state.clear()
            return
        self.state.update((list(held), *([int(x[i]) for x in held.values()] for i in range(len(self.fields)))))
        at = [t for t in map(self.due, held.values()) if t is not None]
        if at:
            self.handle.registerTimer(min(at))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True)
        codes, keys = pd.factorize(pdf[self.key], use_na_sentinel=False)
        pdf = self.ordered(pdf.assign(_code=codes))
        ends = np.flatnonzero(np.diff(pdf["_code"].to_numpy(), append=-1)) + 1
        t, held = _times(pdf[self.ts]), self._held()
        self.begin(pdf)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            k = keys[pdf["_code"].iat[a]]
            k = k if isinstance(k, str) else None
            held[k] = self.take(held.get(k), t[a:b], slice(a, b))
        self._keep(held)
        yield self.result(pdf)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        held, now = self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = {k: x for k, x in held.items() if (at := self.due(x)) is not None and at <= now}
        told = self.report(over)
        for k, x in over.items():
            if (rest := self.after(x)) is None:
                del held[k]
            else:
                held[k] = rest
        self._keep(held)
        yield told

    def close(self) -> None:
        pass


class Limiter(_Blocks):
    """remaining and allowed of each request; a window opens at the first request after the last one has passed."""

    fields = ("start", "n")

    def __init__(self, key: str, ts: str, limit: int, seconds: int):
        super().__init__(key, ts)
        self.limit, self.gap = limit, seconds * 10**9

    def ordered(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["_code", self.ts], kind="stable", ignore_index=True)

    def begin(self, pdf: pd.DataFrame) -> None:
        self.count = np.zeros(len(pdf), np.int64)

    def take(self, held, t: np.ndarray, at: slice) -> tuple:
        (start, n), i, count = held or (None, 0), 0, self.count[at]
        while i < len(t):  # a window at a time
            if start is None or t[i] - start >= self.gap:
                start, n = int(t[i]), 0
            end = max(i + 1, int(np.searchsorted(t, start + self.gap, "left")))
            count[i:end] = n + 1 + np.arange(end - i)
            n, i = n + end - i, end
        return start, n

    def result(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({self.key: pdf[self.key], self.ts: pdf[self.ts], "remaining": np.maximum(0, self.limit - self.count), "allowed": self.count <= self.limit})

    def due(self, held) -> int:
        return (held[0] + self.gap) // 10**6

    def after(self, held) -> None:
        return None

    def report(self, over: dict) -> pd.DataFrame:
        return pd.DataFrame()


class Breaker(_Blocks):
    """allowed and state of each call of a service; a row with state half_open (and no outcome) once an open breaker has rested."""

    fields = ("open", "bad", "since", "told")

    def __init__(self, service: str, ts: str, ok: str, failures: int, rest: float):
        super().__init__(service, ts)
        self.ok, self.failures, self.rest = ok, failures, int(rest * 1e9)

    def ordered(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["_code", self.ts, self.ok], kind="stable", ignore_index=True)

    def begin(self, pdf: pd.DataFrame) -> None:
        self.good, self.allowed, self.opened = pdf[self.ok].to_numpy(dtype=bool), np.ones(len(pdf), bool), np.zeros(len(pdf), bool)

    def take(self, held, t: np.ndarray, at: slice) -> tuple:
        is_open, bad, since, _ = held or (0, 0, 0, 0)
        return *runs.settled(t, self.good[at], self.allowed[at], self.opened[at], bool(is_open), bad, since, self.failures, self.rest), 0

    def result(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({self.key: pdf[self.key], self.ts: pdf[self.ts], self.ok: pdf[self.ok], "allowed": self.allowed, "state": np.where(self.opened, "open", "closed")})

    def due(self, held) -> int | None:
        return (held[2] + self.rest) // 10**6 if held[0] and not held[3] else None

    def after(self, held) -> tuple:
        return *held[:3], 1

    def report(self, over: dict) -> pd.DataFrame:
        at = [pd.Timestamp(self.due(x), unit="ms") for x in over.values()]
        n = len(over)
        return pd.DataFrame({self.key: list(over), self.ts: at, self.ok: [None] * n, "allowed": [True] * n, "state": ["half_open"] * n}) if n else pd.DataFrame()


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _blocks(rows: DataFrame, key: str, processor: _Blocks, schema: str, blocks: int) -> DataFrame:
    """What a processor makes of rows whose keys, as texts, are dealt into blocks by hash."""
    kind = rows.schema[key].dataType
    if kind.typeName() in ("binary", "timestamp", "array", "map", "struct", "variant"):
        raise ValueError(f"no key that its text gives back: {kind.simpleString()}")
    dealt = rows.withColumn(key, F.col(key).cast("string")).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    out = dealt.groupBy("_block").transformWithStateInPandas(processor, f"`{key}` string, {schema}", "append", "eventTime")
    return out.withColumn(key, F.col(key).cast(kind))


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60, late: str = "0 seconds", blocks: int = BLOCKS) -> DataFrame:
    """key, ts, remaining, allowed of each request of a stream; windows that have passed by event time take no room. `blocks` mustn't change while a checkpoint lasts."""
    rows = _timed(events, ts, late).select(key, ts)
    return _blocks(rows, key, Limiter(key, ts, limit, seconds), f"`{ts}` timestamp, remaining long, allowed boolean", blocks)


def breaker(calls: DataFrame, service: str, ts: str, ok: str, failures: int = runs.FAILURES, rest: float = runs.REST_SECONDS, late: str = "0 seconds", blocks: int = BLOCKS) -> DataFrame:
    """The calls of a stream with allowed and state, and half-open reports; calls without time or outcome are left out. `blocks` mustn't change while a checkpoint lasts."""
    rows = _timed(calls, ts, late).where(F.col(ok).isNotNull()).select(service, ts, ok)
    return _blocks(rows, service, Breaker(service, ts, ok, failures, rest), f"`{ts}` timestamp, `{ok}` boolean, allowed boolean, state string", blocks)


def expired_sessions(events: DataFrame, key: str, ts: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """key, start, last, cnt of sessions of a stream, each once it has been idle for so many seconds of event time; its state is dropped then."""
    rows = _timed(events, ts, late).select(key, ts)
    # Session windows that touch are one; here a row that comes just at the gap's end begins the next.
    held = rows.groupBy(F.session_window(ts, f"{seconds * 10**6 - 1} microseconds"), key).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("cnt"))
    return held.select(key, "start", "last", "cnt")
