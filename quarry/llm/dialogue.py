"""Repair of conversation structure by a dynamic programme over turns, many conversations at once.

A repaired conversation's roles begin with those of `(s?(ua)+)?`, so four states
(nothing yet, after s, after u, after a) tell what may follow.  Rows are kept, given
another role, deleted or preceded by inserted ones, at costs.  Conversations are
bucketed by length and laid out time-major in NumPy tensors: going back from the end,
each turn updates the costs to the end of all states of all conversations at once;
these costs are stored, and going forward each conversation takes at each turn the
ASCII-least edit that the stored costs show to be cheapest.

Rows are range-sorted by conversation and turn.  A conversation that lies inside a
partition is settled there.  The first and the last of a partition, which may go on
in others, and those over LONG rows or LONG_BYTES are cut into stretches of BLOCK rows:
a stretch's costs from each state to each are a matrix, so the costs at its end and
the state at its start follow from its neighbours' alone, and all stretches are
traced at the same time.  Only the digest of a repaired conversation, which is a
chain by definition, takes its rows one after the other, in bounded memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import _tiles

#: Rows and bytes up to which a conversation is settled as a whole; rows and bytes of a stretch of a longer one; rows and bytes that are settled at once.
LONG, LONG_BYTES, BLOCK, BLOCK_BYTES, AT_ONCE, AT_ONCE_BYTES = 4096, 8 << 20, 1024, 4 << 20, 1 << 15, 16 << 20
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60
#: The state that a row leads to if it is kept, by role (s, u, a, other) and state (4: it may not be), and if it gets the role that is due, or is an inserted one.
KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
DUE = np.array([2, 2, 3, 2])
NAMES = {2: "user", 3: "assistant"}


def relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs of states if rows may be inserted first."""
    for _ in range(3):
        cost = np.minimum(cost, cost[..., DUE] + INSERT)
    return cost


#: Costs at the end: nothing or an assistant's row stands last.
END = relaxed(np.array([0, NEVER, NEVER, 0]))


class Tensor:
    """Conversations or stretches of like length, by turn; `role` 0 to 3, `gone` rows must be deleted, `cut` ones cost more."""

    def __init__(self, role: np.ndarray, gone: np.ndarray, cut: np.ndarray, first: np.ndarray, size: np.ndarray):
        turn = np.arange(size.max(initial=0))[:, None]
        self.live = turn < size
        at = np.where(self.live, first + turn, first[:1] if len(first) else 0)
        self.role, self.gone, self.more = role[at], gone[at], np.where(cut[at], TRUNCATED, 0)

    def back(self, end: np.ndarray) -> np.ndarray:
        """Costs from each turn on, by turn, conversation and state (with any axes of `end` between), given those at the end."""
        out = np.empty((len(self.live) + 1, *end.shape), np.int64)
        out[-1] = end
        mid = (slice(None), *[None] * (end.ndim - 2))
        for t in range(len(self.live) - 1, -1, -1):
            after = out[t + 1]
            wide = np.concatenate([after, np.full((*after.shape[:-1], 1), NEVER)], axis=-1)
            keep = np.take_along_axis(wide, np.broadcast_to(KEPT[self.role[t]][(*mid, slice(None))], after.shape), -1)
            stay = np.minimum(keep, after[..., DUE] + REROLE) + self.more[t][(*mid, None)]
            best = np.where(self.gone[t][(*mid, None)], after, np.minimum(after, stay - DELETE)) + DELETE
            out[t] = np.where(self.live[t][(*mid, None)], relaxed(best), after)
        return out

    def trace(self, cost: np.ndarray, state: np.ndarray):
        """Each turn's inserted rows before it, its edit, the state before and after them, and the last states; `state` has the starts, of shape (conversations, any)."""
        shape = (len(self.live), *state.shape)
        inserted, edit, before, after = np.zeros(shape, np.int8), np.zeros(shape, np.uint8), np.zeros(shape, np.int8), np.zeros(shape, np.int8)
        of = lambda costs, s: np.take_along_axis(costs, s, -1)
        for t in range(len(self.live)):
            here, there, live = cost[t], cost[t + 1], self.live[t][:, None]
            before[t] = state
            for _ in range(3):
                now = of(here, state)
                more = live & (of(there, state) + DELETE != now) & (of(here, DUE[state]) + INSERT == now)
                state = np.where(more, DUE[state], state)
                inserted[t] += more
            now = of(here, state)
            delete = of(there, state) + DELETE == now
            kept = np.take_along_axis(KEPT[self.role[t]], state, 1)
            keep = ~delete & ~self.gone[t][:, None] & (kept < 4) & (of(there, np.minimum(kept, 3)) + self.more[t][:, None] == now)
            edit[t] = np.where(live, np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R"))), 0)
            state = np.where(live & ~delete, np.where(keep, np.minimum(kept, 3), DUE[state]), state)
            after[t] = state
        return inserted, edit, before, after, state


def buckets(size: np.ndarray):
    """Numbers of conversations, by powers of two of their length."""
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for v in np.unique(level).tolist():
        own = np.flatnonzero(level == v)
        step = max(1, AT_ONCE * 4 >> v)
        for a in range(0, len(own), step):
            yield own[a : a + step]


def last_inserts(state: int) -> int:
    """Rows to insert at the end of a conversation."""
    n = 0
    while END[state] and END[state] < NEVER:
        state, n = DUE[state], n + 1
    return n


def lines(state: int, inserted: int) -> list[str]:
    """Inserted rows as role and empty text, from a state on."""
    out = []
    for _ in range(inserted):
        state = int(DUE[state])
        out.append(f"{NAMES[state]}:")
    return out


class Edits:
    """Cheapest edits of conversations: their costs, and for each row inserted rows, edit and states."""

    def __init__(self, role, gone, cut, first, size, end=None, start=None):
        n = int(size.sum())
        self.inserted, self.edit, self.before, self.after = np.zeros(n, np.int8), np.zeros(n, np.uint8), np.zeros(n, np.int8), np.zeros(n, np.int8)
        self.cost, self.last = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for own in buckets(size):
            x = Tensor(role, gone, cut, first[own], size[own])
            cost = x.back(np.broadcast_to(END, (len(own), 4)) if end is None else end[own])
            begin = np.zeros(len(own), np.int64) if start is None else start[own]
            inserted, edit, before, after, state = x.trace(cost, begin[:, None])
            turn, place = np.nonzero(x.live)
            at = first[own][place] + turn
            for a, b in ((self.inserted, inserted), (self.edit, edit), (self.before, before), (self.after, after)):
                a[at] = b[turn, place, 0]
            self.cost[own], self.last[own] = cost[0][np.arange(len(own)), begin], state[:, 0]


CODES = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = "rid long, block long, turn long, role string, text string, empty boolean, cut boolean"


def settled(rows: pa.Table, first: list[int]) -> dict:
    """Result columns of whole conversations, which begin at the rows `first`."""
    turns, roles, texts, empty, cut = (rows.column(c).to_pylist() for c in ("turn", "role", "text", "empty", "cut"))
    ends = [*first[1:], len(roles)]
    gone = np.array(empty, bool)
    for a, z in zip(first, ends):
        seen = set()
        for i in range(a, z):
            if not empty[i]:
                one = (roles[i], texts[i])
                gone[i] = one in seen
                seen.add(one)
    cut = np.array(cut, bool) & ~gone
    role = np.array([CODES.get(r[:1], 3) for r in roles], np.int64)
    e = Edits(role, gone, cut, np.array(first, np.int64), np.diff(np.array([*first, len(roles)])))
    out = {c.split()[0]: [] for c in RESULT.split(", ")}
    for k, (a, z) in enumerate(zip(first, ends)):
        known = [t for t in turns[a:z] if t is not None]
        audit, said = [], []
        for i in range(a, z):
            n, what = int(e.inserted[i]), chr(e.edit[i])
            audit.append("I" * n + what)
            said += lines(int(e.before[i]), n)
            if what != "D":
                said.append(f"{roles[i] if what == 'K' else NAMES[int(e.after[i])]}:{texts[i]}")
        n = last_inserts(int(e.last[k]))
        said += lines(int(e.last[k]), n)
        bare = sum(empty[a:z])
        own = [
            max(known) - min(known) + 1 - len(set(known)) if known else 0, bare, int(gone[a:z].sum()) - bare, int(cut[a:z].sum()),
            sum(x[:1] + y[:1] not in LEGAL for x, y in zip(roles[a:z], roles[a + 1 : z])), int(e.cost[k]), "".join(audit) + "I" * n, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        ]
        for c, v in zip(out, own):
            out[c].append(v)
    return out


def _settle(batches):
    """Rows of a sorted partition: results of the conversations inside it, and the rows of the others with their stretch."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("no", pa.bool_()), ("conv", pa.int64())])
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    result, row = ([(n, types[t]) for n, t in (c.split() for c in s.split(", "))] for s in (RESULT, ROW))
    full = pa.schema([*schema, *result, *row])
    ready, first, have, weight = [], [], 0, 0
    held, rows, size, open_ = [], 0, 0, True
    block, inside, filled, rid, last = part << 32, 0, 0, part << 40, None

    def bytes_of(b):
        return b.column(b.schema.get_field_index("text")).nbytes

    def finish():
        nonlocal ready, first, have, weight
        if ready:
            t = pa.Table.from_batches(ready).combine_chunks()
            got, at = settled(t, first), pa.array(first)
            cols = [t.column("no").take(at).combine_chunks(), t.column("conv").take(at).combine_chunks(), *(pa.array(got[n], ty) for n, ty in result), *(pa.nulls(len(first), ty) for _, ty in row)]
            yield pa.RecordBatch.from_arrays(cols, schema=full)
        ready, first, have, weight = [], [], 0, 0

    def spilled():
        """The held rows, dealt into stretches."""
        nonlocal held, rows, size, block, inside, filled, rid
        for b in held:
            text = b.column(b.schema.get_field_index("text"))
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]).tolist() if len(text) else []
            blocks = np.zeros(len(sizes), np.int64)
            for i, s in enumerate(sizes):
                if inside and (inside >= BLOCK or filled + s > BLOCK_BYTES):
                    block, inside, filled = block + 1, 0, 0
                blocks[i], inside, filled = block, inside + 1, filled + s
            own = {"rid": pa.array(np.arange(rid, rid + len(sizes))), "block": pa.array(blocks)}
            rid += len(sizes)
            get = lambda n: own[n] if n in own else b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.nulls(len(sizes), ty) for _, ty in result), *(get(n) for n, _ in row)], schema=full)
        held, rows, size = [], 0, 0

    for b in batches:
        if not b.num_rows:
            continue
        no, conv = np.asarray(b.column(0)), np.asarray(b.column(1).fill_null(0))
        edge = np.flatnonzero((no[1:] != no[:-1]) | (conv[1:] != conv[:-1])) + 1
        cuts = [0, *edge.tolist(), b.num_rows]
        for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if last is not None and (no[a], conv[a]) != last:
                if open_:
                    yield from spilled()
                    block, inside, filled = block + 1, 0, 0
                else:
                    first.append(have)
                    ready, have, weight = ready + held, have + rows, weight + size
                    if have >= AT_ONCE or weight >= AT_ONCE_BYTES:
                        yield from finish()
                held, rows, size, open_ = [], 0, 0, False
            last = (no[a], conv[a])
            x = b.slice(a, z - a)
            held.append(x)
            rows, size = rows + z - a, size + bytes_of(x)
            if rows > LONG or size > LONG_BYTES:
                open_ = True
            if open_:
                yield from spilled()
    yield from spilled()
    yield from finish()


def damaged(rows: DataFrame) -> DataFrame:
    """no (conv_id is null), conv, turn, role, text of rows(conv_id, turn, role, text) after the damage that their crc32 deals; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    out = rows.select(F.col("conv_id").isNull().alias("no"), F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), deal.alias("deal")).where("deal <> 0")
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = out.select("no", "conv", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("deal") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, faults, cost, audit and repaired_sha256 of each conversation of rows(no, conv, turn, role, text), as damaged() gives them.

    Rows stand by turn, nulls first; those of one turn by a hash of role and text,
    so equal rows are neighbours.  A role's first character is its initial; an empty
    role has none and is legal beside nothing.  No rows give no rows.
    """
    rows = rows.withColumn("empty", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    end = F.right(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), F.lit(1))
    rows = rows.withColumn("cut", ~F.col("empty") & ~end.isin(".", "!", "?")).withColumn("tie", F.xxhash64("role", "text"))
    # Equal rows are interchangeable, so a number of each lets a common one be split.
    order = ["no", "conv", "turn", "tie"]
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(common.partitions_for(rows, 1), *order, "salt").sortWithinPartitions(*order, "role", "text", "salt")
    done = ranged.select("no", "conv", "turn", "role", "text", "empty", "cut").mapInArrow(_settle, f"no boolean, conv long, {RESULT}, {ROW}")
    done = common.written(done, "dialogue-settled")
    names = [c.split()[0] for c in RESULT.split(", ")]
    whole = done.where("rid IS NULL").select(F.when(~F.col("no"), F.col("conv")).alias("conv_id"), *names)
    long_ = done.where("rid IS NOT NULL").select("no", F.coalesce("conv", F.lit(0)).alias("conv"), *[c.split()[0] for c in ROW.split(", ")])
    return whole.union(_stretched(long_).select(F.when(~F.col("no"), F.col("conv")).alias("conv_id"), *names))


def _blocks(batches):
    """Rows of whole stretches, some at a time: columns as arrays, and where each stretch begins."""
    held, have = [], 0

    def out():
        t = pa.concat_tables(held).combine_chunks()
        block = np.asarray(t.column("block"))
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        return t, first, np.diff(np.append(first, len(block)))

    for t in _tiles(batches, ("block",)):
        held.append(t)
        have += t.num_rows
        if have >= AT_ONCE:
            yield out()
            held, have = [], 0
    if held:
        yield out()


def _arrays(t):
    return (np.asarray(t.column(c)) for c in ("role", "gone", "short"))


def _long_array(x: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).astype(np.int64)))


def _stretched(rows: DataFrame) -> DataFrame:
    """no, conv and results of conversations whose rows lie in several stretches."""
    key = ["no", "conv"]
    digest = F.xxhash64("role").alias("r"), F.sha2("text", 256).alias("d")
    live = rows.where("NOT empty").select(*key, *digest, "rid")
    first = live.groupBy(*key, "r", "d").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = common.written(live.join(common.written(first, "dialogue-first").hint("merge"), [*key, "r", "d"]).where("rid > first").select(F.col("rid").alias("again")), "dialogue-again")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("long")
    flags = rows.select(*key, "block", "rid", "turn", code.alias("role"), initial.alias("initial"), "empty", "cut").join(again, F.col("rid") == F.col("again"), "left")
    flags = flags.withColumn("gone", F.col("empty") | F.col("again").isNotNull()).withColumn("short", F.col("cut") & ~F.col("gone")).drop("again", "cut")
    flags = common.written(flags, "dialogue-flags")
    by_block = lambda df: df.repartition("block").sortWithinPartitions("block", "rid")

    def crossed(batches):
        """Each stretch's costs from state to state, and its first and last initial."""
        for t, first, size in _blocks(batches):
            m = np.zeros((len(first), 4, 4), np.int64)
            unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
            for own in buckets(size):
                x = Tensor(*_arrays(t), first[own], size[own])
                m[own] = x.back(np.broadcast_to(unit, (len(own), 4, 4)))[0]
            at, end = pa.array(first), pa.array(first + size - 1)
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(at).combine_chunks() for c in ("no", "conv", "block")), _long_array(m.reshape(-1, 16)), t.column("initial").take(at).combine_chunks(), t.column("initial").take(end).combine_chunks()], ["no", "conv", "block", "m", "head", "foot"])

    crossing = by_block(flags).mapInArrow(crossed, "no boolean, conv long, block long, m array<long>, head string, foot string")
    crossing = common.written(crossing, "dialogue-crossing")

    def backward(batches):
        """Costs at the end of each stretch, from the last stretch of a conversation on."""
        last, cost, head = None, None, None
        for b in batches:
            out = []
            for no, conv, block, m, h, f in zip(*(c.to_pylist() for c in b.columns)):
                final = (no, conv) != last
                end = END if final else cost
                bad = int(not final and f + head not in LEGAL)
                # m has a row for each state at the end.
                cost = relaxed((np.array(m).reshape(4, 4) + end[:, None]).min(0))
                last, head = (no, conv), h
                out.append((block, end.tolist(), final, bad, int(cost[0])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["block", "end", "final", "bad", "whole"])

    ends = crossing.repartition(*key).sortWithinPartitions(*key, F.desc("block")).mapInArrow(backward, "block long, end array<long>, final boolean, bad long, whole long")
    ends = common.written(ends, "dialogue-ends")

    def mapped(batches):
        """The state that each stretch ends in, by the state it begins in."""
        for t, first, size in _blocks(batches):
            end = np.asarray(t.column("end").combine_chunks().flatten()).reshape(-1, 4)[first]
            to = np.zeros((len(first), 4), np.int64)
            for own in buckets(size):
                x = Tensor(*_arrays(t), first[own], size[own])
                to[own] = x.trace(x.back(end[own]), np.broadcast_to(np.arange(4), (len(own), 4)))[-1]
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(at).combine_chunks() for c in ("no", "conv", "block")), _long_array(to)], ["no", "conv", "block", "to"])

    def forward(batches):
        """The state that each stretch begins in."""
        last, state = None, 0
        for b in batches:
            out = []
            for no, conv, block, to in zip(*(c.to_pylist() for c in b.columns)):
                begun = (no, conv) != last
                state = 0 if begun else state
                out.append((block, state, begun))
                last, state = (no, conv), to[state]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["block", "start", "begun"])

    joined = flags.join(ends.select("block", "end", "final"), "block")
    to = by_block(joined.select(*key, "block", "rid", "role", "gone", "short", "end")).mapInArrow(mapped, "no boolean, conv long, block long, to array<long>")
    starts = to.repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(forward, "block long, start long, begun boolean")
    starts = common.written(starts, "dialogue-starts")

    def traced(batches):
        """Each row's edits as letters, the lines they add before and after it, and its role (null: deleted)."""
        for t, first, size in _blocks(batches):
            end = np.asarray(t.column("end").combine_chunks().flatten()).reshape(-1, 4)[first]
            e = Edits(*_arrays(t), first, size, end, np.asarray(t.column("start"))[first])
            final, last = np.asarray(t.column("final"))[first], {}
            for i, f, s in zip((first + size - 1).tolist(), final.tolist(), e.last.tolist()):
                if f:
                    last[i] = lines(s, last_inserts(s))
            edits, before, role, after = [], [], [], []
            for i, (n, what, s, z) in enumerate(zip(e.inserted.tolist(), e.edit.tolist(), e.before.tolist(), e.after.tolist())):
                tail = last.get(i, [])
                edits.append("I" * n + chr(what) + "I" * len(tail))
                before.append("".join(f"{x}\n" for x in lines(s, n)))
                after.append("".join(f"{x}\n" for x in tail))
                role.append({"D": None, "K": ""}.get(chr(what), NAMES.get(z)))
            yield pa.RecordBatch.from_arrays([t.column("rid").combine_chunks(), *(pa.array(c, pa.string()) for c in (edits, before, role, after))], ["rid", "edits", "lead", "given", "tail"])

    joined = joined.join(starts.select("block", "start"), "block")
    edits = by_block(joined.select("block", "rid", "role", "gone", "short", "end", "final", "start")).mapInArrow(traced, "rid long, edits string, lead string, given string, tail string")
    edits = common.written(edits, "dialogue-edits")

    def digested(batches):
        """The digest and the audit of each conversation, its rows one after the other."""
        last, sha, audit, begun = None, None, [], False
        for b in batches:
            for no, conv, piece, letters in zip(*(c.to_pylist() for c in b.columns)):
                if (no, conv) != last:
                    if last is not None:
                        yield out(last, sha, audit)
                    last, sha, audit, begun = (no, conv), hashlib.sha256(), [], False
                # A piece ends each of its lines, of which the last of all has no end.
                if piece:
                    sha.update((("\n" if begun else "") + piece[:-1]).encode())
                    begun = True
                audit.append(letters)
        if last is not None:
            yield out(last, sha, audit)

    def out(at, sha, audit):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.bool_()), pa.array([at[1]], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["no", "conv", "audit", "repaired_sha256"])

    name = F.when(F.col("given") == "", F.col("role")).otherwise(F.col("given"))
    piece = F.concat("lead", F.coalesce(F.concat(name, F.lit(":"), "text", F.lit("\n")), F.lit("")), "tail")
    said = rows.select(*key, "rid", "role", "text").join(edits, "rid").select(*key, "rid", piece.alias("piece"), "edits")
    said = said.repartition(*key).sortWithinPartitions(*key, "rid").select(*key, "piece", "edits").mapInArrow(digested, "no boolean, conv long, audit string, repaired_sha256 string")

    # Neighbours inside a stretch, by a window over it; those of two stretches were counted above.
    pair = F.concat(F.lag("initial").over(Window.partitionBy("block").orderBy("rid")), "initial")
    bad = flags.withColumn("pair", pair).groupBy("block").agg(F.count_if(~F.col("pair").isin(*sorted(LEGAL))).alias("inside"))
    blocks = crossing.select(*key, "block").join(ends.select("block", "bad", "whole"), "block").join(starts.select("block", "begun"), "block").join(bad, "block")
    counts = blocks.groupBy(*key).agg((F.sum("bad") + F.sum("inside")).alias("illegal"), F.max(F.when(F.col("begun"), F.col("whole"))).alias("cost"))
    n = lambda c: F.count_if(c)
    faults = flags.groupBy(*key).agg(n(F.col("empty")).alias("blank"), n(F.col("gone") & ~F.col("empty")).alias("duplicate"), n(F.col("short")).alias("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    turns = flags.where("turn IS NOT NULL").select(*key, "turn").distinct().groupBy(*key).agg(F.count("*").alias("turns"))
    both = faults.join(turns, key, "left").withColumn("gaps", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)))
    return both.join(counts, key).join(said, key)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "own")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    names = [c.split()[0] for c in RESULT.split(", ")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in names])


_STEP = "list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda z: -1)"

#: By crc32 bit by bit, and a recursion over turns that keeps the least (cost, audit) of each state.
OP12_SQL = rf"""
WITH RECURSIVE c AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k, ''), lambda x: list_prepend(ascii(x), {_STEP})))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS h FROM c),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM h, (SELECT unnest([1, 2]) AS copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM p),
f AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
 CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
due AS (SELECT unnest([0, 1, 2, 3]) AS s, unnest([2, 2, 3, 2]) AS z),
walks AS (SELECT s, 0 AS n, s AS z, '' AS said FROM due UNION ALL SELECT w.s, w.n + 1, due.z, w.said || CASE due.z WHEN 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END FROM walks w JOIN due ON w.z = due.s WHERE w.n < 2),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS said FROM f
 UNION ALL
 SELECT conv_id, i, s, cost, audit, said FROM (
  SELECT f.conv_id, f.i, y.s, y.cost, y.audit, y.said, row_number() OVER (PARTITION BY f.conv_id, y.s ORDER BY y.cost, y.audit) AS best
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN walks w ON w.s = r.s, LATERAL (
   SELECT w.z AS s, r.cost + 2 * w.n + 3 AS cost, r.audit || repeat('I', w.n) || 'D' AS audit, r.said || w.said AS said
   UNION ALL SELECT CASE f.role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, r.cost + 2 * w.n + CAST(f.fault = 't' AS INT), r.audit || repeat('I', w.n) || 'K', r.said || w.said || chr(10) || f.role || ':' || f.text
    WHERE f.fault NOT IN ('b', 'd') AND ((f.role[1] = 's' AND w.z = 0) OR (f.role[1] = 'u' AND w.z IN (0, 1, 3)) OR (f.role[1] = 'a' AND w.z = 2))
   UNION ALL SELECT due.z, r.cost + 2 * w.n + 2 + CAST(f.fault = 't' AS INT), r.audit || repeat('I', w.n) || 'R', r.said || w.said || chr(10) || CASE due.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text
    FROM due WHERE due.s = w.z AND f.fault NOT IN ('b', 'd')) y) WHERE best = 1),
e AS (SELECT r.conv_id, r.cost + 2 * w.n AS cost, r.audit || repeat('I', w.n) AS audit, r.said || w.said AS said,
 row_number() OVER (PARTITION BY r.conv_id ORDER BY r.cost + 2 * w.n, r.audit || repeat('I', w.n)) AS best
 FROM r JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.n = r.i JOIN walks w ON w.s = r.s WHERE w.z IN (0, 3)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id AND best = 1
"""
