"""Repair of the structure of conversations: faults of turns, and the cheapest edits that give legal roles.

A repaired conversation is empty, or an optional system turn and then pairs of
user and assistant. Every turn is one symbol (its role and its first fault).
Equal symbols that follow each other are one run; a run of k symbols advances
the costs by the k-th power of the symbol's min-plus transition matrix over
four states, put together from binary powers that are computed once per
worker. The costs to go at the borders of the runs are enough to unroll the
choices forward, block by block, so that ties fall to the audit that is least.

Faults are found by windows after one shuffle by conversation. A symbol takes
a byte and the audit of a conversation is one value with a letter a turn, so
the edits of one conversation are chosen in one task, from its symbols alone.
Texts meet their edits in a second pass that streams the sorted turns of a
conversation through a task and keeps one batch of them.

Cases: a null role or text counts as one space; a null conversation is one
conversation; null turns come first. Turns that are equal (rows with the same
turn) are ordered by role and text. Rows for which ``present`` is false count
only as a sign that the conversation exists. All other columns are ignored and
may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaflow.llm.common import small_batches, tidied, written

#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: White space of the fault rules.
SPACES = " \t\n\x0b\x0c\r"
LEGAL = ["su", "ua", "au"]

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired turns so far end with
TURN_OF = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the turn that an insertion or a new role gives
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
FAR = 1 << 60
BLOCK = 1024  # turns of a run that are unrolled at a time
FAULTS = ["blank", "duplicate", "truncated"]


def diagnosed(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id``, ``present``, ``turn``, ``role``, ``text``, ``head`` (first row of its conversation), ``fault``, ``initial``, ``illegal`` and ``new_turn``, sorted inside conversations.

    Both windows run on one shuffle by conversation.
    """
    base = rows.select(
        "conv_id", (F.lit(True) if present is None else present).alias("present"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    order = [F.col("present").desc(), F.col("turn").asc_nulls_first()]
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*order)) > 1
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    inside = Window.partitionBy("conv_id").orderBy(*order, "role", "text", "seen")  # of equal rows the first one is not a duplicate
    flagged = base.withColumn("seen", seen).withColumn("fault", fault).withColumn("initial", initial)
    pair = F.concat(F.lag("initial").over(inside), F.col("initial"))
    same_turn = F.lag("turn").over(inside) == F.col("turn")
    return flagged.select(
        "conv_id", "present", "turn", "role", "text", "seen", "fault", "initial",
        (F.row_number().over(inside) == 1).alias("head"),
        (F.col("present") & F.coalesce(~pair.isin(*LEGAL), F.lit(False))).alias("illegal"),
        (F.col("present") & F.col("turn").isNotNull() & ~F.coalesce(same_turn, F.lit(False))).alias("new_turn"),
    ).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order, "role", "text", "seen")


# ---- the min-plus transitions -------------------------------------------------


def moves(symbol: int) -> dict[str, list[tuple[int, int]]]:
    """For Delete, Keep and Rerole: (cost, next state) from every state.

    Symbol 0 is a turn that must go; others are 1 + 2 * (place of the initial in ``sua``, 3 for others) + truncated.
    """
    out = {"D": [(DELETE, state) for state in range(4)], "K": [(FAR, EMPTY)] * 4, "R": [(FAR, EMPTY)] * 4}
    if symbol:
        initial, more = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        out["R"] = [(REROLE + more, TURN_OF[state]) for state in range(4)]
        kept = {0: {EMPTY: SYSTEM}, 1: {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}}.get(initial, {})
        out["K"] = [(KEEP + more, kept[state]) if state in kept else (FAR, EMPTY) for state in range(4)]
    return out


MOVES = [moves(symbol) for symbol in range(9)]


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Min-plus product of two matrices, or of a matrix and a vector."""
    if right.ndim == 1:
        return np.minimum((left + right).min(1), FAR)
    return np.minimum((left[:, :, None] + right[None, :, :]).min(1), FAR)


def inserted() -> np.ndarray:
    """Cheapest insertions from state to state."""
    step = np.full((4, 4), FAR, np.int64)
    for state in range(4):
        step[state, state] = 0
        step[state, TURN_OF[state]] = INSERT
    return product(product(step, step), step)


INSERTED = inserted()
#: Cost to go after the last turn: by insertions to an empty conversation or one that ends with the assistant.
AT_END = np.minimum(INSERTED[:, EMPTY], INSERTED[:, ASSISTANT])


@cache
def power(symbol: int, bit: int) -> np.ndarray:
    """Transition of 2^bit turns of one symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    step = np.full((4, 4), FAR, np.int64)
    for choices in MOVES[symbol].values():
        for state, (cost, then) in enumerate(choices):
            step[state, then] = min(step[state, then], cost)
    return product(INSERTED, step)


def advance(symbol: int, times: int, to_go: np.ndarray) -> np.ndarray:
    """Costs to go before ``times`` turns of a symbol, from those after them."""
    bit = 0
    while times >> bit:
        if times >> bit & 1:
            to_go = product(power(symbol, bit), to_go)
        bit += 1
    return to_go


def cheapest(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Least cost of a conversation given as (symbol, times) runs, and its least audit."""
    borders = np.empty((len(runs) + 1, 4), np.int64)
    borders[-1] = AT_END
    for k in range(len(runs) - 1, -1, -1):
        borders[k] = advance(*runs[k], borders[k + 1])
    state, audit = EMPTY, bytearray()
    for k, (symbol, times) in enumerate(runs):
        left = times
        while left:
            block = min(left, BLOCK)
            to_go = [advance(symbol, left - block, borders[k + 1])]
            for _ in range(block):
                to_go.append(product(power(symbol, 0), to_go[-1]))
            table = [v.tolist() for v in reversed(to_go)]
            for now, after in zip(table, table[1:]):
                state = _unroll(symbol, state, now, after, audit)
            left -= block
    while state not in (EMPTY, ASSISTANT):
        audit += b"I"
        state = TURN_OF[state]
    return int(borders[0, EMPTY]), audit.decode()


def _unroll(symbol: int, state: int, now: list[int], after: list[int], audit: bytearray) -> int:
    """The first edits in the alphabet that keep the least cost, up to the one that takes the turn; the state after it."""
    choices = MOVES[symbol]
    while True:
        cost, then = choices["D"][state]
        if cost + after[then] == now[state]:
            audit += b"D"
            return then
        if INSERT + now[TURN_OF[state]] == now[state]:
            audit += b"I"
            state = TURN_OF[state]
            continue
        cost, then = choices["K"][state]
        if cost + after[then] == now[state]:
            audit += b"K"
            return then
        cost, then = choices["R"][state]
        audit += b"R"
        return then


# ---- edits of a conversation ---------------------------------------------------


class _Conversation:
    """Running counts and runs of the conversation that a task reads."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.least = self.most = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.runs: list[list[int]] = []

    def add(self, turn, fault, initial, illegal, new_turn) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += new_turn
        self.illegal += illegal
        if fault:
            self.faults[fault] += 1
        symbol = 0
        if fault in (None, "truncated"):
            symbol = 1 + 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + (fault is not None)
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])

    def row(self, known: dict) -> tuple:
        runs = tuple(map(tuple, self.runs))
        if runs not in known:
            if len(known) > 20_000:
                known.clear()
            best = cheapest(list(runs))
            if len(runs) <= 64:
                known[runs] = best
        else:
            best = known[runs]
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, *best)


COUNTS = ["gaps", *FAULTS, "illegal", "cost"]


def _choose(batches: Iterator[pa.RecordBatch], names: list[str], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    now: _Conversation | None = None
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done))
        types = [key_type] + [pa.int64()] * len(COUNTS) + [pa.string()]
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        done.clear()
        return out

    for batch in batches:
        for conv_id, present, head, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if head:
                if now is not None:
                    done.append(now.row(known))
                now = _Conversation(conv_id)
            if present:
                now.add(*rest)
        if len(done) > 1000:
            yield flush()
    if now is not None:
        done.append(now.row(known))
    if done:
        yield flush()


def edits(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``."""
    small_batches(rows.sparkSession)
    found = diagnosed(rows, present).select("conv_id", "present", "head", "turn", "fault", "initial", "illegal", "new_turn")
    names = ["conv_id", *COUNTS, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(iter(batches), None)
        if first is not None:

            def whole():
                yield first
                yield from batches

            yield from _choose(whole(), names, first.column(0).type)

    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])
    return found.mapInArrow(tidied(run), schema)


# ---- repaired turns --------------------------------------------------------------


def _apply(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation's audit and then its turns, in order, to the repaired turns."""
    key, audit, at, state, position = None, "", 0, EMPTY, 0
    out: list[tuple] = []

    def put(edit, role, text):
        nonlocal position
        out.append((key, position, edit, role, text))
        position += 1

    def insertions():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = TURN_OF[state], at + 1
            put("I", ROLE[state], "")

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for conv_id, plan, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if plan is not None:
                insertions()
                key, audit, at, state, position = conv_id, plan, 0, EMPTY, 0
                continue
            insertions()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                put(edit, role, text)
            elif edit == "R":
                state = TURN_OF[state]
                put(edit, ROLE[state], text)
        if out:
            yield _turn_batch(out, names, kind)
            out.clear()
    insertions()
    if out:
        yield _turn_batch(out, names, kind)


def _turn_batch(out: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*out))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), pa.string(), pa.string(), pa.string()])], names=names)


def repaired(rows: DataFrame, chosen: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired turns: ``conv_id``, ``position`` (from 0), ``edit`` (K, R or I), ``role``, ``text``, in order inside a conversation; ``chosen`` comes from ``edits`` of the same rows."""
    small_batches(rows.sparkSession)
    turns = rows if present is None else rows.where(present)
    turns = turns.select(
        "conv_id", F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    )
    plans = chosen.select("conv_id", "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))))
    both = plans.unionByName(turns).repartition("conv_id")
    both = both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
    names = ["conv_id", "position", "edit", "role", "text"]
    schema = T.StructType([rows.schema["conv_id"], T.StructField("position", T.LongType()), *(T.StructField(c, T.StringType()) for c in names[2:])])
    return both.select("conv_id", "audit", "role", "text").mapInArrow(tidied(lambda batches: _apply(batches, names)), schema)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256`` of the ``role:text`` of the turns that ``repaired`` gives, joined by line feeds.

    The hash takes the turns in their order as they come from ``repaired``, so this adds no shuffle.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, kind = None, None, None
        done: list[tuple] = []
        for batch in batches:
            kind = batch.column(0).type
            for conv_id, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    if running is not None:
                        done.append((key, running.hexdigest()))
                    key, running = conv_id, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if done:
                yield pa.record_batch([pa.array([k for k, _ in done], kind), pa.array([h for _, h in done])], names=["conv_id", "repaired_sha256"])
                done = []
        if running is not None:
            yield pa.record_batch([pa.array([key], kind), pa.array([running.hexdigest()])], names=["conv_id", "repaired_sha256"])

    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return turns.select("conv_id", "position", "role", "text").mapInArrow(run, schema)


def repair(rows: DataFrame, present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Edits per conversation and the repaired turns; the edits are written to the shared folder, as both results use them."""
    chosen = written(edits(rows, present), "edits")
    return chosen, repaired(rows, chosen, present)


def summary(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The edits of every conversation with the hash of its repaired turns."""
    chosen, turns = repair(rows, present)
    hashes = digests(turns).withColumnRenamed("conv_id", "__of")
    joined = chosen.join(hashes, F.col("conv_id").eqNullSafe(F.col("__of")), "left").drop("__of")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, for trials of the repair: ``conv_id``, ``turn``, ``role``, ``text`` and ``present`` (false for dropped rows).

    By crc32 of ``conv_id:turn`` modulo 20 (a null is one space there, and in role and text): 0 drops the row, 1 empties
    its text, 2 removes its closing marks, 3 repeats it and 4 gives it the role of the user.
    """
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    base = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return base.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.col("code") != 0, F.when(F.col("code") == 3, 2).otherwise(1))).alias("present"),
    )
