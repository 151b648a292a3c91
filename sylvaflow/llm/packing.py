"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
An open sequence takes the pending example with the largest dot product of its
demand and the sequence's remaining room, each as a share of the limits. Every
task packs what it reads, so nothing is shuffled; only the last sequence of a
task is short. A task keeps a bounded pool of pending examples.

Cases: null text packs as an empty one (its end id alone); null ids pass
through; repeated rows are packed each on its own; an empty table gives no
rows; extra columns are ignored. An example over a limit that may not be cut
has a sequence of its own with ``over_limit`` true.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.common import small_batches, tidied
from sylvaflow.llm.tokens import encoder

LENGTH = 2048
SEGMENTS = 1024
POOL = 256
END_ID = 1


class Packer:
    """Sequences of pieces ``(example, start, length)`` from examples that come one by one."""

    def __init__(self, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH), cut: bool = True, pool: int = POOL):
        self.limits = np.array(limits, dtype=np.float64)
        self.cut = cut
        self.capacity = pool
        self.example = np.zeros(2 * pool, np.int64)
        self.start = np.zeros(2 * pool, np.int64)
        self.demand = np.zeros((2 * pool, 3), np.float64)
        self.n = 0

    def add(self, example: int, tokens: int, loss: int | None = None) -> Iterator[tuple[list[tuple[int, int, int]], bool]]:
        """Take an example; yields each sequence that is complete, and whether it breaks a limit.

        With ``cut`` every token bears loss, so a piece's loss is its length.
        """
        loss = tokens if loss is None else loss
        start = 0
        if self.cut:
            most = int(min(self.limits[0], self.limits[2]))
            while tokens - start >= most:
                yield [(example, start, most)], False
                start += most
            if start == tokens and tokens:
                return
            loss = tokens - start
        elif tokens > self.limits[0] or loss > self.limits[2]:
            yield [(example, 0, tokens)], True
            return
        self._push(example, start, tokens - start, loss)
        while self.n >= self.capacity:
            yield self._fill(), False

    def flush(self) -> Iterator[tuple[list[tuple[int, int, int]], bool]]:
        while self.n:
            yield self._fill(), False

    def _push(self, example: int, start: int, tokens: int, loss: int) -> None:
        self.example[self.n], self.start[self.n] = example, start
        self.demand[self.n] = tokens, 1, loss
        self.n += 1

    def _remove(self, k: int) -> None:
        last = self.n - 1
        self.example[k], self.start[k], self.demand[k] = self.example[last], self.start[last], self.demand[last]
        self.n = last

    def _fill(self) -> list[tuple[int, int, int]]:
        room = self.limits.copy()
        taken = []
        while self.n and room.min() >= 0:
            demand = self.demand[: self.n]
            fits = (demand <= room).all(axis=1)
            value = np.where(fits, demand @ (room / self.limits**2), -1.0)
            k = int(value.argmax())
            if value[k] >= 0:
                taken.append((int(self.example[k]), int(self.start[k]), int(demand[k, 0])))
                room -= demand[k]
                self._remove(k)
                continue
            most = int(min(room[0], room[2]))
            if not self.cut or most < 1 or room[1] < 1:
                break
            k = int(demand[:, 0].argmax())
            taken.append((int(self.example[k]), int(self.start[k]), most))
            self.start[k] += most
            self.demand[k] -= (most, 0, most)
            break
        return taken


def _sequence_base() -> int:
    """Sequence numbers of a task: its partition in the upper bits, so a task that runs again gives the same numbers."""
    return TaskContext.get().partitionId() << 36


def pack_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", kind: str = "word", end_id: int = END_ID, length: int = LENGTH, segments: int = SEGMENTS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Whole texts as pieces of packed sequences.

    Returns per piece ``key``, ``start``, ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``ids`` (unsigned 32-bit little-endian ids).
    """
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        packer = Packer((length, segments, length))
        pending: dict[int, list] = {}
        number, sequence = 0, _sequence_base()
        cols: list[list] = [[] for _ in range(7)]
        pieces = 0

        def place(done: list[tuple[int, int, int]]) -> None:
            nonlocal sequence, pieces
            offset = 0
            for example, start, size in done:
                doc = pending[example]
                for col, value in zip(cols, (doc[0], start, size, len(doc[1]), sequence, offset, doc[1][start : start + size].tobytes())):
                    col.append(value)
                offset += size
                pieces += 1
                doc[2] += size
                if doc[2] == len(doc[1]):
                    del pending[example]
            sequence += 1

        def out() -> pa.RecordBatch:
            nonlocal cols, pieces
            made = pa.record_batch([pa.array(c, t) for c, t in zip(cols, (key_arrow, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=NAMES)
            cols, pieces = [[] for _ in range(7)], 0
            return made

        NAMES = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        key_arrow = pa.int64()
        for batch in batches:
            key_arrow = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 200):
                for name, ids in zip(keys[at : at + 200], enc.encode(texts[at : at + 200])):
                    pending[number] = [name, np.append(ids, np.uint32(end_id)).astype("<u4"), 0]
                    for done, _ in packer.add(number, len(pending[number][1])):
                        place(done)
                    number += 1
                    if pieces >= 2000:
                        yield out()
        for done, _ in packer.flush():
            place(done)
        if pieces:
            yield out()

    schema = f"`{key}` {key_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(key, text).mapInArrow(tidied(run), schema)


def pack_examples(df: DataFrame, key: str, tokens: str, loss: str, length: int = LENGTH, segments: int = 16, loss_tokens: int = LENGTH) -> DataFrame:
    """Whole examples, never cut, under limits on tokens, segments and loss-bearing tokens (instruction data).

    Null or negative sizes count as 0. Returns ``key``, ``tokens``,
    ``loss_tokens``, ``sequence_id``, ``offset``, ``over_limit``.
    """
    small_batches(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((length, segments, loss_tokens), cut=False)
        pending: dict[int, tuple] = {}
        number, sequence = 0, _sequence_base()
        rows: list[tuple] = []
        kind = pa.int64()

        def place(done: list[tuple[int, int, int]], over: bool) -> None:
            nonlocal sequence
            offset = 0
            for example, _, size in done:
                name, bearing = pending.pop(example)
                rows.append((name, size, bearing, sequence, offset, over))
                offset += size
            sequence += 1

        def out() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[key, "tokens", "loss_tokens", "sequence_id", "offset", "over_limit"])
            rows.clear()
            return made

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, size, bearing in zip(*(batch.column(i).to_pylist() for i in range(3))):
                size, bearing = max(size or 0, 0), max(bearing or 0, 0)
                pending[number] = (name, bearing)
                for done, over in packer.add(number, size, bearing):
                    place(done, over)
                number += 1
            if len(rows) >= 2000:
                yield out()
        for done, over in packer.flush():
            place(done, over)
        if rows:
            yield out()

    schema = f"`{key}` {key_type}, tokens long, loss_tokens long, sequence_id long, offset long, over_limit boolean"
    return df.selectExpr(f"`{key}`", f"CAST(`{tokens}` AS LONG)", f"CAST(`{loss}` AS LONG)").mapInArrow(tidied(run), schema)


def conversation_sizes(turns: DataFrame, vocabulary: str = "word_bpe_49k.json", kind: str = "word", end_id: int = END_ID) -> DataFrame:
    """``conv_id``, ``tokens`` and ``loss_tokens`` of whole conversations: every turn is its ids and an end id; loss lies on the turns of the assistant.

    Null texts are empty; a null conversation is one conversation. Turns are
    summed per task before the shuffle, so a long conversation is no hot key.
    """
    small_batches(turns.sparkSession)
    key = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        for batch in batches:
            sizes = [len(ids) + 1 for ids in enc.encode(batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["conv_id", "role", "n"])

    sized = turns.select("conv_id", "role", "text").mapInArrow(tidied(run), f"conv_id {key}, role string, n long")
    bearing = F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0))
    return sized.groupBy("conv_id").agg(F.sum("n").alias("tokens"), bearing.alias("loss_tokens"))


def pack_conversations(turns: DataFrame, length: int = LENGTH, segments: int = 16, loss_tokens: int = LENGTH // 2) -> DataFrame:
    """Whole conversations in sequences under limits on tokens, conversations and tokens that bear loss at once."""
    return pack_examples(conversation_sizes(turns), "conv_id", "tokens", "loss_tokens", length, segments, loss_tokens)
