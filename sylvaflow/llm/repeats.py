"""Exact removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else. Every start of such a string picks, among the q-grams inside the
string, the one with the smallest hash (its anchor), so equal strings pick the
same anchor at the same distance, and only anchors need to be bucketed:

1. Initial buckets: anchors by q-gram. An anchor that is alone is done. One
   whose whole surroundings (all starts that picked it) occur again is repeated
   as a whole; the others of its bucket are open.
2. Refinement: an open bucket is sorted on the identifiers of the q-gram blocks
   at later offsets, one after the other; the refined bucket numbers are used
   again for the next offset, and anchors that stay alone drop out. The same is
   done to the left. What is left of each anchor is the range of starts that
   can still have an equal; their strings decide.

A bucket with more open anchors than fit one task is decided by a join on the
hash of the strings instead, which spreads over keys and splits when skewed.

Cases: null counts as empty; matches never cross rows; repeated rows are
repeats of each other; empty table: no rows; extra columns are ignored; rows
with a null id are kept as they are any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.common import bitmap_slot, blocks, cut_points, id_bitmap, mix, only_marked, pack_sorted, partitions_for, prefix_hash, range_hash, small_batches, text_bytes, text_column, Texts, tidied, tidy, unpack_sorted, written

LENGTH = 400
GRAM = 32
OPEN_IN_TASK = 2048
ANCHORS_AT_ONCE = 512
BUCKET_TEXT = 32 << 20


def anchors(texts: Texts, length: int = LENGTH, q: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of a block: position, first and last start that picked it, q-gram hash, hash of the surroundings."""
    data = texts.data
    none = np.zeros(0, np.int64)
    if len(data) <= length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - q + 1)
    gram = mix(range_hash(prefix, at, at + q))
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    reach, width = 1, length - q + 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(len(chosen) + 1, np.int32)
    long_enough = texts.end - texts.start >= length
    np.add.at(change, texts.start[long_enough], 1)
    np.add.at(change, np.minimum(texts.end[long_enough] - length + 1, len(chosen)), -1)
    inside = np.cumsum(change[:-1]) > 0
    border = np.ones(len(chosen), bool)
    border[1:] = (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(border)
    last = np.append(first[1:], len(chosen)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    position = chosen[first]
    around = range_hash(prefix, first, last + length) + (position - first).astype(np.uint64) * np.uint64(1_000_003) + (last - first).astype(np.uint64)
    return position, first, last, gram[position], mix(around)


PLACE = np.dtype([("around", "<u8"), ("position", "<i8"), ("before", "<u2"), ("starts", "<u2")])


def _send_anchors(buckets: int, length: int, q: int):
    """Per batch and bucket: sorted q-gram hashes, the place of each anchor, and its row by number in a list of row keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for row, texts in blocks(text_column(batch)):
                position, first, last, gram, around = anchors(texts, length, q)
                owner = np.searchsorted(texts.start, first, side="right") - 1
                place = np.zeros(len(gram), PLACE)
                place["around"], place["position"] = around, position - texts.start[owner]
                place["before"], place["starts"] = position - first, last - first
                held.append((gram, place, rid[row + owner]))
                size += len(gram)
            if size > 200_000:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)
        held = []
        tidy()

    def out(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, place, rid = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.argsort(gram, kind="stable")
        gram, place, rid = gram[order], place[order], rid[order]
        cut = cut_points(gram, buckets)
        rows: list[list] = [[] for _ in range(5)]
        for b in np.flatnonzero(np.diff(cut)).tolist():
            mine = slice(cut[b], cut[b + 1])
            some, number = np.unique(rid[mine], return_inverse=True)
            for col, value in zip(rows, (b, pack_sorted(gram[mine]), place[mine].tobytes(), some.tobytes(), number.astype(np.uint32).tobytes())):
                col.append(value)
        return pa.record_batch([pa.array(rows[0], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["bucket", "grams", "places", "rids", "numbers"])

    return run


def _first_buckets(length: int, most: int):
    """Repeated surroundings as spans (kind 0); open anchors of small buckets (1), of large ones (2); one copy of each repeated surrounding that an open anchor may equal in part is open too (3, 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, places, rids = [], [], []
        for batch in batches:
            for g, p, r, n in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                grams.append(unpack_sorted(g))
                places.append(np.frombuffer(p, PLACE))
                rids.append(np.frombuffer(r, np.int64)[np.frombuffer(n, np.uint32)])
        if not grams:
            return
        gram, place, rid = np.concatenate(grams), np.concatenate(places), np.concatenate(rids)
        del grams, places, rids
        order = np.lexsort((place["around"], gram))
        gram, place, rid = gram[order], place[order], rid[order]
        group = np.cumsum(np.append(False, gram[1:] != gram[:-1]))
        alone = np.bincount(group)[group] == 1
        fresh = np.append(True, (place["around"][1:] != place["around"][:-1]) | (gram[1:] != gram[:-1]))
        surround = np.cumsum(fresh) - 1
        whole = np.bincount(surround)[surround] > 1
        open_ = ~alone & ~whole
        n_open = np.bincount(group, weights=open_)
        copy = fresh & whole & (n_open[group] > 0)
        held = np.bincount(group, weights=open_ | copy)
        large = held[group] > most
        for kind, rows in ((0, whole), (1, open_ & ~large), (2, open_ & large), (3, copy & ~large), (4, copy & large)):
            rows = np.flatnonzero(rows)
            for at in range(0, len(rows), 100_000):
                r = rows[at : at + 100_000]
                first = place["position"][r] - place["before"][r]
                yield pa.record_batch(
                    [pa.array(np.full(len(r), kind, np.int64)), pa.array(rid[r]), pa.array(gram[r].view(np.int64)), pa.array(place["position"][r]), pa.array(first), pa.array(first + place["starts"][r])],
                    names=["kind", "rid", "gram", "position", "first", "last"],
                )

    return run


def _surroundings(length: int, q: int):
    """The bytes around each open anchor: ``length - q`` before it and ``length`` from it, zeros outside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = length - q
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rids, opened = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows: list[list] = [[] for _ in range(7)]
            for rid, text, some in zip(rids, texts, opened):
                padded = bytes(left) + (text or b"") + bytes(length)
                for a in some:
                    p = a["position"]
                    for col, value in zip(rows, (rid, a["kind"], a["gram"], p, a["first"], a["last"], padded[p : p + left + length])):
                        col.append(value)
            types = [pa.int64()] * 6 + [pa.binary()]
            made = pa.record_batch([pa.array(r, t) for r, t in zip(rows, types)], names=["rid", "kind", "gram", "position", "first", "last", "around"])
            for at in range(0, made.num_rows, 5000):
                yield made.slice(at, 5000)
            del rows, made, texts
        tidy()

    return run


def refine(bucket: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Number of following offsets at which each row still shares its bucket with another.

    ``pointers`` holds the bucket identifiers at the later offsets, one column
    each; the refined numbers replace the bucket for the next offset.
    """
    shared = np.zeros(len(bucket), np.int64)
    alive = np.arange(len(bucket))
    current = bucket
    for k in range(pointers.shape[1] + 1):
        if k:
            order = np.lexsort((pointers[alive, k - 1], current))
            a, b = current[order], pointers[alive, k - 1][order]
            new = np.cumsum(np.append(False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            current = np.empty(len(alive), np.int64)
            current[order] = new
        else:
            current = np.unique(current, return_inverse=True)[1]
        more = np.bincount(current, minlength=1)[current] > 1 if len(current) else np.zeros(0, bool)
        alive, current = alive[more], current[more]
        if not len(alive):
            break
        shared[alive] = k + 1
    return shared


def _decide(length: int, q: int):
    """Starts of open anchors whose string occurs again, as spans. All anchors of a bucket come in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got)
        order = np.argsort(table["gram"].to_numpy(), kind="stable")
        gram = table["gram"].to_numpy()[order]
        group_start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        low = 0
        while low < len(group_start):  # whole buckets, some thousand anchors at a time
            high = max(low + 1, int(np.searchsorted(group_start, group_start[low] + ANCHORS_AT_ONCE)))
            a, b = group_start[low], group_start[high] if high < len(group_start) else len(gram)
            found = decided(table.take(pa.array(order[a:b])), length, q)
            if found.num_rows:
                yield found
            low = high
        del got, table
        tidy()

    return run


def decided(table: pa.Table, length: int, q: int) -> pa.RecordBatch:
    left, wide = length - q, 2 * length - q
    n = table.num_rows
    raw = np.frombuffer(b"".join(table["around"].to_pylist()), np.uint8)
    kind, rid, position, first, last = (table[c].to_numpy() for c in ("kind", "rid", "position", "first", "last"))
    prefix = prefix_hash(raw)
    base = np.arange(n) * wide
    ids = lambda offset: range_hash(prefix, base + left + offset, base + left + offset + q)
    right = np.stack([ids(k * q) for k in range(1, length // q)], axis=1)
    before = np.stack([ids(-k * q) for k in range(1, left // q + 1)], axis=1)
    bucket = table["gram"].to_numpy()
    longest = q * (refine(bucket, right) + 1)  # the equal bytes from the anchor are fewer than this
    earlier = q * np.maximum(refine(bucket, before), 1)  # and those before it are fewer than this
    low = np.maximum(first, position - earlier + 1)
    high = np.minimum(last, position - length + longest - 1)
    count = np.maximum(high - low + 1, 0)
    own = np.repeat(np.arange(n), count)
    start = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    at = base[own] + left - (position[own] - start)
    key = range_hash(prefix, at, at + length)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    if len(key):
        same = key[order[1:]] == key[order[:-1]]
        again[order[1:]] |= same
        again[order[:-1]] |= same
    again &= (kind[own] == 1)
    own, start = own[again], start[again]
    if not len(own):
        return pa.record_batch([pa.array([], pa.int64())] * 3, names=["rid", "first", "last"])
    border = np.append(True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1))
    a = np.flatnonzero(border)
    b = np.append(a[1:], len(own)) - 1
    return pa.record_batch([pa.array(rid[own[a]]), pa.array(start[a]), pa.array(start[b])], names=["rid", "first", "last"])


def _starts(length: int, q: int):
    """Hash of the string at every start of the open anchors of large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8)
            kind, rid, position, first, last = (batch.column(i).to_numpy() for i in (1, 0, 3, 4, 5))
            prefix = prefix_hash(raw)
            count = last - first + 1
            own = np.repeat(np.arange(batch.num_rows), count)
            start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = own * (2 * length - q) + length - q - (position[own] - start)
            key = range_hash(prefix, at, at + length).view(np.int64)
            for i in range(0, len(key), 100_000):
                s = slice(i, i + 100_000)
                yield pa.record_batch([pa.array(key[s]), pa.array(rid[own[s]]), pa.array(start[s]), pa.array(kind[own[s]] == 2)], names=["key", "rid", "start", "open"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = GRAM) -> DataFrame:
    """Spans of starts of repeated strings: ``rid``, ``first``, ``last``; ``docs`` has ``rid`` and ``text``."""
    spark = docs.sparkSession
    buckets = partitions_for(spark, text_bytes(docs), BUCKET_TEXT)
    dealt = docs.select("rid", "text").mapInArrow(tidied(_send_anchors(buckets, length, q)), "bucket long, grams binary, places binary, rids binary, numbers binary").repartition(buckets, "bucket")
    found = written(dealt.mapInArrow(tidied(_first_buckets(length, OPEN_IN_TASK)), "kind long, rid long, gram long, position long, first long, last long"), "anchors")
    opened = found.where("kind > 0").groupBy("rid").agg(F.collect_set(F.struct("kind", "gram", "position", "first", "last")).alias("opened"))
    bitmap = id_bitmap(found.where("kind > 0").select("rid"))
    some = docs.select("rid", "text", bitmap_slot("rid").alias("slot")).mapInArrow(tidied(only_marked(bitmap, True)), "rid long, text string").join(opened, "rid").select("rid", "text", "opened")
    columns = "rid long, kind long, gram long, position long, first long, last long, around binary"
    around = written(some.mapInArrow(tidied(_surroundings(length, q)), columns), "surroundings")
    small = around.where("kind IN (1, 3)").repartition(buckets, "gram").mapInArrow(tidied(_decide(length, q)), "rid long, first long, last long")
    starts = around.where("kind IN (2, 4)").mapInArrow(tidied(_starts(length, q)), "key long, rid long, start long, open boolean")
    again = starts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    large = starts.where("open").join(again, "key").select("rid", F.col("start").alias("first"), F.col("start").alias("last"))
    return found.where("kind = 0").select("rid", "first", "last").unionByName(small).unionByName(large)


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            kept, removed = [], []
            for text, spans in zip(texts, batch.column(2).to_pylist()):
                text, merged = text or b"", []
                for first, last in sorted((s["first"], s["last"] + length) for s in spans or []):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last)
                    else:
                        merged.append([first, last])
                parts, at = [], 0
                for first, last in merged:
                    parts.append(text[at:first])
                    at = last
                kept.append(b"".join(parts) + text[at:] if merged else text)
                removed.append([{"first": a, "last": b} for a, b in merged])
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(removed, span)], names=["doc_id", "kept", "n_bytes", "removed"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``kept`` (remaining bytes), ``n_bytes`` and ``removed`` (maximal runs, end exclusive) of every row."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    spans = written(repeated_spans(rows, length), "spans")
    bitmap = id_bitmap(spans.select("rid"))
    key_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {key_type}, text string, rid long"
    slotted = rows.select("doc_id", "text", "rid", bitmap_slot("rid").alias("slot"))
    lists = spans.distinct().groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    some = slotted.mapInArrow(tidied(only_marked(bitmap, True)), kind).join(lists, "rid", "left").select("doc_id", "text", "spans")
    none = slotted.mapInArrow(tidied(only_marked(bitmap, False)), kind).select("doc_id", "text", F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("spans"))
    return some.unionByName(none).mapInArrow(tidied(_cut_out(length)), f"doc_id {key_type}, kept binary, n_bytes long, removed array<struct<first:bigint,last:bigint>>")
