"""Lines that recur across documents, by a log-template tree of fixed depth.

A line is parsed into its words; words with a digit or an at sign are variable
fields. The tree has one level for the number of words and one for each of the
first words; a leaf holds the lines that agree in all of them. Inside a leaf a
line joins the first template with which it shares enough words, most frequent
lines first, and words that differ become variable. A template that is in at
least ``min_docs`` documents is dropped, but for its place in the document with
the smallest id, so no text leaves the corpus altogether.

Lines of ``LONG_WORDS`` words or more hardly recur by chance: ``long_docs``
documents are enough if the words are the same, or if three quarters of the
template, and ``LONG_WORDS`` of its words, are no variable fields (rows of
numbers are all one template).

Only leaves that so many documents reach are parsed further; their lines are counted before they meet. In a leaf with more lines than
``LEAF_LINES`` templates are looked up by rare words; the result is the same.

Cases: lines of fewer than ``MIN_WORDS`` words are always kept; null text stays
null; a text that loses all its lines becomes empty; repeated rows (same id and
text) keep or lose the same lines; an empty table gives no rows; other columns
pass through, ``n_chars`` is that of the new text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.common import BASE, bitmap_slot, blocks, cut_points, id_bitmap, in_bitmap, mix, pack_sorted, partitions_for, powers, prefix_hash, range_hash, small_batches, split_marked, text_bytes, text_column, Texts, tidied, tidy, unpack_sorted, word_spans, written

DEPTH = 3
MIN_WORDS = 4
MIN_DOCS = 5
LONG_WORDS = 50
LONG_DOCS = 2
ALIKE = 0.75
LEAF_LINES = 256
BUCKET_TEXT = 64 << 20
STAR = np.uint64(0x2A2A2A2A2A2A2A2A)
LAST_BIT_OFF = ~np.uint64(1)

VARIABLE = np.zeros(256, bool)
VARIABLE[48:58] = VARIABLE[64] = True


class Lines:
    """Lines of a block with at least ``MIN_WORDS`` words: row in the block, number in its text, leaf, template, word hashes, and for long lines a hash of the very words."""

    def __init__(self, texts: Texts, depth: int = DEPTH):
        data = texts.data
        start, end = word_spans(data)
        word = mix(range_hash(prefix_hash(data), start, end))
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(VARIABLE[data], out=seen[1:])
        raw = word.copy()
        word[seen[end] > seen[start]] = STAR
        feeds = np.flatnonzero(data == 10)
        line = np.searchsorted(feeds, start)
        count = np.bincount(line, minlength=len(feeds))
        first = np.cumsum(count) - count
        keep = np.flatnonzero(count >= max(MIN_WORDS, depth))
        self.word, self.first, self.count = word, first[keep], count[keep]
        self.row = np.searchsorted(texts.start, np.append(0, feeds[:-1] + 1)[keep], side="right") - 1
        self.number = keep - np.searchsorted(feeds, texts.start)[self.row]
        leaf = self.count.astype(np.uint64)
        for k in range(depth):
            leaf = leaf * BASE + word[self.first + k]
        self.long = self.count >= LONG_WORDS
        self.leaf = mix(leaf) & LAST_BIT_OFF | self.long  # the last bit: long lines
        total = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * powers("up", len(word)), out=total[1:])
        self.template = mix((total[self.first + self.count] - total[self.first]) * powers("down", len(word) + 1)[self.first] + self.leaf)
        fixed = np.append(0, np.cumsum(word != STAR))
        fixed = fixed[self.first + self.count] - fixed[self.first]
        self.template = self.template & LAST_BIT_OFF | (fixed >= np.maximum(LONG_WORDS, ALIKE * self.count))  # the last bit: long_docs are enough
        np.cumsum(raw * powers("up", len(word)), out=total[1:])
        self.exact = mix((total[self.first + self.count] - total[self.first]) * powers("down", len(word) + 1)[self.first] + self.leaf)

    def words_of(self, k: int) -> bytes:
        return self.word[self.first[k] : self.first[k] + self.count[k]].tobytes()


def _leaf_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, texts in blocks(text_column(batch)):
                lines = Lines(texts)
                pair = np.unique(np.stack([lines.leaf, lines.row.astype(np.uint64)], axis=1), axis=0) if len(lines.leaf) else np.zeros((0, 2), np.uint64)
                held.append(pair[:, 0])
                size += len(pair)
            if size > 1 << 19:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)
        tidy()

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        cut = cut_points(keys, buckets)
        some = np.flatnonzero(np.diff(cut)).tolist()
        return pa.record_batch(
            [pa.array(some, pa.int64()), pa.array([pack_sorted(keys[cut[b] : cut[b + 1]]) for b in some], pa.binary()), pa.array([counts[cut[b] : cut[b + 1]].astype(np.uint32).tobytes() for b in some], pa.binary())],
            names=["bucket", "leaves", "counts"],
        )

    return run


def _often(min_docs: int, long_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            keys += [unpack_sorted(x) for x in batch.column(1).to_pylist()]
            counts += [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
        if keys:
            key, number = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(number, weights=np.concatenate(counts))
            often = key[total >= np.where(key & np.uint64(1), min(long_docs, min_docs), min_docs)].view(np.int64)
            for i in range(0, len(often), 100_000):
                yield pa.record_batch([pa.array(often[i : i + 100_000])], names=["leaf"])
        tidy()

    return run


def _lines_of(bitmap: np.ndarray):
    """Lines in often reached leaves: each place (``words`` null), and each template once per block with its words (``rid`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "template", "words", "doc_id", "rid", "line", "exact"]
        for batch in batches:
            ids, rids = batch.column(0), batch.column(1).to_numpy()
            for row, texts in blocks(text_column(batch)):
                lines = Lines(texts)
                often = np.flatnonzero(in_bitmap(bitmap, _slot(lines.leaf)))
                if not len(often):
                    continue
                leaf, template = lines.leaf[often].view(np.int64), lines.template[often].view(np.int64)
                at = row + lines.row[often]
                yield pa.record_batch([pa.array(leaf), pa.array(template), pa.nulls(len(at), pa.binary()), ids.take(pa.array(at)), pa.array(rids[at]), pa.array(lines.number[often]), pa.array(lines.exact[often].view(np.int64), mask=~lines.long[often])], names=names)
                once = np.unique(template, return_index=True)[1]
                none = pa.nulls(len(once), pa.int64())
                yield pa.record_batch([pa.array(leaf[once]), pa.array(template[once]), pa.array([lines.words_of(k) for k in often[once].tolist()], pa.binary()), pa.nulls(len(once), ids.type), none, none, none], names=names)

    return run


def _slot(leaf: np.ndarray) -> np.ndarray:
    """A leaf's place in the bitmap; its own hash is even enough."""
    from sylvaflow.llm.common import BITMAP_BITS

    return (leaf >> np.uint64(20)).astype(np.int64) & (BITMAP_BITS - 1)


def parse_leaf(words: np.ndarray, alike: float = ALIKE, depth: int = DEPTH) -> np.ndarray:
    """Template number of each line of a leaf (rows of word hashes, most frequent first): the first template that shares enough words.

    The lines agree in their first ``depth`` words. ``LEAF_LINES`` only says how templates are looked up, never which one is found.
    """
    n, width = words.shape
    least = math.ceil(alike * width)
    if n > LEAF_LINES:
        return _parse_large(words[:, depth:], least - depth)
    out = np.full(n, -1, np.int64)
    made = np.zeros((n, width), np.uint64)
    count = 0
    for i in range(n):
        if count:
            same = (made[:count] == words[i]).sum(axis=1) >= least
            k = int(np.argmax(same))
            if same[k]:
                out[i] = k
                made[k] = np.where(made[k] == words[i], made[k], STAR)
                continue
        made[count] = words[i]
        out[i] = count
        count += 1
    return out


def _parse_large(words: np.ndarray, need: int) -> np.ndarray:
    """The same for many lines. Of a line and a template that agree in ``need`` places, the ``width - need + 1`` rarest words (with their places) have one in common, so only templates with a common rare word are compared."""
    n, width = words.shape
    out = np.zeros(n, np.int64)
    if need <= 0:
        return out
    ids, often = np.empty((n, width), np.int32), np.empty((n, width), np.int32)
    star, star_often = np.full(width, -1, np.int32), np.zeros(width, np.int32)  # -1: no line has it, equal to none
    seen = 0
    for p in range(width):
        value, number, total = np.unique(words[:, p], return_inverse=True, return_counts=True)
        ids[:, p], often[:, p] = number + seen, total[number]
        k = int(np.searchsorted(value, STAR))
        if k < len(value) and value[k] == STAR:
            star[p], star_often[p] = k + seen, total[k]
        seen += len(value)
    first = width - need + 1
    made, rarity = np.empty((n, width), np.int32), {}
    holders: dict[int, list[int]] = {}
    count = 0
    for i in range(n):
        rare = ids[i, np.argsort(often[i], kind="stable")[:first]].tolist()
        lists = [holders[w] for w in rare if w in holders]
        near = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        same = (made[near] == ids[i]).sum(axis=1) >= need
        if same.any():
            k = int(near[np.argmax(same)])
            out[i] = k
            other = made[k] != ids[i]
            other &= made[k] != star
            if not other.any():
                continue
            made[k, other], rarity[k][other] = star[other], star_often[other]
            rare = made[k, np.argsort(rarity[k], kind="stable")[:first]].tolist()
        else:
            k = out[i] = count
            made[k], rarity[k] = ids[i], often[i].copy()
            count += 1
        for w in rare:
            held = holders.setdefault(w, [])
            if w >= 0 and k not in held[-1:]:
                held.append(k)
    return out


def _parse(table: pa.Table) -> pa.Table:
    leaf, template, docs = table["leaf"].to_numpy(), table["template"].to_numpy(), table["n"].to_numpy()
    width = len(table["words"][0].as_py())
    raw = table["words"].to_pylist()
    rows = [i for i in range(len(raw)) if len(raw[i]) == width]  # a leaf has one number of words; a clash of hashes stays alone
    rows = np.array(rows)[np.lexsort((template[rows], -docs[rows]))]
    words = np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.uint64).reshape(len(rows), -1)
    group = template.copy()
    number = parse_leaf(words)
    head = rows[np.unique(number, return_index=True)[1]]
    group[rows] = template[head][number]
    return pa.table([pa.array(template), pa.array(group)], names=["template", "grp"])


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """Places of lines to drop: ``rid``, ``line``. ``docs`` has ``doc_id``, ``rid``, ``text``."""
    spark = docs.sparkSession
    buckets = partitions_for(spark, text_bytes(docs), BUCKET_TEXT)
    counted = docs.select("text").mapInArrow(tidied(_leaf_counts(buckets)), "bucket long, leaves binary, counts binary").repartition(buckets, "bucket")
    often = counted.mapInArrow(tidied(_often(min_docs, long_docs)), "leaf long")
    bitmap = id_bitmap(often, slot=F.expr(f"shiftrightunsigned(leaf, 20) & {(1 << 25) - 1}L"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = written(docs.select("doc_id", "rid", "text").mapInArrow(tidied(_lines_of(bitmap)), f"leaf long, template long, words binary, doc_id {kind}, rid long, line long, exact long"), "lines")
    places = lines.where("words IS NULL").select("template", "doc_id", "rid", "line", "exact")
    seen = places.groupBy("template").agg(F.count("*").alias("n"))
    words = lines.where("words IS NOT NULL").groupBy("leaf", "template").agg(F.min("words").alias("words"))
    groups = words.join(seen, "template").select("leaf", "template", "words", "n").groupBy("leaf").applyInArrow(_parse, "template long, grp long")
    placed = written(places.join(groups, "template").select("grp", "doc_id", "rid", "line", "exact"), "placed")
    least = F.when(F.col("key").bitwiseAND(1) == 1, min(long_docs, min_docs)).otherwise(min_docs)
    alike = _beside_home(placed.withColumnRenamed("grp", "key"), least)
    same = _beside_home(placed.where("exact IS NOT NULL").withColumnRenamed("exact", "key"), F.lit(min(long_docs, min_docs)))
    return alike.unionByName(same).distinct()


def _beside_home(placed: DataFrame, least: Column) -> DataFrame:
    """Places of every ``key`` that enough documents hold, but for those in the first of them."""
    each = placed.groupBy("key", "rid").agg(F.min("doc_id").alias("doc_id"))
    recurring = each.groupBy("key").agg(F.count("*").alias("docs"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("home")).where(F.col("docs") >= least)
    return placed.join(recurring, "key").where("rid <> home").select("rid", "line")


def _cut_lines(text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out, counts, chars = [], [], []
            for text, drop in zip(texts, drops):
                drop = set(drop or ())
                if text is not None and drop:
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
                out.append(text)
                counts.append(len(drop))
                chars.append(None if text is None else len(text))
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(out, batch.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array(chars, batch.schema.field(chars_at).type)
            yield pa.record_batch([*columns, pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_dropped"])

    return run


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """``docs`` with recurring lines cut from ``text``, and ``n_dropped`` lines per row. Needs ``doc_id`` and ``text``."""
    small_batches(docs.sparkSession, 500)
    names = docs.columns
    keyed = docs.withColumn("__rid", F.xxhash64("doc_id", "text"))
    drops = written(recurring_lines(keyed.select("doc_id", F.col("__rid").alias("rid"), "text"), min_docs, long_docs), "drops")
    bitmap = id_bitmap(drops.select("rid"))
    some, none = split_marked(keyed, "__rid", bitmap)
    lists = drops.groupBy("rid").agg(F.collect_list("line").alias("__drop")).withColumnRenamed("rid", "__r")
    with_lists = some.join(lists, some["__rid"] == lists["__r"], "left").select(*[some[f"`{n}`"] for n in names], "__drop")
    without = none.select(*[F.col(f"`{n}`") for n in names], F.lit(None).cast("array<bigint>").alias("__drop"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_dropped long"
    chars = names.index("n_chars") if "n_chars" in names else None
    return with_lists.unionByName(without).mapInArrow(tidied(_cut_lines(names.index("text"), chars)), schema)
