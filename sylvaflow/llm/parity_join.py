"""Similarity join of word-shingle sets with parity sketches.

Two sets link when their Jaccard similarity is at least 0.8, so their symmetric
difference is at most a ninth of the sum of their sizes. Every shingle flips
one bit of a sketch; the bits that differ between two sketches are never more
than the shingles that differ. The sketch of a size band is cut into more
parts than bits may differ, so two linked sets agree in some whole part: parts
are joined on a hash of their odd bits (the exclusive or of the random words of
their shingles). Shingles of one part rarely all belong to a passage that many
documents share, and parts that many sets agree in are only used where a set
has too few others: see ``Join.frequent``.

Sets that are equal are one class from the start. Candidates are verified on
the whole sets, a frequent part first against its most connected member. Only
members that are still in different components are then compared with each
other, block by block on their sketches; the few pairs that pass are verified.
The result is one row per document.

Cases: no words or null text: empty set, linked with nothing; fewer words than
a shingle: the whole sequence is the one shingle; repeated rows are one class;
documents with a null id take part, and a component without another id has a
null ``component_id``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow.llm.common import BASE, bitmap_slot, blocks, bounds_of, cut_points, grams, id_bitmap, in_bitmap, mix, pack_sorted, partitions_for, small_batches, split_marked, text_bytes, text_column, Texts, tidied, tidy, unpack_sorted, words, written

SHINGLE = 5
SHARE = Fraction(4, 5)
BLOCK = 4096  # members of a frequent part that are compared in one step
FREQUENT = 12  # members from which a part is frequent
PARTS = 0.3  # parts per shingle of the largest set of a band
BUCKET_TEXT = 16 << 20


def shingle_sets(texts: Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text, sorted inside a text, and where each text begins."""
    word, owner = words(texts)
    gram, at = grams(word, owner, n)
    first = bounds_of(owner, len(texts))
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = count[short] > k
            whole[more] = whole[more] * BASE + word[first[short[more]] + k]
        gram, at = np.concatenate([gram, mix(whole + count[short].astype(np.uint64))]), np.concatenate([at, short])
    order = np.lexsort((gram, at))
    gram, at = gram[order], at[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (at[1:] != at[:-1])
    gram, at = gram[fresh], at[fresh]
    return gram, bounds_of(at, len(texts))


def class_ids(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number per set; equal sets have the same, the empty set has 0."""
    total = np.zeros(len(gram) + 1, np.uint64)
    np.cumsum(mix(gram ^ np.uint64(0xC2B2AE3D27D4EB4F)), out=total[1:])
    size = np.diff(first)
    out = mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))
    out[out == 0] = 1
    out[size == 0] = 0
    return out.view(np.int64)


def difference_bound(a, b):
    """Most shingles two linked sets of these sizes can differ in."""
    return (a + b) * (SHARE.denominator - SHARE.numerator) // (SHARE.denominator + SHARE.numerator)


def largest_partner(a):
    return a * SHARE.denominator // SHARE.numerator


def band(n: np.ndarray) -> np.ndarray:
    """Band of a size: sets of more than half of 2^band and at most 2^band shingles."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def band_parts(level: int) -> int:
    top = 1 << level
    return int(difference_bound(top, largest_partner(top)) + 1 + np.ceil((PARTS - 0.25) * top) + 8)


def part_keys(gram: np.ndarray, first: np.ndarray, rows: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all parts with odd bits of the sets ``rows`` at a band, with the set and the number of such parts per set.

    A set with fewer such parts than may differ also gets its empty parts, so that
    every set has more keys than parts that may differ.
    """
    size = np.diff(first)[rows]
    parts = band_parts(level)
    pick = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    own = np.repeat(np.arange(len(rows)), size)
    h = mix(gram[pick] + np.uint64(level))
    part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    slot = own * parts + part.astype(np.int64)
    odd = np.zeros(len(rows) * parts, np.uint64)
    np.bitwise_xor.at(odd, slot, mix(h | np.uint64(1)))
    full = odd != 0
    keys = mix(odd + np.tile(np.arange(parts, dtype=np.uint64), len(rows)) * BASE + np.uint64(level << 56))
    number = full.reshape(len(rows), parts).sum(axis=1)
    few = number <= difference_bound(size, largest_partner(size))
    emit = full | np.repeat(few, parts)
    at = np.flatnonzero(emit)
    return keys[at], rows[at // parts], number


def levels_of(size: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Bands a set is joined in: its own, and the next one if a partner can lie there."""
    own, above = band(size), band(largest_partner(size))
    out = []
    some = size > 0
    for level in np.unique(np.concatenate([own[some], above[some]])).tolist():
        out.append((level, np.flatnonzero(some & ((own == level) | (above == level)))))
    return out


def sketches(gram: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Bit sketch of each set: every shingle flips one of 2 to 4 times as many bits as there are shingles, a power of two."""
    size = np.diff(first)
    bits = np.maximum(64, 1 << (band(size) + 1))
    own = np.repeat(np.arange(len(size)), size)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = base[own] + (mix(gram ^ np.uint64(0x2545F4914F6CDD1D)) & (bits[own] - 1).astype(np.uint64)).astype(np.int64)
    flat = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8))
    return [flat[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def hamming(a: bytes, b: bytes) -> int:
    """Bits that differ; the longer sketch is folded to the length of the shorter, which never makes more of them."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = _fold(x)
    while len(y) > len(x):
        y = _fold(y)
    return int(np.bitwise_count(x ^ y).sum())


def _fold(x: np.ndarray) -> np.ndarray:
    half = len(x) // 2
    return x[:half] ^ x[half:]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in blocks(text_column(batch)):
            gram, first = shingle_sets(texts)
            yield pa.record_batch([batch.column(0).slice(row, len(texts)), pa.array(np.diff(first)), pa.array(class_ids(gram, first)), pa.array(sketches(gram, first), pa.binary())], names=["doc_id", "n", "cls", "sketch"])


def _postings(buckets: int):
    """Per run of texts and bucket: sorted part keys, and for each the number of its entry in a list of sets (class, and band with slack).

    The slack of a set in a band is how many of its keys it may leave out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen = np.zeros(0, np.int64)
        count = entries = 0
        for batch in batches:
            for _, texts in blocks(text_column(batch)):
                gram, first = shingle_sets(texts)
                cls, size = class_ids(gram, first), np.diff(first)
                once = np.zeros(len(size), bool)
                once[np.unique(cls, return_index=True)[1]] = True
                once &= ~np.isin(cls, seen)
                seen = np.concatenate([seen, cls[once]])
                for level, rows in levels_of(np.where(once, size, 0)):
                    keys, row, number = part_keys(gram, first, rows, level)
                    most = difference_bound(size[rows], largest_partner(size[rows]))
                    own = np.where(number <= most, band_parts(level), number)
                    slack = np.minimum(own - most - 1, (1 << 24) - 1)
                    place = np.full(len(size), -1)
                    place[rows] = np.arange(len(rows))
                    held.append((keys, place[row] + entries, cls[rows], (level << 24) + slack))
                    count += len(keys)
                    entries += len(rows)
                if count > 1 << 20:
                    yield out(held)
                    held, seen, count, entries = [], np.zeros(0, np.int64), 0, 0
                    tidy()
        if held:
            yield out(held)
        held = []
        tidy()

    def out(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, entry, cls, meta = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.argsort(keys, kind="stable")
        keys, entry = keys[order], entry[order]
        cut = cut_points(keys, buckets)
        rows: list[list] = [[] for _ in range(5)]
        for b in np.flatnonzero(np.diff(cut)).tolist():
            mine = slice(cut[b], cut[b + 1])
            some, number = np.unique(entry[mine], return_inverse=True)
            wide = np.uint16 if len(some) <= 1 << 16 else np.uint32
            for col, value in zip(rows, (b, pack_sorted(_within(keys[mine], buckets)), cls[some].tobytes(), meta[some].astype(np.uint32).tobytes(), number.astype(wide).tobytes())):
                col.append(value)
        return pa.record_batch([pa.array(rows[0], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["bucket", "keys", "classes", "metas", "numbers"])

    return run


def _within(keys: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of sorted keys inside their bucket, in the same order: the fraction that is left after the bucket is taken off."""
    high, low = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    return ((high * np.uint64(buckets)) & np.uint64(0xFFFFFFFF)) + ((low * np.uint64(buckets)) >> np.uint64(32))


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts that several classes agree in: each class of a frequent part (kind 1), all pairs of a smaller one (kind 0)."""
    keys, cls, metas = [], [], []
    for batch in batches:
        for b, k, c, m, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            some = np.frombuffer(c, np.int64)
            number = np.frombuffer(n, np.uint16 if len(some) <= 1 << 16 else np.uint32)
            keys.append(unpack_sorted(k) + (np.uint64(b) << np.uint64(33)))
            cls.append(some[number])
            metas.append(np.frombuffer(m, np.uint32)[number])
    if not keys:
        return
    key, of, meta = np.concatenate(keys), np.concatenate(cls), np.concatenate(metas)
    del keys, cls, metas
    order = np.argsort(key, kind="stable")
    key, of, meta = key[order], of[order], meta[order]
    del order
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    pairs, frequent = [], []
    for n in np.unique(size[size > 1]).tolist():
        at = start[size == n]
        if n < FREQUENT:
            member = np.sort(of[at[:, None] + np.arange(n)], axis=1)
            pairs += [np.stack([member[:, i], member[:, j]], axis=1) for i in range(n) for j in range(i + 1, n)]
            continue
        for s in at.tolist():
            mine, where = np.unique(of[s : s + n], return_index=True)
            if len(mine) > 1:
                frequent.append((np.full(len(mine), key[s]).view(np.int64), mine, meta[s : s + n][where].astype(np.int64), np.full(len(mine), len(mine))))
    names = ["kind", "part", "x", "y", "meta", "df"]
    del key, of, meta
    tidy()
    if pairs:
        found = np.concatenate(pairs)
        found = np.unique(np.ascontiguousarray(found[found[:, 0] != found[:, 1]]).view([("x", np.int64), ("y", np.int64)]).ravel())
        for some in np.array_split(found, max(1, len(found) // 100_000)):
            none = pa.nulls(len(some), pa.int64())
            yield pa.record_batch([pa.array(np.zeros(len(some), np.int64)), none, pa.array(some["x"]), pa.array(some["y"]), none, none], names=names)
    if frequent:
        part, x, info, df = (np.concatenate([f[i] for f in frequent]) for i in range(4))
        for at in range(0, len(x), 100_000):
            s = slice(at, at + 100_000)
            yield pa.record_batch([pa.array(np.ones(len(x[s]), np.int64)), pa.array(part[s]), pa.array(x[s]), pa.nulls(len(x[s]), pa.int64()), pa.array(info[s]), pa.array(df[s])], names=names)


def _close_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, n, m, a, b = (batch.column(i) for i in range(6))
        bound = difference_bound(n.to_numpy(), m.to_numpy())
        keep = [hamming(p, q) <= d for p, q, d in zip(a.to_pylist(), b.to_pylist(), bound.tolist())]
        yield pa.record_batch([x, y], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _cross_close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in one frequent part whose sizes and sketches allow a link; only these leave the task.

    Columns: part, both blocks, the row's own block, class, component, size, sketch.
    """
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    part, low, high, block, x, component, n = (table[i].to_numpy() for i in range(7))
    order = np.lexsort((n, high, low, part))
    part, low, high = part[order], low[order], high[order]
    cut = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    found = []
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
        rows = order[a:b]
        c = component[rows]
        if (c == c[0]).all():
            continue
        sketch = [np.frombuffer(table[7][i].as_py(), np.uint64) for i in rows.tolist()]
        width = min(map(len, sketch))
        bits = np.empty((len(rows), width), np.uint64)
        for k, sk in enumerate(sketch):
            while len(sk) > width:
                sk = _fold(sk)
            bits[k] = sk
        size, name, own = n[rows], x[rows], block[rows]
        far = np.searchsorted(size, largest_partner(size), side="right")
        for i in range(0, len(rows), 128):
            j = min(len(rows), i + 128)
            to = int(far[j - 1])
            apart = np.zeros((j - i, to - i), np.uint32)
            for w in range(width):
                apart += np.bitwise_count(bits[i:j, w][:, None] ^ bits[None, i:to, w])
            ok = apart <= difference_bound(size[i:j][:, None], size[None, i:to])
            ok &= (c[i:j][:, None] != c[None, i:to]) & (np.arange(i, to)[None, :] < far[i:j][:, None]) & (np.arange(i, to)[None, :] > np.arange(i, j)[:, None])
            if low[a] != high[a]:
                ok &= own[i:j][:, None] != own[None, i:to]
            p, q = np.nonzero(ok)
            found.append(np.stack([np.maximum(name[i + p], name[i + q]), np.minimum(name[i + p], name[i + q])], axis=1))
    tidy()
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        for some in np.array_split(pairs, max(1, len(pairs) // 100_000)):
            yield pa.record_batch([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["x", "y"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = _tokens(a), _tokens(b)
            both = np.concatenate([p, q])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(shared * SHARE.denominator >= (len(both) - shared) * SHARE.numerator)
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _tokens(value: bytes) -> np.ndarray:
    wide = np.zeros((len(value) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(value, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _sets(bitmap: np.ndarray):
    """Shingles (48 bits each) of the documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = in_bitmap(bitmap, batch.column(2).to_numpy()) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(maybe))
            for row, texts in blocks(text_column(batch)):
                gram, first = shingle_sets(texts)
                body = np.ascontiguousarray(gram.view(np.uint8).reshape(-1, 8)[:, :6])
                sets = [body[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch([batch.column(0).slice(row, len(texts)), pa.array(class_ids(gram, first)), pa.array(sets, pa.binary())], names=["doc_id", "cls", "tokens"])

    return run


def connected(links: DataFrame) -> DataFrame:
    """Smallest member of each linked node: alternating star contractions, each round written to the shared folder."""
    edges = written(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(low.select("x", F.col("m").alias("y"))).distinct()
        small = written(small, "links")
        mark = F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))
        if small.agg(F.count("*"), mark).first() == edges.agg(F.count("*"), mark).first():
            return small.select("x", F.col("y").alias("component"))
        edges = small


class Join:
    """The steps of the join over ``docs`` (``doc_id``, ``text``); every table that is used twice is written once."""

    def __init__(self, docs: DataFrame):
        spark = self.spark = docs.sparkSession
        small_batches(spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.members = written(self.docs.mapInArrow(tidied(_members), "doc_id long, n long, cls long, sketch binary"), "members")
        self.classes = self.members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
        self.buckets = partitions_for(spark, text_bytes(self.docs), BUCKET_TEXT)
        schema = "bucket long, keys binary, classes binary, metas binary, numbers binary"
        dealt = self.docs.mapInArrow(tidied(_postings(self.buckets)), schema).repartition(self.buckets, "bucket")
        self.found = written(dealt.mapInArrow(tidied(_agree), "kind long, part long, x long, y long, meta long, df long"), "agreeing")

    def frequent(self) -> DataFrame:
        """Frequent parts and the classes that need them: each class leaves out its most frequent parts as far as its slack goes."""
        own = W.partitionBy("x", "level").orderBy(F.col("df").desc(), F.col("part").desc())
        hot = self.found.where("kind = 1").select("part", "x", "df", F.shiftright("meta", 24).alias("level"), (F.col("meta") % (1 << 24)).alias("slack"))
        return hot.withColumn("at", F.row_number().over(own)).where("at > slack").select("part", "x")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches differ in few enough bits and whose sizes allow a link."""
        s = self.classes
        a = s.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
        b = s.select(F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
        sized = pairs.distinct().join(a, "x").join(b, "y").where(F.least("nx", "ny") * SHARE.denominator >= F.greatest("nx", "ny") * SHARE.numerator)
        return sized.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(tidied(_close_sketches), "x long, y long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs that link, from the whole sets."""
        ends = pairs.select(F.col("x").alias("cls")).unionByName(pairs.select(F.col("y").alias("cls"))).distinct()
        wanted = self.classes.select("cls", "doc_id").join(ends, "cls")
        bitmap = id_bitmap(wanted.select("doc_id"))
        made = self.docs.select("doc_id", "text", bitmap_slot("doc_id").alias("slot")).mapInArrow(tidied(_sets(bitmap)), "doc_id long, cls long, tokens binary")
        sets = written(made.join(wanted.toDF("c", "d"), F.expr("c = cls AND d <=> doc_id"), "left_semi").select("cls", "tokens").dropDuplicates(["cls"]), "sets")
        a, b = sets.toDF("x", "tx"), sets.toDF("y", "ty")
        return pairs.join(a, "x").join(b, "y").select("x", "y", "tx", "ty").mapInArrow(tidied(_linked), "x long, y long")

    def links(self) -> DataFrame:
        """Links between classes that connect everything that is connected."""
        hot = written(self.frequent(), "frequent")
        degree = hot.groupBy("x").agg(F.count("*").alias("d"))
        hub = hot.join(degree, "x").groupBy("part").agg(F.max(F.struct("d", "x"))["x"].alias("hub"))
        star = hot.join(hub, "part").where("x <> hub").select(F.greatest("x", "hub").alias("x"), F.least("x", "hub").alias("y"))
        near = self.found.where("kind = 0").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        close = written(self.close(near.unionByName(star)), "close")
        # a first forest: every class with its neighbour of the most close pairs
        both = close.unionByName(close.select(F.col("y").alias("x"), F.col("x").alias("y")))
        degree = both.groupBy("x").agg(F.count("*").alias("d"))
        best = both.join(degree.toDF("y", "d"), "y").groupBy("x").agg(F.max(F.struct("d", "y"))["y"].alias("y"))
        forest = written(best.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "forest")
        links = written(self.verify(forest), "verified")
        component = connected(links)
        of = lambda t, c, name: t.join(component.toDF(c, name), c, "left").withColumn(name, F.coalesce(name, c))
        rest = of(of(close.join(forest, ["x", "y"], "left_anti"), "x", "cx"), "y", "cy").where("cx <> cy").select("x", "y")
        placed = of(hot, "x", "cx")
        mixed = placed.groupBy("part").agg(F.min("cx").alias("a"), F.max("cx").alias("b"), F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).where("a <> b")
        left = placed.join(mixed, "part").select("part", "x", "cx", "blocks", F.pmod(F.xxhash64("x"), F.col("blocks")).alias("own"))
        left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(self.classes.select(F.col("cls").alias("x"), "n", "sketch"), "x")
        left = left.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "cx", "n", "sketch")
        cross = left.repartition(self.buckets, "part", "i", "j").mapInArrow(tidied(_cross_close), "x long, y long").distinct().join(close, ["x", "y"], "left_anti")
        rest = written(rest.unionByName(cross).distinct(), "rest")
        return links.unionByName(self.verify(rest))

    def components(self) -> DataFrame:
        """``doc_id``, ``n_shingles``, ``component_id`` of every document."""
        component = connected(self.links())
        named = self.members.select("doc_id", "n", "cls").join(component.toDF("cls", "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        first = named.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return named.join(first, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every document."""
    return Join(docs).components()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each group the row with the smallest id stays, of rows that repeat it one.

    Rows without words stay. Only rows that may have to go are joined.
    """
    keyed = docs.withColumn("__rid", F.xxhash64("doc_id", "text"))
    join = Join(keyed.select(F.col("__rid").alias("doc_id"), "text"))
    component = join.components().where("n_shingles > 0").select(F.col("doc_id").alias("rid"), F.col("component_id").alias("component"))
    component = written(component.groupBy("rid").agg(F.min("component").alias("component"), F.count("*").alias("rows")), "components")
    more = component.groupBy("component").agg(F.sum("rows").alias("n")).where("n > 1").select("component")
    grouped = component.join(more, "component").select("rid", "component")
    ids = keyed.select("doc_id", F.col("__rid").alias("rid")).distinct().join(grouped, "rid")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("__first"))
    state = written(ids.join(first, "component").select(F.col("rid").alias("__r"), (F.col("rid") == F.col("__first")).alias("__stays")), "states")
    some, none = split_marked(keyed, "__rid", id_bitmap(state.select("__r")))
    named = [F.col(f"`{n}`") for n in docs.columns]
    place = F.row_number().over(W.partitionBy("__rid").orderBy(F.lit(1)))
    kept = some.join(state, F.expr("__r = __rid"), "left").withColumn("__at", place).where("__r IS NULL OR (__stays AND __at = 1)")
    return kept.select(*named).unionByName(none.select(*named))
