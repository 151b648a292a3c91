"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Test items are cut into seeds of three words: those that follow each other, and
those with one word between them left open, so that an item with every third
word replaced still has seeds. A seed is rare when its words would meet by
chance at most about once per thousand documents, by the counts of the words
over all documents; an item without enough rare seeds keeps its rarest ones. A
document that holds a seed is aligned with the item around the seed: matching
words score 2, other words and gaps cost 1. The score is the share of the best
possible one; it stays high for edited and paraphrased copies, whose runs of
equal words are short. A match also needs a rare seed, or the score of
``LEAST_MATCHED`` words: a common phrase that is a whole short item by itself
makes no document a copy.

The items are read in slices of at most ``SLICE_WORDS`` words; each slice is
one pass over the documents, so what a task holds has a fixed size however
large the benchmark is.

Cases: null and empty documents or item texts match nothing; an item with a
null id counts like any other and is given with a null ``item_id``; items of
fewer words than a seed are one seed of their whole length; repeated rows are
found each; of equal scores the smallest item is given first; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.common import BASE, blocks, bounds_of, mix, small_batches, text_column, tidied, words

SEED = 3
OPEN = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # places of a seed's words; later patterns leave one word open
LEAST_SEEDS = 4
LEAST_MATCHED = 6
THRESHOLD = 0.4  # chance meetings of words stay under 0.25, copies with a third of their words edited come to 0.5
SLICE_WORDS = 1 << 20
MATCH, OTHER, GAP = 2, 1, 1
BITS = 1 << 22


class Items:
    """A slice of the benchmark: word hashes of each item and its seeds."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids = ids
        parts = [np.concatenate([w for _, t in blocks(pa.array([x], pa.large_string())) for w, _ in [words(t)]]) for x in texts]
        self.words = parts
        self.vocabulary = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.seeds = np.zeros(0, np.uint64)

    def choose_seeds(self, counts: np.ndarray, n_words: int, n_docs: int, n: int = SEED) -> None:
        """Rare n-grams by the expected number of chance meetings."""
        chance = np.log((counts + 1.0) / (n_words + 1.0))
        seed, item, sure = [], [], []
        for k, w in enumerate(self.words):
            if not len(w):
                continue
            p = chance[np.searchsorted(self.vocabulary, w)]
            parts = [spaced(w, places) for places in seed_places(len(w), n)]
            gram = np.concatenate([g for g, _ in parts])
            expected = np.log(n_words + 1.0) + np.concatenate([sum(p[at + o] for o in places) for (_, at), places in zip(parts, seed_places(len(w), n))])
            rare = expected <= np.log(max(1.0, n_docs / 1000))
            keep = rare.copy()
            keep[np.argsort(expected, kind="stable")[:LEAST_SEEDS]] = True
            seed.append(gram[keep])
            item.append(np.full(int(keep.sum()), k))
            sure.append(rare[keep])
        if not seed:
            return
        seeds, items, rare = np.concatenate(seed), np.concatenate(item), np.concatenate(sure)
        order = np.lexsort((items, seeds))
        self.seeds, self.item, self.rare = seeds[order], items[order], rare[order]
        self.maybe = np.zeros(BITS, bool)
        self.maybe[(self.seeds >> np.uint64(42)).astype(np.int64)] = True
        self.patterns = sorted({places for w in self.words if len(w) for places in seed_places(len(w), n)})

    def hits(self, word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and word number of every seed in a block, and whether it is rare."""
        found = []
        for places in self.patterns:
            reach = places[-1]
            gram, at_word = spaced(word, places)
            whole = text[at_word] == text[at_word + reach] if len(at_word) else np.zeros(0, bool)
            gram, inside = gram[whole], at_word[whole]
            some = np.flatnonzero(self.maybe[(gram >> np.uint64(42)).astype(np.int64)])
            low, high = np.searchsorted(self.seeds, gram[some]), np.searchsorted(self.seeds, gram[some], side="right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            where = np.repeat(inside[some], count)
            found.append((text[where], self.item[at], where, self.rare[at]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(4))  # type: ignore[return-value]


def seed_places(words: int, n: int = SEED) -> list[tuple[int, ...]]:
    """Patterns of the seeds of an item of so many words; a shorter item is one seed."""
    if words < n:
        return [tuple(range(words))]
    return [places for places in OPEN if places[-1] < words] if n == SEED else [tuple(range(n))]


def spaced(word: np.ndarray, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at the places behind every word of a run, and where each begins; the pattern is part of the hash."""
    size = len(word) - places[-1]
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(size, np.uint64(sum(1 << p for p in places)))
    for p in places:
        out = out * BASE + word[p : p + size]
    return mix(out), np.arange(size)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences and the word of the passage where it ends (exclusive)."""
    ramp = np.arange(len(passage) + 1) * GAP
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.where(passage == w, MATCH, -OTHER)
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + step, above[1:] - GAP))
        row = np.maximum.accumulate(row + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def _word_counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, all_words = np.zeros(len(vocabulary), np.int64), 0, 0
        maybe = np.zeros(BITS, bool)
        maybe[(vocabulary >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            docs += batch.num_rows
            for _, texts in blocks(text_column(batch)):
                word, _ = words(texts)
                all_words += len(word)
                word = word[maybe[(word >> np.uint64(42)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == word], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(some, [-1, -2])), pa.array(np.append(total[some], [docs, all_words]))], names=["w", "n"])

    return run


def slices(benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> Iterator[Items]:
    """The benchmark in parts that a task can hold."""
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-int(total) // slice_words))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if part:
            yield Items([r[0] for r in part], [r[1] for r in part])


def prepared(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """Slices with their seeds, rare by the counts over all documents."""
    small_batches(docs.sparkSession)
    for items in slices(benchmark):
        if not len(items.vocabulary):
            continue
        counted = docs.select("text").mapInArrow(tidied(_word_counts(items.vocabulary)), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
        w, n = counted["w"].to_numpy(), counted["n"].to_numpy()
        counts = np.zeros(len(items.vocabulary), np.int64)
        counts[w[w >= 0]] = n[w >= 0]
        items.choose_seeds(counts, int(n[w == -2].sum()), int(n[w == -1].sum()))
        if len(items.seeds):
            yield items


def matches(column: pa.Array, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """Row, item number, score, first and last word (exclusive) of every passage of a column that aligns well enough, the best per row and item."""
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for row, texts in blocks(column):
        word, text = words(texts)
        t, item, at, rare = items.hits(word, text)
        if not len(t):
            continue
        first = bounds_of(text, len(texts))
        order = np.lexsort((at, item, t))
        t, item, at, rare = t[order], item[order], at[order], rare[order]
        size = np.array([len(w) for w in items.words])[item]
        apart = np.ones(len(t), bool)
        apart[1:] = (t[1:] != t[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * size[1:])
        begin = np.flatnonzero(apart)
        stop = np.append(begin[1:], len(t)) - 1
        for b, s in zip(begin.tolist(), stop.tolist()):
            reach = int(1.5 * size[b]) + 5
            low, high = max(int(first[t[b]]), int(at[b]) - reach), min(int(first[t[b] + 1]), int(at[s]) + reach)
            score, end = align(items.words[item[b]], word[low:high])
            share = score / (MATCH * int(size[b]))
            key = (row + int(t[b]), int(item[b]))
            enough = score >= MATCH * LEAST_MATCHED or rare[b : s + 1].any()
            if enough and share >= threshold and share > out.get(key, (0.0,))[0]:
                out[key] = (share, max(0, low + end - int(size[b]) - int(first[t[b]])), low + end - int(first[t[b]]))
    return [(r, k, *v) for (r, k), v in sorted(out.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a test item it holds a copy of: ``doc_id``, ``item_id``, ``score``, ``first_word``, ``last_word``."""
    key_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key_type}, item_id long, score double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in prepared(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = matches(text_column(batch), items, threshold)
                if found:
                    row, item, score, first, last = zip(*found)
                    yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(score), pa.array(first), pa.array(last)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(tidied(run), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no copy of a test item."""
    at = docs.columns.index("text")
    for items in prepared(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in matches(text_column(batch, batch.schema.field(at).name), items, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
