"""Quality of a text: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word has a sparse random index vector. The vector of a word is the sum
of the index vectors of the words around it, over all documents; words are
folded into a table of fixed size, so the sums of all tasks are added cell by
cell. Three streams of words are read: the letters of words, the shapes of
words (the run of upper case, lower case, digits and marks), and marks for
repetition of words and lines. A document is the mean vector of each stream.

The network learns from a bounded sample of labelled rows on the driver; its
temperature is fitted on a part of the sample that training does not see.

Cases: null and empty texts are scored as texts without words; repeated rows
score alike; without labels of both kinds every score is the share of label 1
(1 without any label); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.common import blocks, bounds_of, mix, prefix_hash, range_hash, small_batches, text_column, Texts, tidied, word_spans

BUCKETS = 1 << 12
SIZE = 32
NONZERO = 4
REACH = 2
SAMPLE_ROWS = 12_000
TEAMS = 997  # tasks are summed in teams first, then the teams
HIDDEN = 24
ACCEPT = 0.7
STREAMS = ("letters", "shapes", "repeats")

#: Class of each byte: 0 white space, 1 lower case and bytes of other letters, 2 upper case, 3 digit, else the mark itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Cells and signs of the sparse index vector of each bucket of each stream."""
    n = BUCKETS * len(STREAMS)
    h = mix(np.arange(n * NONZERO, dtype=np.uint64) + np.uint64(0xA5A5))
    return (h % np.uint64(SIZE)).astype(np.int64).reshape(n, NONZERO), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).reshape(n, NONZERO)


CELL, SIGN = index_vectors()
DENSE = np.zeros((BUCKETS * len(STREAMS), SIZE))
np.add.at(DENSE, (np.arange(len(CELL))[:, None], CELL), SIGN)


def _bucket(h: np.ndarray, stream: int) -> np.ndarray:
    return (mix(h) >> np.uint64(52)).astype(np.int64) % BUCKETS + stream * BUCKETS


def streams(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of every word of each stream, in the order of the texts."""
    data = texts.data
    kind = CLASS[data]
    start, end = word_spans(data)
    owner = np.searchsorted(texts.start, start, side="right") - 1
    letters = np.where(kind == 2, data + 32, data).astype(np.uint8)
    core = (kind == 1) | (kind == 2)
    only = letters[core]
    at = np.concatenate([[0], np.cumsum(core)])
    prefix = prefix_hash(only)
    word = range_hash(prefix, at[start], at[end])
    has = at[end] > at[start]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    runs = kind[change]
    where = np.concatenate([[0], np.cumsum(change)])
    shape = range_hash(prefix_hash(runs), where[start], where[end])
    whole = range_hash(prefix_hash(letters), start, end)
    # repetition: a word again within two places, a longer word again anywhere in the text, a line again in the text
    near = np.zeros(len(whole), bool)
    for k in (1, 2):
        near[k:] |= (whole[k:] == whole[:-k]) & (owner[k:] == owner[:-k])
    again = _seen_before(whole, owner) & (end - start >= 6)
    mark = near.astype(np.uint64) + 2 * again.astype(np.uint64)
    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_owner = np.searchsorted(texts.start, line_start, side="right") - 1
    line = range_hash(prefix_hash(data), line_start, line_end)
    twice = _seen_before(line, line_owner) & (line_end - line_start >= 8)
    order = np.argsort(np.concatenate([owner, line_owner]), kind="stable")
    repeats = np.concatenate([mark, 4 + twice.astype(np.uint64)])[order]
    return [(_bucket(word[has], 0), owner[has]), (_bucket(shape, 1), owner), (_bucket(repeats, 2), np.concatenate([owner, line_owner])[order])]


def _seen_before(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, bool)
    key = h ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(h), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    return same


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = BUCKETS * len(STREAMS)
    table, count = np.zeros(size * SIZE), np.zeros(size)
    some = False
    for batch in batches:
        for _, texts in blocks(text_column(batch)):
            some = True
            for word, owner in streams(texts):
                count += np.bincount(word, minlength=size)
                for reach in range(1, REACH + 1):
                    inside = np.flatnonzero(owner[reach:] == owner[:-reach]) if len(word) > reach else np.zeros(0, np.int64)
                    left, right = word[inside], word[inside + reach]
                    for a, b in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            table += np.bincount(a * SIZE + CELL[b, k], weights=SIGN[b, k], minlength=size * SIZE)
    if some:
        parts = len(STREAMS) * 4
        cut = lambda a: pa.array([x.tobytes() for x in np.split(a, parts)])
        team = TaskContext.get().partitionId() % TEAMS
        yield pa.record_batch([pa.array(np.arange(parts)), pa.array([team] * parts), cut(table), cut(count)], names=["part", "team", "sums", "counts"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vector of every bucket from all documents: its own index vector and the mean of its surroundings."""

    def add(table: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(x, np.float64) for x in table[c].to_pylist()) for c in ("sums", "counts")]
        return pa.table({"part": table["part"][:1], "team": table["team"][:1], "sums": [total[0].tobytes()], "counts": [total[1].tobytes()]})

    schema = "part long, team long, sums binary, counts binary"
    teams = docs.select("text").mapInArrow(tidied(_contexts), schema).groupBy("part", "team").applyInArrow(add, schema)
    parts = teams.groupBy("part").applyInArrow(add, schema).collect()
    out = DENSE.copy()
    for r in parts:
        count = np.frombuffer(r["counts"], np.float64)
        at = r["part"] * len(count)
        around = np.frombuffer(r["sums"], np.float64).reshape(len(count), SIZE) / np.maximum(count, 1)[:, None]
        out[at : at + len(count)] += 0.5 * around / np.maximum(np.sqrt((around**2).sum(axis=1, keepdims=True)), 1e-9) * np.sqrt(NONZERO)
    return out.astype(np.float32)


def pooled(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each stream per text, and the logarithm of its number of words."""
    n = len(texts)
    out = np.zeros((n, len(STREAMS) * SIZE + 1), np.float32)
    for k, (word, owner) in enumerate(streams(texts)):
        first = bounds_of(owner, n)
        count = np.diff(first)
        some = np.flatnonzero(count)
        if len(some):
            for c in range(SIZE):
                out[some, k * SIZE + c] = np.add.reduceat(vectors[:, c][word], first[some], dtype=np.float64) / count[some]
        if k == 1:
            out[:, -1] = np.log1p(count)
    return out


class Network:
    """Two layers on standardized inputs; ``temperature`` divides the output before the logistic function."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -40, 40)))

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 256, seed: int = 7) -> Network:
        """Adam on the cross entropy; a fifth of the rows is kept for the temperature."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, rows = order[: len(x) // 5], order[len(x) // 5 :]
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - mean) / scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, steps + 1):
            pick = rng.choice(rows, min(batch, len(rows)))
            a, target = z[pick], y[pick]
            hidden = np.tanh(a @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - target) / len(pick)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
                p[i] = p[i] - 0.01 * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        net = cls(mean, scale, p[0], p[1], p[2], float(p[3][0]))
        if len(held):
            raw, target = net.raw(x[held]), y[held]
            loss = [np.mean(np.logaddexp(0, raw / t) - target * raw / t) for t in TEMPERATURES]
            net.temperature = float(TEMPERATURES[int(np.argmin(loss))])
        return net


TEMPERATURES = np.exp(np.linspace(np.log(0.5), np.log(5.0), 60))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


class Scorer:
    """Word vectors and network; its size does not depend on the corpus."""

    def __init__(self, vectors: np.ndarray, network):
        self.vectors, self.network = vectors, network


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Word vectors from all documents; the network from at most about ``sample_rows`` labelled rows, chosen by a hash of the key."""
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    n = known.count()
    share = min(1.0, sample_rows / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x.tobytes() for _, texts in blocks(text_column(batch)) for x in pooled(texts, vectors)]
            yield pa.record_batch([batch.column(1), pa.array(made, pa.binary())], names=["y", "x"])

    got = docs.select("doc_id", "text").join(known, "doc_id").select("text", "y").mapInArrow(tidied(run), "y double, x binary").toArrow()
    if not got.num_rows:
        return Scorer(vectors, Constant(1.0))
    y = got["y"].to_numpy()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), -1).astype(np.float64)
    order = np.lexsort((*x.T[:4], y))
    x, y = x[order], y[order]
    return Scorer(vectors, Network.train(x, y) if 0 < y.sum() < len(y) else Constant(float(y.mean())))


def score(docs: DataFrame, scorer: Scorer, accept: float = ACCEPT) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scorer.network.score(pooled(texts, scorer.vectors).astype(np.float64)) for _, texts in blocks(text_column(batch))]
            value = np.concatenate(made) if made else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(value), pa.array((value >= accept).astype(np.int32))], names=["doc_id", "score", "predicted"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {key_type}, score double, predicted int")


def accepted(docs: DataFrame, scorer: Scorer, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``accept``."""
    small_batches(docs.sparkSession)
    name = "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scorer.network.score(pooled(texts, scorer.vectors).astype(np.float64)) for _, texts in blocks(text_column(batch, name))]
            yield batch.filter(pa.array(np.concatenate(made) >= accept)) if made else batch

    return docs.mapInArrow(tidied(run), docs.schema)
