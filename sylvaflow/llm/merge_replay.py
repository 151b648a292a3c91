"""Byte-level BPE: encoding by a replay of all merges over the different words of a block of texts, and decoding.

The words (matches of the split pattern) of a block of texts form its corpus.
Their symbols stand in one chain, with an inverted index from a pair of
neighbours to the positions where it occurs. The merges are applied in the
order of their ranks, each at all its positions of all words at once; a merge
touches only the two neighbours of the merged pair, whose new pairs go into
the index. So a word costs as many steps as it has merges, however long it is.
Ids of words are kept for later blocks of the same worker, up to a fixed
number of words. No shuffle: every task replays the merges for its own texts,
and documents are independent, so a lost task is simply run again.

Cases: null and empty texts have no ids; all other columns are ignored and may
have any name; rows, null keys and repeated keys pass one for one. Texts are
read whole. A word that is itself in the vocabulary has that id, as in the
public library.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sylvaflow.llm.common import held, small_batches, tidied
from sylvaflow.llm.tokens import SPLITS, _room

VOCABULARY = "byte_bpe_50k.tiktoken"
CORPUS_BYTES = 1 << 20  # bytes of words in one replay; a longer word is a corpus of its own
KEPT_WORDS = 600_000
SHIFT = 20  # a pair is left << SHIFT | right; vocabularies of up to 2^20 ids

#: Beyond these characters a text is split by the full pattern.
UNUSUAL = re.compile("[^\\x20-\\x7e\n\t\rÀ-ÖØ-öø-ÿ]")


def rank_file(name: str) -> str:
    """Path of a rank file, given by path or by the name of a public vocabulary."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> list[bytes]:
    """Bytes of every id, in the order of the ranks."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, file)}
    return [ranks[k] for k in range(len(ranks))]


class Replay:
    """Ids of words by replaying the merges of a rank file over all of them together."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.rank = {word: k for k, word in enumerate(self.tokens)}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.merge: dict[int, int] = {}
        for word, rank in self.rank.items():
            for cut in range(1, len(word)):
                left, right = self.rank.get(word[:cut]), self.rank.get(word[cut:])
                if left is not None and right is not None:
                    self.merge[left << SHIFT | right] = rank
        self.pairs = np.fromiter(sorted(self.merge), np.int64, len(self.merge))
        self.pair_rank = np.fromiter((self.merge[p] for p in self.pairs.tolist()), np.int64, len(self.merge))

    def one_by_one(self, word: bytes) -> list[int]:
        """Ids of one word, the lowest rank first and the leftmost of equals: for words in which a merge makes a pair of a lower rank than its own."""
        parts = self.single[np.frombuffer(word, np.uint8)].tolist()
        while len(parts) > 1:
            ranks = [self.merge.get(a << SHIFT | b, len(self.tokens)) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.tokens):
                break
            at = ranks.index(best)
            parts[at : at + 2] = [best]
        return parts

    def ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word (none of them empty)."""
        out: list[np.ndarray | None] = [None] * len(words)
        corpus: list[int] = []
        size = 0
        for k, word in enumerate(words):
            known = self.rank.get(word)
            if known is not None:
                out[k] = np.array([known], np.uint32)
                continue
            if corpus and size + len(word) > CORPUS_BYTES:
                self._fill(out, corpus, words)
                corpus, size = [], 0
            corpus.append(k)
            size += len(word)
        if corpus:
            self._fill(out, corpus, words)
        return out  # type: ignore[return-value]

    def _fill(self, out: list, corpus: list[int], words: list[bytes]) -> None:
        for k, ids in zip(corpus, self._replay([words[k] for k in corpus])):
            out[k] = ids

    def _replay(self, words: list[bytes]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        chain = self.single[np.frombuffer(b"".join(words), np.uint8)]
        following, before = np.arange(1, len(chain) + 1), np.arange(-1, len(chain) - 1)
        following[ends - 1] = -1
        before[starts] = -1

        index = self._first_index(chain, following)
        ranks = list(index)
        heapq.heapify(ranks)
        merge, symbol, after, prior = self.merge.get, chain.tolist(), following.tolist(), before.tolist()
        lower: set[int] = set()  # positions in words where a merge made a pair of a lower rank
        while ranks:
            rank = heapq.heappop(ranks)
            places = index.pop(rank)
            places.sort()  # the leftmost of overlapping pairs goes first
            for at in places:
                other = after[at]
                if other < 0 or symbol[at] < 0 or merge(symbol[at] << SHIFT | symbol[other]) != rank:
                    continue  # an earlier merge took one of the two
                symbol[at], symbol[other] = rank, -1
                then, earlier = after[other], prior[at]
                after[at] = then
                if then >= 0:
                    prior[then] = at
                    new = merge(rank << SHIFT | symbol[then])
                    if new is not None:
                        if new < rank:
                            lower.add(at)
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(ranks, new)
                if earlier >= 0:
                    new = merge(symbol[earlier] << SHIFT | rank)
                    if new is not None:
                        if new < rank:
                            lower.add(at)
                        if new in index:
                            index[new].append(earlier)
                        else:
                            index[new] = [earlier]
                            heapq.heappush(ranks, new)
        left = np.array(symbol, np.int64)
        alive = np.flatnonzero(left >= 0)
        ids = np.split(left[alive].astype(np.uint32), np.searchsorted(alive, ends[:-1]))
        for k in set((np.searchsorted(starts, sorted(lower), side="right") - 1).tolist()) if lower else ():
            ids[k] = np.array(self.one_by_one(words[k]), np.uint32)
        return ids

    def _first_index(self, chain: np.ndarray, following: np.ndarray) -> dict[int, list[int]]:
        """Positions of every pair of neighbouring bytes that some merge takes, by the rank of the merge."""
        at = np.flatnonzero(following >= 0)
        pair = chain[at] << SHIFT | chain[at + 1]
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[found] == pair
        at, rank = at[hit], self.pair_rank[found[hit]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.diff(rank, prepend=-1))
        return {int(rank[f]): part.tolist() for f, part in zip(first, np.split(at, first[1:]))} if len(first) else {}


class Encoder:
    """Ids of texts; words met before in this worker are looked up, new ones go through one replay a block."""

    def __init__(self, path: str, pattern: str):
        self.replay = Replay(path)
        self.split = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))
        self.latin = SPLITS["byte"] if pattern == public_pattern() else self.split
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.known = 0
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _learn(self) -> None:
        new = list(islice(self.number, self.known, None))
        if not new:
            return
        ids = self.replay.ids([word.encode() for word in new])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        number = self.known + len(new)
        self.first, self.size, self.flat = _room(self.first, number), _room(self.size, number), _room(self.flat, self.used + total)
        self.first[self.known : number] = self.used + np.cumsum(size) - size
        self.size[self.known : number] = size
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.known, self.used = number, self.used + total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if self.known > KEPT_WORDS:
            self.forget()
        number = self.number.__getitem__
        parts = []
        for text in texts:
            words = (self.split if UNUSUAL.search(text) else self.latin).findall(text) if text else []
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._learn()
        word = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        size = self.size[word]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[word] - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[np.cumsum([0] + [len(p) for p in parts])]
        return ids, np.diff(bounds)


def public_pattern() -> str:
    """The split pattern of the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row; the split pattern is that of the public rank files unless one is given."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = (rank_file(vocabulary), pattern or public_pattern())
        encoder = held("merge replay", of, lambda: Encoder(*of))
        for batch in batches:
            ids, size = encoder.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch.column(0), lists], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, column).mapInArrow(tidied(run), schema)


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids one after the other, where each begins, and how long it is."""
    tokens = read_ranks(path)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``ids`` and ``decoded`` (binary) of every row of ``encoded``; null or no ids give no bytes, an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = rank_file(vocabulary)
        data, first, size = held("merge replay", path, lambda: token_bytes(path))
        for batch in batches:
            lists = batch.column(1)
            n_ids = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size[ids])])
            out = data[np.repeat(first[ids] - upto[:-1], size[ids]) + np.arange(upto[-1])]
            bounds = upto[np.concatenate([[0], np.cumsum(n_ids)])]
            decoded = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])
            yield pa.record_batch([batch.column(0), lists, decoded.cast(pa.binary())], names=[key, "ids", "decoded"])

    schema = T.StructType([*encoded.select(key, "ids").schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.select(key, "ids").mapInArrow(tidied(run), schema)
