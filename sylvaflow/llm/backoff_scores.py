"""Stupid-backoff language-model scores of every document under the n-grams of all other documents.

The score of a word is ``c(n-gram) / c(its first n - 1 words)`` for the longest
n-gram that other documents hold, times 0.4 for each order that was given up;
counts are of all documents less the scored one, so a document does not vouch
for itself. A word no other document holds counts as one in all words.

Documents are dealt to chunks by a hash. A chunk counts its own n-grams, then
sends its sorted keys and counts to the tables, which are partitioned by ranges
of the hash; a table adds up the counts of all chunks and answers each chunk in
the order of its keys. The chunk joins the answers to the n-grams of its
documents and sums per document. A key crosses once per chunk however often it
occurs. Keys keep 56 bits of the hash.

Cases: null and empty texts have no words, sum 0 and a null mean; repeated rows
are scored each, as different documents; an empty table gives no rows; extra
columns are ignored; the only document of a corpus has all words unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.common import blocks, bounds_of, cut_points, grams, pack_sorted, partitions_for, small_batches, text_column, tidied, tidy, unpack_sorted, word_spans, words

ORDER = 3
GIVE_UP = float(np.log(0.4))
CHUNK_TEXT = 6 << 20
TABLE_TEXT = 8 << 20
KEEP = np.uint64(0xFFFFFFFFFFFFFF00)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nbytes = nwords = 0
    for batch in batches:
        for _, texts in blocks(text_column(batch)):
            nbytes += len(texts.data)
            nwords += len(word_spans(texts.data)[0])
    yield pa.record_batch([pa.array([nbytes]), pa.array([nwords])], names=["nbytes", "nwords"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""
    r = docs.select("text").mapInArrow(tidied(_sizes), "nbytes long, nwords long").agg(F.sum("nbytes"), F.sum("nwords")).first()
    return int(r[0] or 0), int(r[1] or 0)


def chunk_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts of a chunk and the row each lies in."""
    parts = [(w, t + row) for row, texts in blocks(column) for w, t in [words(texts)]]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def chunk_grams(word: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return grams(word, row, n)[0] & KEEP


def _pack(doc_chunk_bytes: int = 16 << 20):
    """Rows of a chunk as compressed record batches: the text crosses the shuffle once, in less than half of its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > doc_chunk_bytes:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)
        held = []
        tidy()

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        chunk = table["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        names, first = np.unique(chunk[order], return_index=True)
        packed = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema.remove(0), options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.drop_columns(["chunk"]).take(pa.array(order[a:b])).combine_chunks())
            packed.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(names), pa.array(packed, pa.binary())], names=["chunk", "docs"])

    return run


def _unpack(column: pa.Array | pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in column])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those from 255 on follow in full."""
    large = counts[counts >= 255].astype("<i8")
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def _wide(value: bytes) -> np.ndarray:
    n = int.from_bytes(value[:8], "little")
    counts = np.frombuffer(value, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(value, "<i8", offset=8 + n)
    return counts


def _count_chunk(order: int, tables: int):
    """Per order and table: the chunk's different n-grams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Scalar]] = {}
        for batch in batches:
            for c, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(c, []).append(packed)
        for c, packed in held.items():
            word, row = chunk_words(text_column(_unpack(packed)))
            for n in range(1, order + 1):
                keys, counts = np.unique(chunk_grams(word, row, n), return_counts=True)
                cut = cut_points(keys, tables)
                rows: list[list] = [[] for _ in range(4)]
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    mine = slice(cut[b], cut[b + 1])
                    for col, value in zip(rows, (n * tables + b, c, pack_sorted(keys[mine] >> np.uint64(8)), _narrow(counts[mine]))):
                        col.append(value)
                yield pa.record_batch([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["tab", "chunk", "keys", "counts"])
            del word, row, keys, counts, rows
            tidy()

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Total of every key of a table, sent back to each chunk in the order of its own keys."""
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    key = np.concatenate(keys)
    del keys
    counts = np.concatenate([_wide(c) for c in table["counts"].to_pylist()])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(key))))
    ends = np.cumsum(size)
    answer = [_narrow(total[e - s : e]) for s, e in zip(size.tolist(), ends.tolist())]
    del key, counts, order, first, total
    tidy()
    return pa.table([table["chunk"], table["tab"], pa.array(answer, pa.binary())], names=["chunk", "tab", "totals"])


def position_scores(word: np.ndarray, row: np.ndarray, others: list[np.ndarray], all_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log score of every word and the order it was found at (0: unseen).

    ``others[n - 1]`` holds, for each word, how often the n-gram that ends there
    occurs in other documents (0 where a text is too short for one);
    ``all_words`` the number of words of the other documents, for each word.
    """
    at = np.arange(len(word)) - np.searchsorted(row, row)
    longest = np.minimum(at + 1, len(others))
    found = np.zeros(len(word), np.int64)
    score = -np.log(all_words + 1.0)
    for n in range(1, len(others) + 1):
        hit = np.flatnonzero(others[n - 1] > 0)
        below = all_words[hit] if n == 1 else others[n - 2][hit - 1]
        score[hit] = np.log(others[n - 1][hit]) - np.log(below)
        found[hit] = n
    return score + GIVE_UP * (longest - found), found


def _score_chunk(order: int, tables: int, all_words: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "log_score", "mean_log_score", "n_full"]
        docs = _unpack(docs["docs"])
        word, row = chunk_words(text_column(docs))
        n = docs.num_rows
        first = bounds_of(row, n)
        size = np.diff(first)
        tab, totals = answers["tab"].to_numpy(), answers["totals"]
        others = []
        for k in range(1, order + 1):
            keys, number = np.unique(chunk_grams(word, row, k), return_inverse=True)
            mine = np.flatnonzero((tab >= k * tables) & (tab < (k + 1) * tables))
            mine = mine[np.argsort(tab[mine])]
            total = np.concatenate([_wide(totals[i].as_py()) for i in mine.tolist()]) if len(mine) else np.zeros(0, np.int64)
            at = np.arange(len(word)) - first[row] >= k - 1
            code = row[at] * max(1, len(keys)) + number
            _, same, own = np.unique(code, return_inverse=True, return_counts=True)
            count = np.zeros(len(word), np.int64)
            count[at] = total[number] - own[same]
            others.append(count)
            del keys, number, code, same, own, at
        score, found = position_scores(word, row, others, (all_words - size)[row])
        total = np.bincount(row, weights=score, minlength=n).astype(np.float64)
        full = np.bincount(row, weights=found == order, minlength=n).astype(np.int64)
        mean = pa.array(total / np.maximum(size, 1), mask=size == 0)
        del word, row, others, score, found
        tidy()
        return pa.table([docs["doc_id"], pa.array(size), pa.array(total), mean, pa.array(full)], names=names)

    return run


def score_documents(docs: DataFrame, order: int = ORDER, chunk_text: int = CHUNK_TEXT, table_text: int = TABLE_TEXT) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_score`` (natural, summed), ``mean_log_score``, ``n_full`` (words found at the full order) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    nbytes, nwords = corpus_size(docs)
    chunks, tables = partitions_for(spark, nbytes, chunk_text), partitions_for(spark, nbytes, table_text)
    key_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "text", "doc_id")
    dealt = rows.mapInArrow(tidied(_pack()), "chunk long, docs binary").repartition(chunks, "chunk")
    sent = dealt.mapInArrow(tidied(_count_chunk(order, tables)), "tab long, chunk long, keys binary, counts binary")
    answers = sent.groupBy("tab").applyInArrow(_add_up, "chunk long, tab long, totals binary").toDF("chunk_", "tab", "totals").repartition(chunks, "chunk_")
    schema = f"doc_id {key_type}, n_words long, log_score double, mean_log_score double, n_full long"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk_")).applyInArrow(_score_chunk(order, tables, nwords), schema)
