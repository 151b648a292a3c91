"""Token ids on disk: raw id payloads with a minimal perfect hash from document keys to places.

Documents are dealt out by ranges of their key; a task writes its range as one
shard file: the raw ids, then the keys, then the index. The index holds levels
of bit arrays (a key belongs to the first level where its bit is its own), the
rank of the set bit numbers the key, and the numbered table stores a 32-bit
fingerprint, the first id and the number of ids. A lookup takes a bounded
number of steps, and a key that is not there fails its fingerprint.

A task writes under a name of its attempt and then renames, so a task that
runs again leaves the same files. Keys are routed to shards by the first key
of each shard. Cases: null text is empty (its end id alone); rows with a null
key are stored first, without an index entry; of repeated keys the index names
the first row, all are stored; an empty table gives no shard.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow.llm.common import mix, partitions_for, shared_folder, small_batches, text_bytes, tidied
from sylvaflow.llm.tokens import encoder

MAGIC = b"IDSHARD1"
SHARD_TEXT = 24 << 20
SPARE = 2  # bits of a level per key


def filesystem(uri: str):
    """The Arrow file system of a folder and the path in it."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class PerfectHash:
    """Numbers ``n`` different 64-bit keys from 0 to ``n - 1``; foreign keys get -1 or a number."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        self.ranks = []
        for bits in levels:
            ones = np.unpackbits(bits)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones.reshape(-1, 64).sum(axis=1))]).astype(np.int64))
            self.before.append(total)
            total += int(self.ranks[-1][-1])
        self.size = total

    @staticmethod
    def _at(keys: np.ndarray, level: int, nbits: int) -> np.ndarray:
        return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(nbits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.unique(keys.astype(np.uint64)), []
        while len(left):
            nbits = max(64, -(-len(left) * SPARE // 64) * 64)
            at = cls._at(left, len(levels), nbits)
            own = np.bincount(at, minlength=nbits) == 1
            levels.append(np.packbits(own))
            left = left[~own[at]]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._at(keys[open_], level, len(bits) * 8)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            found, where = open_[hit], at[hit]
            words = bits.reshape(-1, 8)[where >> 6]
            ones = np.unpackbits(words, axis=1)
            inside = (ones * (np.arange(64) < (where & 63)[:, None])).sum(axis=1)
            out[found] = self.before[level] + self.ranks[level][where >> 6] + inside
            open_ = open_[~hit]
        return out


ENTRY = np.dtype([("fingerprint", "<u4"), ("first", "<i8"), ("count", "<u4")])


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A shard file opened for keyed and for sequential reading."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = struct.unpack("<8sQQQQQ", self._read(size - 48, 48))
        magic, self.n_docs, self.n_ids, self.width, at_keys, at_index = tail
        if magic != MAGIC:
            raise ValueError(f"{uri} is no id shard")
        self.keys = np.frombuffer(self._read(at_keys, 17 * self.n_docs), np.uint8)
        n = self.n_docs
        self.key_values = np.frombuffer(self.keys[: 8 * n].tobytes(), "<i8")
        self.starts = np.frombuffer(self.keys[8 * n : 16 * n].tobytes(), "<i8")
        self.has_key = self.keys[16 * n :].astype(bool)
        raw = self._read(at_index, size - 48 - at_index)
        n_levels, n_entries = struct.unpack_from("<QQ", raw)
        sizes = struct.unpack_from(f"<{n_levels}Q", raw, 16)
        pos, levels = 16 + 8 * n_levels, []
        for s in sizes:
            levels.append(np.frombuffer(raw, np.uint8, s, pos))
            pos += s
        self.index = PerfectHash(levels)
        self.table = np.frombuffer(raw, ENTRY, n_entries, pos)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def ids(self, first: int, count: int) -> np.ndarray:
        raw = self._read(first * self.width, count * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 for a key that is not in the shard."""
        keys = keys.astype(np.int64).view(np.uint64)
        number = self.index.lookup(keys)
        first, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        known = np.flatnonzero(number >= 0)
        entry = self.table[number[known]]
        same = entry["fingerprint"] == fingerprint(keys[known])
        first[known[same]], count[known[same]] = entry["first"][same], entry["count"][same]
        return first, count


def _write_shards(folder: str, vocabulary: str, kind: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        task = TaskContext.get()
        files, path = filesystem(folder)
        mine = f"{path}/.writing-{task.partitionId():06d}-{task.taskAttemptId()}"
        keys, has, counts = [], [], []
        sink = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                sink = files.open_output_stream(mine)
            names, texts = batch.column(0), batch.column(1).to_pylist()
            has.append(names.is_valid().to_numpy(zero_copy_only=False))
            keys.append(names.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for at in range(0, len(texts), 200):
                ids = enc.encode(texts[at : at + 200])
                counts += [len(x) + 1 for x in ids]
                end = np.array([end_id], np.uint32)
                sink.write(np.concatenate([part for x in ids for part in (x, end)]).astype(f"<u{width}").tobytes())
        if sink is None:
            return
        key, known, count = np.concatenate(keys), np.concatenate(has), np.array(counts, np.int64)
        start = (np.cumsum(count) - count).astype("<i8")
        at_keys = int(count.sum()) * width
        sink.write(key.tobytes() + start.tobytes() + known.astype(np.uint8).tobytes())
        different, row = np.unique(key[known].view(np.uint64), return_index=True)
        index = PerfectHash.build(different)
        table = np.zeros(len(different), ENTRY)
        number = index.lookup(different)
        table["fingerprint"][number] = fingerprint(different)
        table["first"][number], table["count"][number] = start[known][row], count[known][row]
        levels = index.levels
        sink.write(struct.pack(f"<QQ{len(levels)}Q", len(levels), len(table), *map(len, levels)))
        for bits in levels:
            sink.write(bits.tobytes())
        sink.write(table.tobytes())
        sink.write(struct.pack("<8sQQQQQ", MAGIC, len(key), int(count.sum()), width, at_keys, at_keys + 17 * len(key)))
        sink.close()
        name = f"shard-{task.partitionId():06d}.ids"
        files.move(mine, f"{path}/{name}")
        bounds = key[known]
        yield pa.record_batch(
            [pa.array([name]), pa.array([task.partitionId()]), pa.array([len(key)]), pa.array([int(count.sum())]), pa.array([int(bounds[0]) if len(bounds) else None], pa.int64()), pa.array([int(bounds[-1]) if len(bounds) else None], pa.int64())],
            names=["name", "shard", "docs", "ids", "first_key", "last_key"],
        )

    return run


def write_ids(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", kind: str = "byte", end_id: int = 2, key: str = "doc_id", text: str = "text", shard_text: int = SHARD_TEXT) -> list[dict]:
    """Write the ids of all documents in ascending key order; returns the manifest, one entry per shard, which is also ``manifest.json``.

    ``first_id`` of an entry is the number of ids in all shards before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = partitions_for(spark, text_bytes(docs), shard_text)
    width = 2 if encoder(vocabulary, kind).library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    dealt = docs.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    schema = "name string, shard long, docs long, ids long, first_key long, last_key long"
    table = f"{folder}/manifest.parquet"
    dealt.mapInArrow(tidied(_write_shards(folder, vocabulary, kind, end_id, width)), schema).write.parquet(table)
    manifest = [r.asDict() for r in spark.read.schema(schema).parquet(table).orderBy("shard").collect()]
    total = 0
    for entry in manifest:
        entry["first_id"] = total
        total += entry["ids"]
    with files.open_output_stream(f"{path}/manifest.json") as sink:
        sink.write(json.dumps(manifest).encode())
    return manifest


def _read_shards(folder: str, manifest: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                entry = manifest[number]
                shard = Shard(f"{folder}/{entry['name']}")
                n = shard.n_docs
                ends = np.append(shard.starts[1:], shard.n_ids)
                for at in range(0, n, 500):
                    rows = slice(at, min(n, at + 500))
                    first, count = shard.starts[rows].copy(), (ends - shard.starts)[rows].copy()
                    keyed = shard.has_key[rows] & ~np.append([False], shard.key_values[1:] == shard.key_values[:-1])[rows]
                    first[keyed], count[keyed] = shard.find(shard.key_values[rows][keyed])
                    if (first < 0).any():
                        raise ValueError(f"{entry['name']} misses keys it holds")
                    low, high = int(first.min()), int((first + count).max())
                    ids = shard.ids(low, high - low)
                    yield pa.record_batch(
                        [
                            pa.array(shard.key_values[rows], mask=~shard.has_key[rows]), pa.array(first + entry["first_id"]), pa.array(count),
                            pa.array([ids[a - low : a - low + c].tobytes() for a, c in zip(first.tolist(), count.tolist())], pa.binary()),
                        ],
                        names=["key", "start", "n_tokens", "ids"],
                    )

    return run


def read_ids(spark: SparkSession, folder: str, manifest: list[dict], key: str = "doc_id") -> DataFrame:
    """All documents of a store: key, first id over all shards, number of ids and ``ids`` (unsigned 32-bit little-endian), each found by its index."""
    schema = f"`{key}` long, start long, n_tokens long, ids binary"
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = spark.range(0, len(manifest), 1, len(manifest))
    return shards.mapInArrow(tidied(_read_shards(folder, manifest)), "key long, start long, n_tokens long, ids binary").toDF(key, "start", "n_tokens", "ids")


def lookup_ids(keys: DataFrame, folder: str, manifest: list[dict], key: str = "doc_id") -> DataFrame:
    """Keyed access: the ids of each key of ``keys``, null where the store has none. Keys go to the one shard whose range holds them."""
    spark = keys.sparkSession
    held = [(i, e["first_key"], e["last_key"]) for i, e in enumerate(manifest) if e["first_key"] is not None]
    lows = np.array([h[1] for h in held], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Shard] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            found: list[bytes | None] = [None] * len(names)
            for k, name in enumerate(names):
                at = int(np.searchsorted(lows, name, side="right")) - 1 if name is not None and len(lows) else -1
                if at >= 0 and np.searchsorted(lows, name) <= at and lows[at] == name:
                    at = int(np.searchsorted(lows, name))  # a key that fills several shards starts in the first
                    if at and held[at - 1][2] == name:
                        at -= 1
                if at < 0:
                    continue
                if at not in opened:
                    if len(opened) >= 8:
                        opened.clear()
                    opened[at] = Shard(f"{folder}/{manifest[held[at][0]]['name']}")
                first, count = opened[at].find(np.array([name], np.int64))
                if first[0] >= 0:
                    found[k] = opened[at].ids(int(first[0]), int(count[0])).tobytes()
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["key", "ids"])

    small_batches(spark)
    return keys.select(F.col(key).cast("long").alias("key")).mapInArrow(tidied(run), "key long, ids binary").toDF(key, "ids")


def stored_ids(docs: DataFrame, **options) -> DataFrame:
    """Write the ids of ``docs`` to a new folder of the shared storage and read them back."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "ids")
    return read_ids(spark, folder, write_ids(docs, folder, **options))
