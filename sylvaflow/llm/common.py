"""Small helpers of the training-data operators: shared folders, Arrow batches, words and hashes of a batch of texts.

The operators work on Arrow batches inside tasks that Spark partitions. Keys
of many small items (words, n-grams, parts of sketches) cross a shuffle packed:
a task sorts and counts its own keys first, then sends one binary row per
bucket, so that a key that half of the documents hold crosses once per task.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_BLOCK = 1 << 20  # bytes of text that one vectorised step works on
BATCH_ROWS = 1000  # rows of an Arrow batch; texts are long
BATCH_BYTES = 8 << 20  # bytes of an Arrow batch

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_G1, _G2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run):
    """A task function that gives memory back when its partition is done."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


_HELD: dict = {}


def held(owner: str, key, make):
    """A table that a worker keeps between tasks; the tables of one operator go when another one asks for its own."""
    if _HELD.get("owner") != owner:
        _HELD.clear()
        _HELD["owner"] = owner
        tidy()
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, nbytes: int = BATCH_BYTES) -> None:
    """Arrow batches of at most ``rows`` rows and about ``nbytes`` bytes, so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= nbytes:
        spark.conf.set(key, f"{nbytes}b")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a local session takes one under the warehouse folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: later jobs do not run its plan again, and it outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, nbytes: float, each: float) -> int:
    """Number of partitions so that one holds about ``each`` of ``nbytes`` bytes; at least the session's shuffle partitions."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // each)))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on an array of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _G1
    x ^= x >> np.uint64(27)
    x *= _G2
    x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte_value = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return byte_value, inverse


BYTE_VALUE, BASE_INVERSE = _tables()
_POWERS: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base or of its inverse, modulo 2^64; kept between calls."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        step = BASE if kind == "up" else BASE_INVERSE
        grown = np.full(max(n, TEXT_BLOCK + 4096), step, dtype=np.uint64)
        grown[0] = 1
        have = _POWERS[kind] = np.cumprod(grown)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences give the hash of any byte range, see ``range_hash``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers("up", len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``end``; equal ranges have equal hashes wherever they lie in a block."""
    return (prefix[end] - prefix[start]) * powers("down", len(prefix))[start]


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Texts:
    """UTF-8 bytes of a run of texts, each followed by a line feed, with the place of each text."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = data, start, end

    def __len__(self) -> int:
        return len(self.start)


def text_column(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        return column
    return column.cast(pa.large_string())


def blocks(column: pa.Array, limit: int = TEXT_BLOCK) -> Iterator[tuple[int, Texts]]:
    """The texts of a column in runs of about ``limit`` bytes (one longer text is a run of its own), with the row of the first. Null counts as empty."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, np.diff(offsets), 0)
    row = 0
    while row < n:
        upto = row + 1
        total = int(lengths[row]) + 1
        while upto < n and total + lengths[upto] + 1 <= limit:
            total += int(lengths[upto]) + 1
            upto += 1
        size = lengths[row:upto]
        end = np.cumsum(size + 1) - 1
        start = end - size
        if valid[row:upto].all():
            data = np.empty(total, dtype=np.uint8)
            first = int(offsets[row])
            span = raw[first : int(offsets[upto])]
            keep = np.ones(total, bool)
            keep[end] = False
            data[keep] = span
        else:
            data = np.empty(total, dtype=np.uint8)
            for k in range(upto - row):
                if size[k]:
                    at = int(offsets[row + k])
                    data[start[k] : end[k]] = raw[at : at + int(size[k])]
        data[end] = 10
        yield row, Texts(data, start, end)
        row = upto


def words(texts: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes other than ASCII white space) and the text it lies in."""
    data = LOWER[texts.data] if lower else texts.data
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = mix(range_hash(prefix_hash(data), start, end) + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(texts.start, start, side="right") - 1


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def grams(word: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside a text, in order, with its text."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(word) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * BASE + word[k : k + size]
    inside = text[:size] == text[n - 1 :]
    return mix(out[inside]), text[:size][inside]


def bounds_of(text: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` texts begins in a sorted array of text numbers, and its length at the end."""
    return np.searchsorted(text, np.arange(n + 1))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket from the upper half of a key, so that the order of keys is also the order of buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cut_points(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Borders of ``n`` buckets in sorted keys."""
    edges = ((np.arange(1, n, dtype=np.uint64) << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n)
    inner = np.searchsorted(sorted_keys, edges << np.uint64(32))
    return np.concatenate([[0], inner, [len(sorted_keys)]]).astype(np.int64)


def as_binary(parts: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def from_binary(value: bytes | None, dtype) -> np.ndarray:
    return np.frombuffer(value or b"", dtype=dtype)


BITMAP_BITS = 1 << 25


def bitmap_slot(name: str):
    return F.pmod(F.xxhash64(name), F.lit(BITMAP_BITS))


def id_bitmap(ids: DataFrame, slot=None) -> np.ndarray:
    """Bits of a fixed size (4 MB) with one set for every id: it may say yes for others, never no for one of them.

    The words are made by the tasks; at most 2^19 of them reach the driver.
    """
    name = ids.columns[0]
    slots = ids.where(F.col(name).isNotNull()).select((bitmap_slot(name) if slot is None else slot).alias("slot"))
    rows = slots.groupBy(F.expr("shiftright(slot, 6) AS w")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT))) AS bits"))
    got = rows.toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[got["w"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as differences of the fewest bytes that hold the largest one."""
    if not len(keys):
        return b""
    step = np.empty(len(keys), np.uint64)
    step[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=step[1:])
    first, step[0] = int(step[0]), 0
    width = max(1, -(-int(step.max()).bit_length() // 8))
    body = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + first.to_bytes(8, "little") + body.tobytes()


def unpack_sorted(value: bytes | None) -> np.ndarray:
    if not value:
        return np.zeros(0, np.uint64)
    width = value[0]
    body = np.frombuffer(value, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(body), 8), np.uint8)
    step[:, :width] = body
    step = step.view("<u8").ravel()
    step[0] = int.from_bytes(value[1:9], "little")
    return np.cumsum(step, dtype=np.uint64)


def only_marked(bitmap: np.ndarray, wanted: bool):
    """For ``mapInArrow``: rows whose slot (the last column, which goes) is in the bitmap, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(bitmap, batch.column(batch.num_columns - 1).to_numpy()) == wanted
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep, pa.bool_()))

    return run


def split_marked(df: DataFrame, key: str, bitmap: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be one of a bitmap's ids, and the rows that surely are not: only the first need a join."""
    slotted = df.withColumn("__slot", bitmap_slot(key))
    kept = df.schema
    return slotted.mapInArrow(tidied(only_marked(bitmap, True)), kept), slotted.mapInArrow(tidied(only_marked(bitmap, False)), kept)
