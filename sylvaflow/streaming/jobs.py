"""Incremental jobs on streams: observations, answers, yearly metrics, running evidence.

The sinks are idempotent: a micro-batch that is replayed after a failure writes the same
partition again.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sylvaflow.operators.observations import annual_frame
from sylvaflow.operators.verdicts import latest_by


def start_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available with a batch function, then stop."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


# --- observations ------------------------------------------------------------------------
SLOTS = 64


def append_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Append rows whose key is not in the table yet, in any delay: no row is too late.

    A batch owns one partition, and only earlier batches count as known, so that a replay
    writes the same rows. Inside a batch the rows lie in slots by a hash of the key, so the
    comparison with earlier batches is pruned to the slots of the new rows.
    """
    join = [*keys, "slot"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys).withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int"))
        known = existing(spark, path)
        if known is not None:
            fresh = fresh.join(known.where(F.col("batch") < number).select(*join), join, "left_anti")
        fresh.drop("batch").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/batch={number}")

    return write


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None before the first batch has written rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# --- answers -------------------------------------------------------------------------------
def latest_answers(stream: DataFrame) -> DataFrame:
    """Last answer per interpreter and item as a running aggregation (update or complete mode)."""
    rest = [c for c in stream.columns if c not in ("interpreter", "item")]
    return stream.groupBy("interpreter", "item").agg(F.max_by(F.struct(*rest), F.struct("saved", "line")).alias("last"))


def answers_from(running: DataFrame) -> DataFrame:
    """Answers in force from the running table: the last line decides, then voids go."""
    return running.select("interpreter", "item", "last.*").where(~F.coalesce(F.col("void"), F.lit(False)))


def upsert_sink(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Keep the latest row per key: a batch writes its own latest rows, readers fold the batches.

    A batch never rewrites earlier ones, and rows that come late lose to later ones by their order.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest_by(batch, keys, order).select(batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_rows(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The row in force of every key: the last folded table and the batches after it."""
    return latest_by(_unfolded(spark, path, folded_upto(spark, path)), keys, [*order, "batch"]).drop("batch")


def folded_upto(spark: SparkSession, path: str) -> int | None:
    """Number of the last batch that a folded table covers, from the manifest; None before the first fold."""
    manifest = existing(spark, f"{path}_manifest")
    return None if manifest is None else manifest.agg(F.max("upto")).first()[0]


def _unfolded(spark: SparkSession, path: str, upto: int | None) -> DataFrame:
    batches = spark.read.parquet(path)
    if upto is None:
        return batches
    folded = spark.read.parquet(f"{path}_folded/upto={upto}").select(batches.columns)
    return folded.unionByName(batches.where(F.col("batch") > upto))


def fold(spark: SparkSession, path: str, keys: list[str], order: list[str], upto: int) -> None:
    """Write the rows in force after batch ``upto`` as one table and enter it in the manifest.

    The table goes to a folder of its own number before the manifest names it, so a reader sees
    the old state or the new one, and a fold that is repeated writes the same rows. Batches stay
    as they are; readers skip those that are folded, so a batch that is replayed changes nothing.
    """
    before = folded_upto(spark, path)
    if before is not None and before >= upto:
        return
    rows = _unfolded(spark, path, before).where(F.col("batch") <= upto)
    latest_by(rows, keys, [*order, "batch"]).write.mode("overwrite").parquet(f"{path}_folded/upto={upto}")
    spark.createDataFrame([(upto,)], "upto bigint").write.mode("append").parquet(f"{path}_manifest")


def folding(sink: Callable[[DataFrame, int], None], path: str, keys: list[str], order: list[str], every: int = 16) -> Callable[[DataFrame, int], None]:
    """A sink that folds the batches after every ``every`` of them, so that a read meets at most that many."""

    def write(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        if number % every == every - 1:
            fold(batch.sparkSession, path, keys, order, number)

    return write


# --- yearly metrics ---------------------------------------------------------------------------
def annual_sink(observations: str, annual: str, years: tuple[int, int]) -> Callable[[DataFrame, int], None]:
    """Recompute all years of the stands a batch touches.

    Drop counts and area belong to the stand, so every year of it changes with them.
    Observations are appended first; the rows go to the batch's own partition, and readers
    take the latest batch of a stand-year.
    """
    add = append_sink(observations, ["stand_id", "image_id"])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        add(batch, number)
        every = spark.read.parquet(observations).where(F.col("batch") <= number).drop("batch", "slot")
        mine = every.join(batch.select("stand_id").distinct(), "stand_id", "left_semi")
        annual_frame(mine, years).write.mode("overwrite").parquet(f"{annual}/batch={number}")

    return write


def read_annual(spark: SparkSession, path: str) -> DataFrame:
    return latest_rows(spark, path, ["stand_id", "year"], [])


# --- running evidence -----------------------------------------------------------------------------
EVIDENCE = "unit string, row int, col int, t int, prob double, onset int, version int"
SIDE = 64  # cells of a tile's side: the arrays of a tile and date take 32 kB


def running_evidence(stream: DataFrame, prior: float, *, decay: float = 1.0, side: int = SIDE) -> DataFrame:
    """Running evidence of each cell over its dates: posterior and start of the run.

    ``stream``: unit, row, col, t, llr. The state belongs to a tile of ``side`` x ``side`` cells
    and holds one array of evidence per date, not a number for absent cells; a batch puts its
    values in and the dates are folded with one array step each, whatever the number of cells.
    A date may come late: all dates from the first new one on are given again under a higher
    ``version``, and the row of the highest version of a cell and date is in force
    (``evidence_in_force``).
    """
    low = min(max(prior, 1e-4), 1 - 1e-4)
    base = log(low / (1 - low))
    tiles = stream.withColumns({"_tr": F.floor(F.col("row") / side).cast("int"), "_tc": F.floor(F.col("col") / side).cast("int")})

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, tr, tc = key
        dates, stack, version = [], np.empty((0, side * side)), 0
        if state.exists:
            known, packed, version = state.get
            dates, stack = list(known), np.frombuffer(packed, "float64").reshape(-1, side * side).copy()
        rows = pd.concat(list(frames))
        for t in sorted(set(rows["t"].tolist()) - set(dates)):
            at = bisect(dates, t)
            dates.insert(at, t)
            stack = np.insert(stack, at, np.nan, axis=0)
        place = (rows["row"].to_numpy("int64") - tr * side) * side + rows["col"].to_numpy("int64") - tc * side
        stack[np.searchsorted(dates, rows["t"].to_numpy()), place] = rows["llr"].fillna(0.0).to_numpy("float64")
        total, start = np.zeros(side * side), np.full(side * side, -1)
        first = int(rows["t"].min())
        for t, llr in zip(dates, stack, strict=True):
            seen = ~np.isnan(llr)
            carry = np.maximum(0.0, decay * total)
            start = np.where(seen & (carry <= 0), t, start)
            total = np.where(seen, carry + np.nan_to_num(llr), total)
            if t < first:
                continue
            cell = np.flatnonzero(seen)
            onset = np.where(total[cell] > 0, start[cell], -1)
            prob = 1.0 / (1.0 + np.exp(-(base + total[cell])))
            yield pd.DataFrame({"unit": unit, "row": tr * side + cell // side, "col": tc * side + cell % side, "t": t, "prob": prob, "onset": onset, "version": version + 1})
        state.update(([int(t) for t in dates], stack.tobytes(), version + 1))

    grouped = tiles.groupBy("unit", "_tr", "_tc")
    return grouped.applyInPandasWithState(update, EVIDENCE, "dates array<int>, stack binary, version int", "append", GroupStateTimeout.NoTimeout)


def evidence_in_force(rows: DataFrame) -> DataFrame:
    """Of every cell and date the row of the highest version."""
    return latest_by(rows, ["unit", "row", "col", "t"], ["version"])
