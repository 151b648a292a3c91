"""Observation and yearly tables: declared schemas, normalization, idempotent appends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaflow import params as P
from sylvaflow.functions.columns import finite
from sylvaflow.operators.verdicts import latest_by

KEY = ["stand_id", "image_id"]


def observation_schema(index: str = "ndvi") -> T.StructType:
    extra = {index: "float", f"{index}_n_pixels": "int"}
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in {**P.OBSERVATION_TYPES, **extra}.items()))


def normalize(raw: DataFrame, areas: DataFrame, index: str = "ndvi") -> DataFrame:
    """Raw rows to the declared schema: renames, missing columns, dates from epoch milliseconds,
    expected pixels and coverage from the stand area; missing integers become 0."""
    names = {f"{index}_mean": index, f"{index}_count": f"{index}_n_pixels", "valid_count": "n_pixels", "valid_sum": "pixel_weight_sum"}
    df = raw.select([F.col(c).alias(names.get(c, c)) for c in raw.columns])
    schema = observation_schema(index)
    missing = [f for f in schema.fields if f.name not in df.columns]
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df
    if "time_ms" in raw.columns:
        stamp = F.timestamp_millis(F.col("time_ms").cast("bigint"))
        df = df.withColumns({"date": F.date_format(stamp, "yyyy-MM-dd"), "year": F.year(stamp), "doy": F.dayofyear(stamp)})
    df = df.drop("area_m2").join(areas.select("stand_id", "area_m2"), "stand_id", "left")
    expected = F.col("area_m2") / P.PIXEL_AREA_M2
    df = df.withColumns({"expected_pixels": expected, "coverage_fraction": finite("pixel_weight_sum") / F.nullif(expected, F.lit(0.0))})

    def typed(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            return F.coalesce(c.cast(f.dataType), F.lit(0).cast(f.dataType)).alias(f.name)
        return c.cast(f.dataType).alias(f.name)

    return df.select([typed(f) for f in schema.fields])


def append(existing: DataFrame, batch: DataFrame, keys: Sequence[str] = KEY, order: str = "time_ms") -> DataFrame:
    """Union in which a key is kept once: the batch replaces, its last row wins."""
    last = latest_by(batch, keys, [order]).select(batch.columns)
    return existing.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def write_batch(frame: DataFrame, path: str, batch: int) -> None:
    """Write one batch of observations; a batch that is written again replaces itself."""
    conf = frame.sparkSession.conf
    before = conf.get("spark.sql.sources.partitionOverwriteMode")
    conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        frame.withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy("batch", "year").parquet(path)
    finally:
        conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_observations(spark: SparkSession, path: str, index: str = "ndvi") -> DataFrame:
    """Observations of all batches, every stand and scene once (the latest batch wins)."""
    schema = observation_schema(index).add("batch", T.IntegerType())
    rows = spark.read.schema(schema).parquet(path)
    return latest_by(rows, KEY, ["batch", "time_ms"]).select(observation_schema(index).names)


def read_annual(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_annual(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").partitionBy("year").parquet(path)


def merge_manifest(previous: Mapping, current: Mapping) -> dict:
    """Chunk bookkeeping of two fetches: a chunk that succeeds later is no longer failed."""
    asked = set(current.get("chunks_requested", []))
    failed_now = current.get("chunks_failed", {})
    old = {k: v for k, v in previous.get("chunks_failed", {}).items() if k not in asked}
    both = lambda key, f: f(x for x in (previous.get(key), current.get(key)) if x is not None)
    return {
        **current,
        "chunks_requested": sorted(set(previous.get("chunks_requested", [])) | asked),
        "chunks_failed": {**old, **failed_now},
        "start_year": both("start_year", min), "end_year": both("end_year", max),
    }
