"""Views of the given tables in the shape of the analytics inputs.

Each view exists twice, as a DataFrame for the engine and as a SQL common table
expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow.functions.columns import lookup


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Observations: one row per order.
SENSOR_OF = {"1": "L5", "2": "L7", "3": "L8", "4": "L9", "5": "L7"}


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return observation_rows(table(spark, sf, "orders"))


def observation_rows(o: DataFrame) -> DataFrame:
    key, stand = F.col("o_orderkey"), F.col("o_custkey") % 100
    area = F.when(stand % 25 == 0, 2700.0).otherwise(900.0 * (8 + stand % 30))
    cover = (4 + key % 7) / 8.0
    index = (F.col("o_totalprice") % 997) / 997.0
    return o.select(
        stand.cast("string").alias("stand_id"),
        key.cast("string").alias("image_id"),
        lookup(F.substring("o_orderpriority", 1, 1), SENSOR_OF).alias("sensor"),
        F.year("o_orderdate").alias("year"),
        F.dayofyear("o_orderdate").alias("doy"),
        (20 + key % 3).cast("int").alias("wrs_path"),
        (key % 50).cast("int").alias("n_pixels"),
        (cover * area / 900.0).alias("pixel_weight_sum"),
        area.alias("area_m2"),
        cover.alias("coverage_fraction"),
        F.when(key % 23 == 0, None).when(key % 41 == 0, 1.5).otherwise(index).alias("ndvi"),
    )


OBS = """obs AS (
  SELECT CAST(o_custkey % 100 AS VARCHAR) AS stand_id, CAST(o_orderkey AS VARCHAR) AS image_id,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'L5' WHEN '2' THEN 'L7' WHEN '3' THEN 'L8'
              WHEN '4' THEN 'L9' WHEN '5' THEN 'L7' END AS sensor,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
         CAST(20 + o_orderkey % 3 AS INTEGER) AS wrs_path, CAST(o_orderkey % 50 AS INTEGER) AS n_pixels,
         CASE WHEN (o_custkey % 100) % 25 = 0 THEN 2700.0::DOUBLE
              ELSE 900.0::DOUBLE * (8 + (o_custkey % 100) % 30) END AS area_m2,
         (4 + o_orderkey % 7) / 8.0::DOUBLE AS coverage_fraction,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 1.5::DOUBLE
              ELSE (o_totalprice % 997) / 997.0::DOUBLE END AS ndvi
  FROM orders),
gated AS (
  SELECT *, coverage_fraction * area_m2 / 900.0 AS pixel_weight_sum,
         CASE WHEN ndvi IS NULL THEN 'index null (every pixel masked)'
              WHEN ndvi < -1 OR ndvi > 1 THEN 'index outside -1.0 to 1.0'
              WHEN n_pixels < 4 THEN 'fewer than 4 pixels'
              WHEN coverage_fraction * area_m2 / 900.0 < 2 THEN 'effective pixels below 2.0'
              WHEN coverage_fraction < 0.6 THEN 'stand coverage below 0.60 (cloud, shadow or SLC gap)'
              WHEN area_m2 < 3600 THEN 'stand area below 3600 m2 for 30 m metrics' END AS cause
  FROM obs),
kept AS (SELECT * FROM gated WHERE cause IS NULL)"""


# Heights of stands: one pixel per line item, in the year of the order.
def stand_pixels(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    height = F.when(F.col("l_partkey") % 19 == 0, None).otherwise(pixel_height())
    return line.join(o, line["l_orderkey"] == o["o_orderkey"]).select(
        (F.col("o_custkey") % 100).cast("string").alias("stand_id"),
        F.year("o_orderdate").alias("year"),
        (F.col("l_orderkey") % 200).cast("int").alias("row"),
        (F.col("l_partkey") % 200).cast("int").alias("col"),
        height.alias("height"),
        (F.col("l_partkey") % 7).cast("int").alias("texture"),
    )


def pixel_height() -> Column:
    """Heights from 0 to 24.5 m in half metres."""
    return (F.col("l_quantity") - 1.0) / 2.0


PIXELS = """pixels AS (
  SELECT CAST(o_custkey % 100 AS VARCHAR) AS stand_id, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(l_orderkey % 200 AS INTEGER) AS row, CAST(l_partkey % 200 AS INTEGER) AS col,
         CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE (l_quantity - 1.0) / 2.0 END AS height
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# Dense grid: one row per vector, one column per element.
def grid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    cells = e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return cells.select("row", "col", F.col("value").cast("double").alias("value"))


GRID = """cells AS (
  SELECT CAST(vec_id AS INTEGER) AS row, CAST(i - 1 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) g)"""


def grid_years(spark: SparkSession, sf: str, shifts: tuple[int, ...] = (0, 7, 14)) -> DataFrame:
    """The dense grid at several dates; date ``t`` is the grid moved down by ``shifts[t]`` rows."""
    return (
        grid(spark, sf)
        .select("*", F.posexplode(F.array(*[F.lit(s) for s in shifts])).alias("t", "shift"))
        .select(F.lit("g").alias("unit"), "t", (F.col("row") + F.col("shift")).alias("row"), "col", "value")
    )


GRID_YEARS = GRID + """,
dated AS (
  SELECT 'g' AS unit, CAST(t AS INTEGER) AS t, CAST(row + 7 * t AS INTEGER) AS row, col, value
  FROM cells, (SELECT unnest(generate_series(0, 2)) AS t) s)"""


# Sparse cells of several years.
def sparse_cells(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    return (
        line.select(
            F.col("l_returnflag").alias("unit"),
            F.year("l_shipdate").alias("year"),
            (F.col("l_orderkey") % 64).cast("int").alias("row"),
            (F.col("l_partkey") % 64).cast("int").alias("col"),
            pixel_height().alias("h"),
            (F.col("l_tax") * 12).alias("p"),
        )
        .groupBy("unit", "year", "row", "col")
        .agg(
            F.avg("h").alias("chm_height"),
            F.avg(F.when(F.col("h") > 10.0, 1.0).otherwise(0.0)).alias("chm_cover"),
            F.max("p").alias("probability"),
            F.count(F.lit(1)).alias("n"),
        )
    )


SPARSE = """sparse AS (
  SELECT l_returnflag AS unit, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(l_orderkey % 64 AS INTEGER) AS row, CAST(l_partkey % 64 AS INTEGER) AS col,
         avg((l_quantity - 1.0) / 2.0) AS chm_height,
         avg(CASE WHEN (l_quantity - 1.0) / 2.0 > 10.0 THEN 1.0 ELSE 0.0 END) AS chm_cover,
         max(l_tax * 12) AS probability, count(*) AS n
  FROM lineitem GROUP BY ALL)"""
