"""Stands, stacks, detections, batches, inventories, review labels: readers and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import lookup
from sylvaflow.functions.scalars import acquisition_date, disturbance_group, place_code
from sylvaflow.operators.samples import lettered_ids
from sylvaflow.operators.spatial import with_box
from sylvaflow.operators.verdicts import latest_by


# --- stands -----------------------------------------------------------------------------
def ring_area(vertices: Column) -> Column:
    """Area of a ring of vertices (shoelace)."""
    n = F.size(vertices)
    term = lambda i: F.get(vertices, i)["x"] * F.get(vertices, (i + 1) % n)["y"] - F.get(vertices, (i + 1) % n)["x"] * F.get(vertices, i)["y"]
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + term(i))) / 2.0


def read_stands(delivered: DataFrame, labels: Mapping[int, str], *, drop_non_disturbance: bool = True) -> DataFrame:
    """Delivered polygons to decoded stands: label, group, area, box fill and a unique ID.

    Columns doqq, uid1, uid2, uid3, dist_type, vertices.
    """
    df = delivered.where(F.col("dist_type") != P.NON_DISTURBANCE) if drop_non_disturbance else delivered
    base = F.concat(place_code(F.col("doqq")), F.lit("-U"), F.concat_ws("-", "uid1", "uid2", "uid3"))
    df = with_box(df).withColumns({"base_id": base, "area_m2": ring_area(F.col("vertices"))})
    box = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    df = df.withColumns({
        "dist_label": lookup("dist_type", dict(labels), "Unknown"), "dist_group": disturbance_group(F.col("dist_type")),
        "bbox_fill": F.when(box > 0, F.col("area_m2") / box),
    })
    return lettered_ids(df, "base_id", F.col("area_m2").desc(), ["uid1", "uid2", "uid3"]).drop("minx", "maxx", "miny", "maxy", "base_id")


# --- stacks -------------------------------------------------------------------------------
def stack_years(layers: Mapping[int, DataFrame], cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """Yearly layers in order as one long table; a layer with another set of cells is refused."""
    cell, out = list(cell), None
    for t, (year, df) in enumerate(sorted(layers.items())):
        one = df.select(*cell, *[c for c in df.columns if c not in cell], F.lit(year).alias("year"), F.lit(t).alias("t"))
        out = one if out is None else out.unionByName(one)
    n = len(layers)
    per = out.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    same = F.when(F.col("_n") == n, F.lit(True)).otherwise(F.raise_error(F.lit("the yearly layers do not share a grid")).cast("boolean"))
    return out.join(per.where(same).select(*cell), cell)


def write_metric_stack(metrics: Mapping[str, DataFrame], path: str) -> None:
    """Metric layers as one long table partitioned by metric."""
    out = None
    for name, df in metrics.items():
        one = df.select("row", "col", F.col("value").cast("double").alias("value"), F.lit(name).alias("metric"))
        out = one if out is None else out.unionByName(one)
    out.write.mode("overwrite").partitionBy("metric").parquet(path)


def read_metric_stack(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Named layers of a stack; only their partitions are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("metric").isin(list(names))) if names is not None else df


def write_year_stack(stack: DataFrame, path: str) -> None:
    stack.write.mode("overwrite").partitionBy("unit", "year").parquet(path)


def read_year_stack(spark: SparkSession, path: str, unit: str | None = None, years: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(F.col("unit") == unit) if unit is not None else df
    return df.where(F.col("year").isin(list(years))) if years is not None else df


def write_detection(path: str, cells: DataFrame, objects: DataFrame, object_cells: DataFrame) -> None:
    """Cells, objects and object cells of a detection, each partitioned by unit."""
    for name, df in (("cells", cells), ("objects", objects), ("object_cells", object_cells)):
        df.write.mode("overwrite").partitionBy("unit").parquet(f"{path}/{name}")


def read_detection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("cells", "objects", "object_cells"))


# --- batches, inventories, catalogue ----------------------------------------------------------
UNIT_FIELDS = "unit_id string, label string, lon double, lat double, buffer_km double, years string"


def read_batch(spark: SparkSession, path: str, *, default_buffer_km: float = 3.0) -> DataFrame:
    """Units to process from a CSV with comments: defaults filled, a repeated unit refused."""
    df = spark.read.csv(path, header=True, comment="#", schema=UNIT_FIELDS, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    df = df.where(F.coalesce(F.col("unit_id"), F.lit("")) != "")
    return checked_batch(df, default_buffer_km)


def checked_batch(units: DataFrame, default_buffer_km: float) -> DataFrame:
    point = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    n = units.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_n"))
    once = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unit listed twice: "), "unit_id")).cast("boolean"))
    return units.join(n, "unit_id").where(once).drop("_n").withColumns({
        "kind": F.when(point, "point").otherwise("cell"), "label": F.coalesce("label", F.lit("")), "buffer_km": F.when(point, F.coalesce("buffer_km", F.lit(default_buffer_km))),
    })


def input_inventory(files: DataFrame) -> DataFrame:
    """Image files with kind, year, acquisition date and scale from their paths and types.

    ``files``: path, dtype, scale (may be null); the year is the name of the folder.
    """
    year = F.regexp_extract("path", r"/(\d{4})/[^/]+$", 1).try_cast("int")
    kind = F.when(F.col("path").contains("/naip/"), "naip").otherwise("chm")
    scale = F.when(kind == "naip", 1.0).otherwise(F.coalesce("scale", F.when(F.col("dtype").rlike("^u?int"), 0.01).otherwise(1.0)))
    return files.withColumns({"year": year, "kind": kind, "acquired": acquisition_date(F.col("path")), "scale": scale}).where(F.col("year").isNotNull())


def inventory_years(inventory: DataFrame, kinds: Sequence[str] = ("chm",)) -> DataFrame:
    """Years with a file of every kind, with the number of files and the earliest date."""
    have = F.array_contains(F.collect_set("kind"), kinds[0])
    for k in kinds[1:]:
        have = have & F.array_contains(F.collect_set("kind"), k)
    agg = inventory.groupBy("year").agg(F.count(F.lit(1)).alias("n_files"), F.min("acquired").alias("acquired"), have.alias("_ok"))
    return agg.where("_ok").drop("_ok")


def list_runs(catalogue: DataFrame, run_tag: str, files: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Runs of a tag that hold all needed files."""
    have = files.where(F.col("file").isin(list(needed))).groupBy("run_tag", "unit").agg(F.countDistinct("file").alias("_n"))
    return catalogue.where(F.col("run_tag") == run_tag).join(have.where(F.col("_n") == len(set(needed))).drop("_n"), ["run_tag", "unit"])


# --- review labels ------------------------------------------------------------------------------
def save_labels(log: DataFrame, sample: DataFrame) -> DataFrame:
    """Label in force per sample from the log (the last line wins); an unknown sample is refused."""
    last = latest_by(log, ["sample_id"], ["saved_at", "line"])
    known = sample.select("sample_id", F.lit(True).alias("_known"))
    ok = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("sample_id").cast("string"), F.lit(" is not in the sample"))).cast("boolean"))
    return last.join(known, "sample_id", "left").where(ok).drop("_known")


def review_progress(sample: DataFrame, labels: DataFrame) -> DataFrame:
    """Reviewed and total samples per unit."""
    done = sample.join(labels.select("sample_id", F.lit(1).alias("_d")), "sample_id", "left")
    return done.groupBy("unit").agg(F.count("_d").alias("done"), F.count(F.lit(1)).alias("total"))


def next_open(sample: DataFrame, labels: DataFrame, after: DataFrame) -> DataFrame:
    """Next sample without a label after a given one of its unit, wrapping around.

    ``sample``: sample_id, unit, order; ``after``: unit, order.
    """
    left = sample.join(labels.select("sample_id"), "sample_id", "left_anti").join(after.select("unit", F.col("order").alias("_from")), "unit")
    turn = F.struct((F.col("order") <= F.col("_from")).alias("w"), F.col("order"))
    return left.groupBy("unit").agg(F.min_by("sample_id", turn).alias("sample_id"))


def ordered_records(frame: DataFrame, key: str) -> DataFrame:
    """Dates, stages and metrics of a stand in year order as one array (dates are few)."""
    rest = [c for c in frame.columns if c not in (key, "year")]
    return frame.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("year", *rest))).alias("sequence"))


