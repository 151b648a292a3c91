"""Summaries of a detection run and checks of its consistency as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import share
from sylvaflow.functions.scalars import interval_label
from sylvaflow.operators.cells import CELL, DATE
from sylvaflow.operators.ranks import exact_quantiles


def interval_summary(cells: DataFrame, objects: DataFrame, fits: DataFrame, years: DataFrame, cell_ha: float) -> DataFrame:
    """Per interval: monitored, flagged, detected and repeat area, share, objects, growth area, fit.

    ``cells``: unit, t, row, col, monitored, flag, detected; the first date has no interval.
    """
    first = F.min(F.when(F.col("detected"), F.col("t"))).over(W.partitionBy(*CELL))
    rows = cells.withColumn("_first", first)
    n = lambda c: F.count(F.when(c, 1))
    agg = rows.groupBy(*DATE).agg(
        (n(F.col("monitored")) * cell_ha).alias("monitored_ha"), (n(F.col("detected")) * cell_ha).alias("detected_ha"), (n(F.col("flag")) * cell_ha).alias("detected_ha_nommu"),
        (n(F.col("detected") & (F.col("_first") < F.col("t"))) * cell_ha).alias("repeat_ha"),
    )
    obj = objects.groupBy("unit", F.col("onset_index").alias("t")).agg(F.count(F.lit(1)).alias("n_objects"), F.sum(F.when(F.col("growth"), F.col("area_ha")).otherwise(0.0)).alias("growth_ha"))
    named = years.withColumn("before", F.lag("year").over(W.partitionBy("unit").orderBy("t"))).where("before IS NOT NULL")
    out = named.join(agg, DATE, "left").join(obj, DATE, "left").join(fits.select(*DATE, "mu0", "sigma0", "p0", "method", "skipped"), DATE, "left")
    return out.select(
        "unit", "t", "year", interval_label(F.col("before"), F.col("year")).alias("interval"), "monitored_ha", "detected_ha", "detected_ha_nommu", "repeat_ha",
        F.coalesce(share(F.col("detected_ha"), F.col("monitored_ha")), F.lit(0.0)).alias("share_of_monitored"), F.coalesce("n_objects", F.lit(0)).alias("n_objects"), F.coalesce("growth_ha", F.lit(0.0)).alias("growth_ha"),
        "mu0", "sigma0", "p0", "method", "skipped",
    )


def run_totals(cells: DataFrame, objects: DataFrame, cell_ha: float) -> DataFrame:
    """Per unit: area detected at least once, objects, and those without a later image."""
    ever = cells.where("detected").select(*CELL).distinct().groupBy("unit").agg((F.count(F.lit(1)) * cell_ha).alias("ever_detected_ha"))
    late = ~F.col("follow_up")
    obj = objects.groupBy("unit").agg(F.count(F.lit(1)).alias("n_objects"), F.sum("area_ha").alias("detected_ha"), F.count(F.when(late, 1)).alias("no_follow_up"), F.sum(F.when(late, F.col("area_ha")).otherwise(0.0)).alias("no_follow_up_ha"))
    return obj.join(ever, "unit", "left")


def forest_area(cells: DataFrame, cell_ha: float) -> DataFrame:
    return cells.groupBy(*DATE).agg((F.count(F.when(F.col("forest"), 1)) * cell_ha).alias("forest_ha"), (F.count(F.lit(1)) * cell_ha).alias("area_ha"))


def _row(df: DataFrame, check: str, bad, detail) -> DataFrame:
    level = "FAIL" if check in ("onset raster", "vectors", "metadata") else "WARN"
    return df.select("unit", F.lit(check).alias("check"), F.when(bad, level).otherwise("PASS").alias("level"), detail.alias("detail"))


def check_run(summary: DataFrame, totals: DataFrame, onset: DataFrame, objects: DataFrame, forest: DataFrame, heights: DataFrame, images: DataFrame, cell_ha: float, *, sigma_range: tuple[float, float] = (0.8, 1.2), height_tol: float = 0.5, season_gap: int = P.SEASON_GAP_DAYS) -> DataFrame:
    """One row per unit and check with level and detail, each an aggregate comparison.

    Onset areas and the ever-detected area against the summary (within one cell), objects
    against summary and totals, year lists, forest swings, height medians off the centre,
    null fits in range, season gaps, several images in one year.
    """
    text = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "; ")
    got = onset.where("onset_year > 0").groupBy("unit", F.col("onset_year").alias("year")).agg((F.count(F.lit(1)) * cell_ha).alias("map_ha"))
    want = summary.where(~F.coalesce("skipped", F.lit(False))).select("unit", "year", "interval", (F.col("detected_ha") - F.col("repeat_ha")).alias("want"))
    diff = want.join(got, ["unit", "year"], "left").withColumn("map_ha", F.coalesce("map_ha", F.lit(0.0)))
    off = F.abs(F.col("map_ha") - F.col("want")) > cell_ha + 1e-6
    o = diff.groupBy("unit").agg(text(F.when(off, F.format_string("%s map %.2f ha, summary %.2f ha", "interval", "map_ha", "want"))).alias("d"))
    ever = onset.where("onset_year > 0").groupBy("unit").agg((F.count(F.lit(1)) * cell_ha).alias("e")).join(totals, "unit")
    o = o.join(ever, "unit", "left").withColumn("d", F.concat_ws("; ", F.nullif("d", F.lit("")), F.when(F.abs(F.col("e") - F.col("ever_detected_ha")) > cell_ha, "ever detected differs")))
    checks = [_row(o, "onset raster", F.col("d") != "", F.col("d"))]
    n = objects.groupBy("unit", F.col("interval")).agg(F.sum("area_ha").alias("a"), F.count(F.lit(1)).alias("k"))
    v = summary.join(n, ["unit", "interval"], "left").withColumns({"a": F.coalesce("a", F.lit(0.0)), "k": F.coalesce("k", F.lit(0))})
    wrong = (F.abs(F.col("a") - F.col("detected_ha")) > 1e-3) | (F.col("k") != F.col("n_objects"))
    v = v.groupBy("unit").agg(text(F.when(wrong, F.format_string("%s objects %.2f ha, summary %.2f ha", "interval", "a", "detected_ha"))).alias("d"))
    checks.append(_row(v, "vectors", F.col("d") != "", F.col("d")))
    years = lambda df, name: df.select("unit", "year").distinct().groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list(F.col("year").cast("int"))), ",").alias(name))
    m = years(forest, "a").join(years(images, "b"), "unit", "full")
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    checks.append(_row(m, "metadata", ~same, F.when(same, F.lit("")).otherwise(F.concat_ws(" / ", F.coalesce("a", F.lit("-")), F.coalesce("b", F.lit("-"))))))
    f = forest.withColumn("swing", F.col("forest_ha") - F.lag("forest_ha").over(W.partitionBy("unit").orderBy("year")))
    f = f.groupBy("unit").agg(F.max(F.abs("swing")).alias("s")).join(totals, "unit", "left")
    big = F.coalesce(F.col("s") > F.col("detected_ha"), F.lit(False))
    checks.append(_row(f, "forest stability", big, F.format_string("largest swing %.2f ha", "s")))
    med = exact_quantiles(heights, ["unit", "year"], "height", {"m": 0.5}, 0.25)
    centre = exact_quantiles(med, ["unit"], "m", {"c": 0.5}, 0.25)
    h = med.join(centre, "unit").groupBy("unit").agg(text(F.when(F.abs(F.col("m") - F.col("c")) > height_tol, F.format_string("%d %+.2f", F.col("year").cast("int"), F.col("m") - F.col("c")))).alias("d"))
    checks.append(_row(h, "height level", F.col("d") != "", F.col("d")))
    lo, hi = sigma_range
    bad = F.when(F.col("skipped"), F.concat("interval", F.lit(" skipped"))).when(~F.col("sigma0").between(lo, hi), F.format_string("%s sigma0 %.2f", "interval", "sigma0"))
    s = summary.groupBy("unit").agg(text(bad).alias("d"))
    checks.append(_row(s, "null fits", F.col("d") != "", F.col("d")))
    per = images.groupBy("unit", "year").agg(F.min("date").alias("date"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("unit").orderBy("year")
    g = per.withColumns({"y0": F.lag("year").over(w), "gap": F.abs(F.dayofyear("date") - F.dayofyear(F.lag("date").over(w)))})
    g = g.groupBy("unit").agg(text(F.when(F.col("gap") > season_gap, F.format_string("%d-%d %d d", F.col("y0").cast("int"), F.col("year").cast("int"), F.col("gap").cast("int")))).alias("d"), text(F.when(F.col("n") > 1, F.col("year").cast("string"))).alias("several"))
    checks += [_row(g, "season gaps", F.col("d") != "", F.col("d")), _row(g, "inputs", F.col("several") != "", F.col("several"))]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
