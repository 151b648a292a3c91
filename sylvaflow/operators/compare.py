"""Comparison of detection runs on one grid: places, overlap, agreement, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow.functions.columns import share
from sylvaflow.functions.scalars import interval_label
from sylvaflow.operators.components import label_components
from sylvaflow.operators.ranks import exact_quantiles

CELL = ["unit", "row", "col"]


def comparability(runs: DataFrame) -> DataFrame:
    """Which of site, years and grid differ among the runs to compare."""
    d = lambda *c: F.countDistinct(F.struct(*c)) > 1
    agg = runs.agg(d("site").alias("s"), d("years").alias("y"), d("rows", "cols", "left", "top", "pixel_m").alias("g"))
    return agg.select(F.concat_ws(", ", F.when(F.col("s"), "site"), F.when(F.col("y"), "years"), F.when(F.col("g"), "grid")).alias("differs"))


def cell_flags(detected: DataFrame, runs: Sequence[str], *, dates: bool) -> DataFrame:
    """One row per cell (and date) with a flag per run; one shuffle on the cell."""
    keys = ["unit", "t", "row", "col"] if dates else CELL
    return detected.groupBy(*keys).agg(*[F.bool_or(F.col("run") == r).alias(r) for r in runs])


def overlap(detected: DataFrame, runs: Sequence[str], *, same_interval: bool) -> DataFrame:
    """Percent of a run's cells that another run has too, in the same interval or in any."""
    flags = cell_flags(detected, runs, dates=same_interval)
    n = lambda c: F.count(F.when(c, 1))
    pairs = [F.struct(F.lit(a).alias("run"), *[(100.0 * share(F.col(f"{a}|{b}"), F.col(f"{a}|{a}"))).alias(b) for b in runs]) for a in runs]
    counts = flags.agg(*[n(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a in runs for b in runs])
    return counts.select(F.inline(F.array(*pairs)))


def agreement_area(detected: DataFrame, n_runs: int, cell_ha: float) -> DataFrame:
    """Area and share of the union by the number of runs that detect a cell at least once."""
    per = detected.groupBy(*CELL).agg(F.countDistinct("run").alias("variants"))
    agg = per.groupBy("variants").agg(F.count(F.lit(1)).alias("n"))
    frame = detected.sparkSession.range(1, n_runs + 1).select(F.col("id").alias("variants"))
    out = frame.join(agg, "variants", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("variants", (F.col("n") * cell_ha).alias("area_ha"), F.try_divide(100.0 * F.col("n"), F.sum("n").over(W.partitionBy())).alias("share_of_union_pct"))


def objects_kept(base: DataFrame, other: DataFrame) -> DataFrame:
    """Baseline objects (labelled cells) with at least one cell detected by the other run at the date."""
    hit = base.join(other, ["unit", "t", "row", "col"], "left_semi").select("unit", "t", "label").distinct().withColumn("kept", F.lit(True))
    return base.select("unit", "t", "label").distinct().join(hit, ["unit", "t", "label"], "left").select("unit", "t", "label", F.coalesce("kept", F.lit(False)).alias("kept"))


def run_summary(detected: DataFrame, runs: Sequence[str], cell_ha: float) -> DataFrame:
    """Per run: objects, areas, event sizes, and what it keeps of the first run."""
    base = runs[0]
    lab = label_components(detected.select("run", "unit", "t", "row", "col"), ["run", "unit", "t"])
    obj = lab.groupBy("run", "unit", "t", "label").agg((F.count(F.lit(1)) * cell_ha).alias("ha"))
    size = obj.groupBy("run").agg(F.count(F.lit(1)).alias("objects"), F.avg("ha").alias("event_ha_mean"), F.max("ha").alias("event_ha_max"), F.sum("ha").alias("detections_ha"))
    q = exact_quantiles(obj, ["run"], "ha", {"event_ha_median": 0.5, "event_ha_p90": 0.9}, cell_ha)
    ever = cell_flags(detected, runs, dates=False)
    dated = cell_flags(detected, runs, dates=True)
    n = lambda c: F.count(F.when(c, 1))

    def long(flags: DataFrame, prefix: str) -> DataFrame:
        a = flags.agg(*[x for r in runs for x in (n(F.col(r)).alias(f"{r}_n"), n(F.col(r) & F.col(base)).alias(f"{r}_b"), n(F.col(r) | F.col(base)).alias(f"{r}_u"))])
        return a.select(F.inline(F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"{r}_n").alias(f"{prefix}n"), F.col(f"{r}_b").alias(f"{prefix}b"), F.col(f"{r}_u").alias(f"{prefix}u"), F.col(f"{base}_n").alias(f"{prefix}0")) for r in runs])))

    first = lab.where(F.col("run") == base)
    kept = first.select("unit", "t", "row", "col", "label").join(detected.select("run", "unit", "t", "row", "col"), ["unit", "t", "row", "col"]).groupBy("run").agg(F.countDistinct("unit", "t", "label").alias("kept"))
    total = first.agg(F.countDistinct("unit", "t", "label")).scalar()
    pct = lambda a, b: 100.0 * share(a, b)
    out = size.join(q, "run").join(long(ever, "e"), "run").join(long(dated, "d"), "run").join(kept, "run", "left")
    return out.select(
        "run", "objects", (F.col("en") * cell_ha).alias("detected_ha"), "detections_ha", "event_ha_mean", "event_ha_median", "event_ha_p90", "event_ha_max",
        pct(F.col("eb"), F.col("e0")).alias("baseline_area_kept_pct"), pct(F.col("db"), F.col("d0")).alias("baseline_area_kept_same_interval_pct"),
        pct(F.col("en") - F.col("eb"), F.col("en")).alias("area_outside_baseline_pct"), share(F.col("eb"), F.col("eu")).alias("jaccard_vs_baseline"), pct(F.coalesce("kept", F.lit(0)), total).alias("baseline_objects_kept_pct"),
    )


def union_places(detected: DataFrame, runs: Sequence[str], years: DataFrame, cell_ha: float) -> DataFrame:
    """Places of the union of all runs per interval: area, area per run at any and at the same
    date, main interval per run, and the stratum (all, some, baseline_only, not_baseline)."""
    base, n_runs = runs[0], len(runs)
    cells = detected.select("unit", "t", "row", "col").distinct()
    lab = label_components(cells)
    size = lab.groupBy("unit", "t", "label").agg((F.count(F.lit(1)) * cell_ha).alias("area_ha"))
    hits = lab.join(detected.select("run", "unit", F.col("t").alias("t1"), "row", "col"), CELL)
    key = ["unit", "t", "label"]
    per_date = hits.groupBy(*key, "run", "t1").agg(F.count(F.lit(1)).alias("n"))
    ever = hits.groupBy(*key, "run").agg(F.countDistinct("row", "col").alias("any"))
    main = per_date.groupBy(*key, "run").agg(F.max_by("t1", F.struct("n", -F.col("t1"))).alias("main"), F.max(F.when(F.col("t1") == F.col("t"), F.col("n"))).alias("same"))
    row = ever.join(main, [*key, "run"]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_variants"), F.bool_or(F.col("run") == base).alias("_b"),
        *[x for r in runs for x in (F.max(F.when(F.col("run") == r, F.col("any"))).alias(f"any_{r}"), F.max(F.when(F.col("run") == r, F.col("same"))).alias(f"same_{r}"), F.max(F.when(F.col("run") == r, F.col("main"))).alias(f"main_{r}"))],
    )
    b = F.col("_b")
    stratum = F.when(F.col("n_variants") == n_runs, "all").when(~b, "not_baseline").when(F.col("n_variants") == 1, "baseline_only").otherwise("some")
    named = years.withColumn("before", F.lag("year").over(W.partitionBy("unit").orderBy("t")))
    out = size.join(row, key).join(named, ["unit", "t"])
    number = F.row_number().over(W.partitionBy("unit").orderBy("t", F.col("area_ha").desc(), "label"))
    area = lambda c: F.coalesce(F.col(c), F.lit(0)) * cell_ha
    return out.select(
        *key, F.format_string("L%04d", number).alias("loc_id"), F.col("year").alias("onset_year"), interval_label(F.col("before"), F.col("year")).alias("interval"), "area_ha", "n_variants", stratum.alias("stratum"),
        *[x for r in runs for x in (area(f"any_{r}").alias(f"ha_{r}"), area(f"same_{r}").alias(f"same_ha_{r}"), F.col(f"main_{r}").alias(f"main_{r}"))],
    )


def stratum_table(places: DataFrame, base: str) -> DataFrame:
    """Places and area per stratum, with those the baseline has at another date too."""
    other = F.col(f"ha_{base}") > F.col(f"same_ha_{base}") + 1e-9
    return places.groupBy("stratum").agg(F.count(F.lit(1)).alias("places"), F.sum("area_ha").alias("union_ha"), F.count(F.when(other, 1)).alias("baseline_other_interval"))


def overlap_shapes(cells: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Percent of a run's outline pixels inside another run's outlines (union of shapes per run)."""
    return overlap(cells.select("run", *CELL).distinct(), runs, same_interval=False)
