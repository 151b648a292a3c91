"""Inspection sample of a run: kept objects, near misses under the minimum size, and cells never flagged.

Each stratum has its own frame, made by aggregations on cells; draws take the smallest
stable keys. Every row carries the size of its frame, its inclusion probability and the
weight that expands it, so that the three strata can be scored together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow.functions.columns import holds, random_key
from sylvaflow.functions.scalars import interval_label
from sylvaflow.operators.cells import CELL, DATE, dilate, square
from sylvaflow.operators.components import label_components
from sylvaflow.operators.samples import allocate, smallest_keys, take

#: Order of the strata, sizes per unit, and the least near miss as a share of the minimum size.
STRATA = ("detected", "below_mmu", "no_detection")
DESIGN = {"n_detected": 24, "n_below_mmu": 4, "n_no_detection": 0, "min_per_interval": 2, "seed": 0}
NEAR_MISS_SHARE = 0.5

COLUMNS = [
    "unit", "stratum", "object_id", "interval", "year_before", "onset_year", "n_cells", "area_ha", "mean_prob", "max_prob", "mean_z", "x", "y",
    "n_population", "incl_prob",
]


def rejected_cells(flags: DataFrame, kept: DataFrame) -> DataFrame:
    """Components of the cells that the rule flagged and the minimum size removed from every
    date: each cell counts at its first flagged date. Adds ``label``."""
    first = flags.groupBy(*CELL).agg(F.min("t").alias("t"))
    return label_components(first.join(kept.select(*CELL), CELL, "left_anti"), DATE)


def quiet_cells(cells: DataFrame, seed: int, *, clear: int = 0) -> DataFrame:
    """Cells monitored at some date and never flagged, with one of their monitored dates.

    ``cells`` has monitored, flag and z per date. With ``clear`` no cell within so many cells
    was ever flagged either. The date has the smallest key; ``n_dates`` is the number to
    choose from.
    """
    key = random_key(f"{seed}:date", F.concat_ws(":", *CELL, "t"))
    seen = holds(F.col("monitored") & (F.col("t") > 0))
    ever = cells.groupBy(*CELL).agg(
        F.bool_or(F.coalesce("flag", F.lit(False))).alias("_flag"), F.count(F.when(seen, 1)).alias("n_dates"),
        F.min_by(F.struct("t", "z"), F.when(seen, key)).alias("_pick"),
    )
    quiet = ever.where("NOT _flag AND n_dates > 0")
    if clear > 0:
        near = dilate(ever.where("_flag"), square(clear), ["unit"])
        quiet = quiet.join(near, CELL, "left_anti")
    return quiet.select(*CELL, "_pick.t", F.col("_pick.z").alias("mean_z"), "n_dates")


def _drawn(objects: DataFrame, stratum: str, n: int, least: int, seed: int) -> DataFrame:
    """Objects drawn per interval of a unit, with the share of their interval as inclusion probability."""
    keys = ["unit", "interval"]
    sizes = objects.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shares = allocate(sizes, n, least, stratum="interval", groups=["unit"])
    rows = objects.withColumn("key", random_key(f"{seed}:{stratum}", F.concat_ws(":", "unit", "onset_index", "label")))
    drawn = take(rows, shares, keys, n, tie=["onset_index", "label"])
    return drawn.join(shares.select(*keys, "share"), keys).withColumns({"incl_prob": F.col("share") / F.col("n_population"), "stratum": F.lit(stratum)})


def inspection_sample(objects: DataFrame, rejected: DataFrame, quiet: DataFrame, years: DataFrame, *, mmu_ha: float, cell_m: float, design: Mapping = DESIGN) -> DataFrame:
    """Sample of all three strata, numbered per unit in table order (stratum, onset, object).

    ``objects`` and ``rejected`` come from ``detection_objects`` (kept ones, and those of the
    rejected cells); a near miss has at least half of the minimum size and no object number.
    A never flagged cell is drawn with one of its monitored dates, so its probability is that
    of the cell over the number of dates. ``follow_up``: the unit has a later date.
    """
    seed = design["seed"]
    parts: Sequence[DataFrame] = [_drawn(objects, STRATA[0], design["n_detected"], design["min_per_interval"], seed)]
    if design["n_below_mmu"] > 0:
        near = rejected.where(F.col("area_ha") >= NEAR_MISS_SHARE * mmu_ha)
        parts = [*parts, _drawn(near, STRATA[1], design["n_below_mmu"], 1, seed).withColumn("object_id", F.lit(None).cast("bigint"))]
    if design["n_no_detection"] > 0:
        parts = [*parts, _drawn_cells(quiet, years, design["n_no_detection"], seed, cell_m)]
    out = parts[0].select(*COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*COLUMNS))
    last = years.groupBy("unit").agg(F.max("year").alias("_last"))
    rank = F.array_position(F.array(*[F.lit(s) for s in STRATA]), F.col("stratum"))
    number = F.row_number().over(W.partitionBy("unit").orderBy(rank, "onset_year", "object_id", "y", "x"))
    return out.join(last, "unit").select(
        F.format_string("S%02d", number).alias("sample_id"), *COLUMNS, (1.0 / F.col("incl_prob")).alias("weight"), (F.col("onset_year") < F.col("_last")).alias("follow_up"),
    )


def _drawn_cells(quiet: DataFrame, years: DataFrame, n: int, seed: int, cell_m: float) -> DataFrame:
    size = quiet.groupBy("unit").agg(F.count(F.lit(1)).alias("n_population"))
    rows = quiet.withColumn("key", random_key(f"{seed}:{STRATA[2]}", F.concat_ws(":", *CELL)))
    drawn = smallest_keys(rows, ["unit"], n, tie=["row", "col"]).join(size, "unit")
    named = years.withColumn("year_before", F.lag("year").over(W.partitionBy("unit").orderBy("t")))
    none = lambda kind: F.lit(None).cast(kind)
    chosen = F.least(F.lit(n), F.col("n_population"))
    return drawn.join(named, DATE).select(
        "unit", F.lit(STRATA[2]).alias("stratum"), none("bigint").alias("object_id"), interval_label(F.col("year_before"), F.col("year")).alias("interval"),
        "year_before", F.col("year").alias("onset_year"), F.lit(1).cast("bigint").alias("n_cells"), F.lit(cell_m * cell_m / 1e4).alias("area_ha"),
        none("double").alias("mean_prob"), none("double").alias("max_prob"), "mean_z", ((F.col("col") + 0.5) * cell_m).alias("x"), (-(F.col("row") + 0.5) * cell_m).alias("y"),
        "n_population", (chosen / F.col("n_population") / F.col("n_dates")).alias("incl_prob"),
    )
