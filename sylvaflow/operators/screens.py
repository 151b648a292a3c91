"""Screens, plans and small table builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import finite, holds
from sylvaflow.functions.scalars import cover_bounds, interval_label, off_season, sensor_table
from sylvaflow.operators.ranks import ordered_counts


def collection(scenes: DataFrame, start: str, end: str, sensors: Sequence[str], *, max_cloud: float = 80.0) -> DataFrame:
    """Scenes of the sensors that overlap a period, below a cloud share, in time order per month."""
    first, last = int(start[:4]), int(end[:4]) - (1 if end[5:] == "01-01" else 0)
    spec = sensor_table(scenes.sparkSession).where(F.col("sensor").isin(list(sensors)))
    spec = spec.where((F.col("first_year") <= last) & (F.col("last_year").isNull() | (F.col("last_year") >= first)))
    time = F.col("time")
    use = scenes.where((time >= F.lit(start).cast("timestamp")) & (time < F.lit(end).cast("timestamp")) & (F.col("cloud") < max_cloud))
    use = use.join(F.broadcast(spec.select("sensor")), "sensor", "left_semi")
    order = W.partitionBy(F.date_format("time", "yyyy-MM")).orderBy("time", "scene")
    return use.withColumn("position", F.row_number().over(order))


def season_gaps(images: DataFrame, keys: Sequence[str], *, max_days: int = P.SEASON_GAP_DAYS) -> DataFrame:
    """Consecutive years whose earliest images lie further apart in the season than ``max_days``."""
    first = images.groupBy(*keys, "year").agg(F.min("date").alias("date"))
    w = W.partitionBy(*keys).orderBy("year")
    pairs = first.select(*keys, "year", "date", F.lag("year").over(w).alias("y0"), F.lag("date").over(w).alias("d0"))
    gap = F.abs(F.dayofyear("date") - F.dayofyear("d0"))
    return pairs.where(gap > max_days).select(
        *keys, interval_label(F.col("y0"), F.col("year")).alias("interval"), gap.alias("gap_days"),
        off_season(F.date_format("date", "yyyy-MM-dd")).alias("off_season"),
    )


def cover_series(stands: DataFrame, fields: Sequence[tuple]) -> DataFrame:
    """Wide stand rows to one row per dated cover class; ``fields`` are (name, year, class)."""
    items = F.array(*[F.struct(F.lit(w).alias("which"), F.col(y).alias("y"), F.col(t).alias("tree_class")) for w, y, t in fields])
    rows = stands.select("stand_id", F.inline(items))
    lo, hi, mid = cover_bounds(F.col("tree_class"))
    return rows.select(
        "stand_id", "which", F.when(F.col("y") != P.YEAR_NOT_APPLICABLE, F.col("y")).alias("year"), "tree_class",
        lo.alias("tree_lo"), hi.alias("tree_hi"), mid.alias("tree_mid"),
    )


def stack_variables(layers: Mapping[str, DataFrame], required: Mapping[str, str], cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """Cell layers side by side; a missing layer is 0 for codes and null for numbers."""
    cell, out = list(cell), None
    for name in required:
        if name in layers:
            one = layers[name].select(*cell, F.col("value").alias(name))
            out = one if out is None else out.join(one, cell, "full")
    if out is None:
        raise ValueError("No layer given")
    blank = {"code": F.lit(0), "number": F.lit(None).cast("double")}
    return out.select(*cell, *[F.col(n) if n in layers else blank[kind].alias(n) for n, kind in required.items()])


def screen_stands(stands: DataFrame, years: Column, *, min_post_dates: int, min_acres: float, require: Sequence[str] = ("has_pre_date", "enough_post_dates", "large_enough", "complete_footprint", "single_event")) -> DataFrame:
    """Five checks of a stand against the image dates, with the names of the failed ones."""
    out = stands.withColumns({
        "acres": F.col("area_m2") / P.ACRE_M2, "_years": years,
    }).withColumns({
        "n_pre": F.size(F.filter("_years", lambda y: y <= F.col("last_pre"))),
        "n_post": F.size(F.filter("_years", lambda y: y >= F.col("first_post"))),
    })
    checks = {
        "has_pre_date": F.col("n_pre") >= 1, "enough_post_dates": F.col("n_post") >= min_post_dates,
        "large_enough": F.col("acres") >= min_acres, "complete_footprint": holds(F.col("complete")), "single_event": holds(F.col("single")),
    }
    fails = F.concat_ws("; ", *[F.when(~holds(c), n) for n, c in checks.items() if n in require])
    return out.withColumns(checks).withColumns({"fails": fails, "passes": fails == ""}).drop("_years")


def plan_years(first: DataFrame, second: DataFrame, *, min_coverage: float) -> DataFrame:
    """The first source with enough coverage per year, else the second, else the reason to skip the year."""
    both = first.select("year", F.col("coverage").alias("a")).join(second.select("year", F.col("coverage").alias("b")), "year", "full")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    source = F.when(a >= min_coverage, "first").when(b >= min_coverage, "second")
    best = F.greatest(a, b)
    text = F.format_string(f"covers %.0f%% of the box (< {min_coverage * 100:.0f}%%)", best * 100)
    return both.select("year", source.alias("source"), F.when(source == "first", a).when(source == "second", b).alias("coverage"), F.when(source.isNull(), text).alias("skipped"))


def decision_filters(summary: DataFrame, filters: Mapping[str, tuple[float, float]], rank_on: str, *, width: float | None = None) -> DataFrame:
    """A fail flag per hard filter; the rank (ties share the smallest) only among survivors, nulls last."""
    fails = {f"fail_{c}": ~holds(finite(c).between(lo, hi)) for c, (lo, hi) in filters.items() if c in summary.columns}
    out = summary.withColumns(fails)
    passes = F.lit(True)
    for name in fails:
        passes = passes & ~F.col(name)
    out = out.withColumn("passes", passes)
    ranked = ordered_counts(out.where("passes"), [], rank_on, width).select(rank_on, (F.col("n_below") + 1).alias("_rank"), "n_total")
    after = F.coalesce(out.where("passes").agg(F.count(rank_on)).scalar(), F.lit(0)) + 1
    out = out.join(ranked, rank_on, "left")
    rank = F.when(F.col("passes"), F.coalesce(F.col("_rank"), after))
    return out.withColumn("rank", rank).drop("_rank", "n_total")
