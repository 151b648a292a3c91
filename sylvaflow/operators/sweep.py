"""Areas of unions and intersections of shapes by a relational sweep, without a geometry library.

The plane is cut into bands of rows. Inside a band the corners of the shapes and the
crossings of their edges are the breakpoints: between two of them no edge begins, ends or
meets another, so the crossings with the middle line, in order, bound trapezoids whose
area is width times height. A running count per run of how many of its shapes cover a
trapezoid says what it belongs to, so shapes that overlap count once.

Bands are keys, so a unit is spread over as many tasks as it has bands; edges meet only
edges of the same tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow.functions.columns import share
from sylvaflow.session import cut_lineage

#: Slices of edges that a task gets, so that a task is as large at any size.
SLICES_A_TASK = 250_000
BAND = ["unit", "_band"]


def shape_edges(shapes: DataFrame) -> DataFrame:
    """Edges that are not level, upward (``y0 < y1``), of rings of ``struct(x, y)`` (closing edge implied)."""
    n = F.size("vertices")
    at = shapes.select("unit", "run", "shape", "vertices", n.alias("_n"), F.posexplode("vertices").alias("_i", "_a"))
    b = F.get("vertices", (F.col("_i") + 1) % F.col("_n"))
    e = at.select("unit", "run", "shape", F.col("_a.x").cast("double").alias("ax"), F.col("_a.y").cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by")).where("ay <> by")
    up = F.col("ay") < F.col("by")
    pick = lambda p, q: F.when(up, F.col(p)).otherwise(F.col(q))
    return e.select("unit", "run", "shape", pick("ax", "bx").alias("x0"), pick("ay", "by").alias("y0"), pick("bx", "ax").alias("x1"), pick("by", "ay").alias("y1"))


def _x_at(y: Column) -> Column:
    return F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))


def banded(edges: DataFrame, band: float) -> DataFrame:
    """Edges cut at the borders of the bands they cross, with ``_lo`` and ``_hi`` inside the band."""
    rows = edges.select("*", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))).alias("_band"))
    out = rows.withColumns({"_lo": F.greatest(F.col("y0"), F.col("_band") * band), "_hi": F.least(F.col("y1"), (F.col("_band") + 1) * band)})
    return out.where("_lo < _hi")


def crossings(rows: DataFrame, tile: float) -> DataFrame:
    """Heights at which two edges of a band cross strictly inside both; edges meet by tile of their width."""
    a, b = _x_at(F.col("_lo")), _x_at(F.col("_hi"))
    wide = rows.withColumns({"_a": a, "_z": b})
    tiles = F.sequence(F.floor(F.least("_a", "_z") / tile), F.floor(F.greatest("_a", "_z") / tile))
    left = wide.select(*BAND, "_lo", "_hi", "_a", "_z", F.explode(tiles).alias("_tile"))
    right = left.select(*BAND, "_tile", *[F.col(c).alias(f"{c}2") for c in ("_lo", "_hi", "_a", "_z")])
    both = left.join(right, [*BAND, "_tile"]).where("_lo < _hi2 AND _lo2 < _hi")
    # as x = a + s (y - lo): the height where both lines have the same x
    s1 = (F.col("_z") - F.col("_a")) / (F.col("_hi") - F.col("_lo"))
    s2 = (F.col("_z2") - F.col("_a2")) / (F.col("_hi2") - F.col("_lo2"))
    y = F.try_divide((F.col("_a2") - s2 * F.col("_lo2")) - (F.col("_a") - s1 * F.col("_lo")), s1 - s2)
    inside = both.select(*BAND, y.alias("y"), F.greatest("_lo", "_lo2").alias("_l"), F.least("_hi", "_hi2").alias("_h"))
    return inside.where("y > _l AND y < _h").select(*BAND, "y").distinct()


def covered_parts(shapes: DataFrame, runs: Sequence[str], *, band: float, tile: float) -> DataFrame:
    """Trapezoids that at least one run covers: ``unit``, ``area`` and a flag per run.

    ``shapes``: unit, run, shape, vertices. Several rings of a shape are taken together by the
    even-odd rule (holes, parts); shapes of a run are joined.
    """
    rows = cut_lineage(banded(shape_edges(shapes), band))
    begin, end = F.struct(F.col("_lo").alias("y"), F.lit(1).alias("_more")), F.struct(F.col("_hi").alias("y"), F.lit(-1).alias("_more"))
    ends = rows.select(*BAND, F.inline(F.array(begin, end)))
    cuts = ends.unionByName(crossings(rows, tile).withColumn("_more", F.lit(0))).groupBy(*BAND, "y").agg(F.sum("_more").alias("_more"))
    line = W.partitionBy(*BAND).orderBy("y")
    cuts = cut_lineage(cuts.withColumns({"_k": F.row_number().over(line), "_next": F.lead("y").over(line), "_edges": F.sum("_more").over(line)}).drop("_more"))
    # a slice per edge and breakpoint it spans: many more than edges, so tasks are counted by slices
    count = cuts.agg(F.sum("_edges")).first()[0] or 0
    tasks = max(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // SLICES_A_TASK + 1)
    at = lambda end, name: cuts.select(*BAND, F.col("y").alias(end), F.col("_k").alias(name))
    spans = rows.join(at("_lo", "_from"), [*BAND, "_lo"]).join(at("_hi", "_to"), [*BAND, "_hi"])
    spans = spans.select(*BAND, "run", "shape", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("_k"))
    key = [*BAND, "_k"]
    slices = spans.repartition(tasks, *key).join(cuts.select(*key, "y", "_next").repartition(tasks, *key), key)
    mid = (F.col("y") + F.col("_next")) / 2.0
    slices = slices.select(*key, "run", "shape", _x_at(mid).alias("x"), (F.col("_next") - F.col("y")).alias("_height"))
    # a line enters a shape at its odd crossings and leaves it at the even ones
    turn = F.row_number().over(W.partitionBy(*key, "run", "shape").orderBy("x"))
    signed = slices.select(*key, "run", "x", "_height", F.when(turn % 2 == 1, 1).otherwise(-1).alias("_step"))
    # lines at the same x are peers: all count before the width, which only the last of them has
    over = W.partitionBy(*key).orderBy("x")
    counted = signed.withColumns({"_width": F.lead("x").over(over) - F.col("x"), **{r: F.sum(F.when(F.col("run") == r, F.col("_step")).otherwise(0)).over(over) > 0 for r in runs}})
    some = F.lit(False)
    for r in runs:
        some = some | F.col(r)
    return counted.where(some & (F.col("_width") > 0)).select("unit", (F.col("_width") * F.col("_height")).alias("area"), *runs)


def union_areas(shapes: DataFrame, runs: Sequence[str], *, band: float, tile: float) -> DataFrame:
    """Per run the area of the union of its shapes, and the area it shares with every other run's union."""
    parts = covered_parts(shapes, runs, band=band, tile=tile)
    both = lambda a, b: F.coalesce(F.sum(F.when(F.col(a) & F.col(b), F.col("area"))), F.lit(0.0))
    agg = parts.agg(*[both(a, b).alias(f"{a}|{b}") for a in runs for b in runs])
    lines = [F.struct(F.lit(a).alias("run"), F.col(f"{a}|{a}").alias("area"), *[F.col(f"{a}|{b}").alias(f"in_{b}") for b in runs]) for a in runs]
    return agg.select(F.inline(F.array(*lines)))


def union_overlap(shapes: DataFrame, runs: Sequence[str], *, band: float, tile: float) -> DataFrame:
    """Percent of a run's union that lies inside another run's union."""
    areas = union_areas(shapes, runs, band=band, tile=tile)
    return areas.select("run", "area", *[(100.0 * share(F.col(f"in_{b}"), F.col("area"))).alias(b) for b in runs])
