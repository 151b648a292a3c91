"""Several metrics of fixed windows in one call: heights, texture, edges, lines and crowns, for several sizes at once.

One tiling gives every pixel its window of every size; all metrics group by that window,
and the result has a row for every whole window of the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import finite, holds
from sylvaflow.operators import cells as K
from sylvaflow.operators.zones import crown_stats, pixel_aggregates, window_pixels

#: Key of a window. The size is a number: Spark groups doubles by a normalized value, which rows dealt by the double itself don't fit.
ZONE = ["_size", "wr", "wc"]
METRICS = ("heights", "texture", "edges", "lines", "crowns")


def numbered_sizes(sizes_m: Sequence[float], pixel_m: float) -> list[tuple[int, float, int]]:
    """Number, metres and pixels of every size; equal sizes have one number."""
    metres = [float(s) for s in sizes_m]
    return [(metres.index(m), m, window_pixels(s, pixel_m)) for s, m in zip(sizes_m, metres)]


def window_frame(spark, sizes_m: Sequence[float], pixel_m: float, rows: int, cols: int) -> DataFrame:
    """Whole windows of every size on a grid of ``rows`` x ``cols`` pixels."""
    sizes = spark.createDataFrame(numbered_sizes(sizes_m, pixel_m), "_size int, window_m double, px int")
    nr, nc = F.floor(F.lit(rows) / F.col("px")).cast("int"), F.floor(F.lit(cols) / F.col("px")).cast("int")
    whole = sizes.where((nr > 0) & (nc > 0))
    return whole.select("_size", "window_m", "px", F.explode(F.sequence(F.lit(0), nr - 1)).alias("wr"), nc.alias("_nc")).select("_size", "window_m", "px", "wr", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("wc"))


def tiled(pixels: DataFrame, sizes_m: Sequence[float], pixel_m: float, rows: int, cols: int) -> DataFrame:
    """Every pixel with its whole window of every size; pixels of partial windows are left out."""
    size = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.lit(px).alias("px")) for k, _, px in numbered_sizes(sizes_m, pixel_m)]))
    out = pixels.select("*", size.alias("_w")).select("*", F.col("_w.size").alias("_size"), F.col("_w.px").alias("_px"))
    out = out.withColumns({"wr": F.floor(F.col("row") / F.col("_px")).cast("int"), "wc": F.floor(F.col("col") / F.col("_px")).cast("int")})
    whole = (F.col("wr") < F.floor(F.lit(rows) / F.col("_px"))) & (F.col("wc") < F.floor(F.lit(cols) / F.col("_px")))
    return out.where(whole).drop("_w")


def window_table(
    pixels: DataFrame, sizes_m: Sequence[float], pixel_m: float, rows: int, cols: int, *, metrics: Sequence[str] = METRICS, crowns: DataFrame | None = None,
    origin: tuple[float, float] = (0.0, 0.0), canopy_m: float = P.CANOPY_M, levels: int = 16, min_valid: int = 256, min_crowns: int = 3,
) -> DataFrame:
    """All asked metrics of every window: ``pixels`` has row, col, height and band, ``crowns`` x, y and crown_diam_m.

    heights: gap, crown and band shares and the number of valid pixels; texture: co-occurrence
    entropy of the band; edges: length of canopy edges per area; lines: one minus mean over
    peak of the line votes of those edges; crowns: number, mean and spread of diameters.
    """
    unknown = sorted(set(metrics) - set(METRICS))
    if unknown:
        raise ValueError(f"Unknown window metrics {unknown}. Known: {list(METRICS)}")
    if "crowns" in metrics and crowns is None:
        raise ValueError("The crown metrics need crowns")
    # dealt by window once: the metrics then need no more shuffles, and a task has as many pixels at any size of the grid
    parts = max(1, rows * cols * len(sizes_m) >> 17)
    tiles = tiled(pixels, sizes_m, pixel_m, rows, cols).withColumn("height", finite("height")).repartition(parts, *ZONE)
    out = window_frame(pixels.sparkSession, sizes_m, pixel_m, rows, cols)
    if "heights" in metrics:
        valid = tiles.where(F.col("height").isNotNull()).withColumn("h", F.col("height")).groupBy(*ZONE)
        out = out.join(valid.agg(F.count("h").alias("n_valid"), *pixel_aggregates(F.col("h"), canopy_m)), ZONE, "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    if "texture" in metrics:
        texture = K.texture_entropy(tiles, ZONE, "band", levels=levels, min_valid=min_valid)
        out = out.join(texture.select(*ZONE, "glcm_texture", "glcm_texture_reason"), ZONE, "left")
    if "edges" in metrics or "lines" in metrics:
        edges = K.edge_cells(tiles.withColumn("canopy", holds(F.col("height") >= canopy_m)), "canopy", ZONE)
        if "edges" in metrics:
            n = F.count(F.lit(1))
            density = edges.groupBy(*ZONE).agg((F.count(F.when(F.col("edge") & F.col("interior"), 1)) * pixel_m / (n * pixel_m * pixel_m)).alias("edge_density"))
            out = out.join(density, ZONE, "left")
        if "lines" in metrics:
            points = edges.where("edge").select(*ZONE, (F.col("col") - F.col("wc") * F.col("_px")).alias("x"), (F.col("row") - F.col("wr") * F.col("_px")).alias("y"))
            out = out.join(K.linearity(points, ZONE), ZONE, "left")
    if "crowns" in metrics:
        place = crowns.select("crown_diam_m", F.floor((F.col("x") - origin[0]) / pixel_m).alias("col"), F.floor((F.lit(origin[1]) - F.col("y")) / pixel_m).alias("row"))
        place = tiled(place.where("row >= 0 AND col >= 0"), sizes_m, pixel_m, rows, cols)
        stats = crown_stats(place, ZONE, min_crowns=min_crowns)
        out = out.join(stats.select(*ZONE, "crown_count", "crown_mean", "crown_cv"), ZONE, "left").withColumn("crown_count", F.coalesce("crown_count", F.lit(0)))
    return out.select("window_m", "wr", "wc", *[c for c in out.columns if c not in ("window_m", "px", *ZONE)])
