"""Connected components of cell sets, minimum sizes, objects and their attributes.

Cells are labelled inside tiles of bounded size (Arrow groups that never grow with
the data), then labels that touch across tile borders are merged with star
contractions on the small border graph, with a checkpoint per round. The label of a
component is its first cell in row order, so it does not depend on the tiling.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaflow import params as P
from sylvaflow.functions.columns import holds
from sylvaflow.functions.scalars import interval_label
from sylvaflow.operators.cells import CELL, DATE, cell_ha, dilate, disk, erode, min_cells, shifted, square
from sylvaflow.session import cut_lineage

TILE = 256
_STRIDE = 1 << 31


def cell_number(row: Column | str = "row", col: Column | str = "col") -> Column:
    """Cells in row order as one number."""
    r, c = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return r.cast("bigint") * F.lit(_STRIDE) + c


def _forward(connectivity: int) -> list[tuple[int, int]]:
    return [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])


def _label_tile(number: np.ndarray, connectivity: int) -> np.ndarray:
    """Smallest cell number of the component of every cell of one tile."""
    order = np.argsort(number)
    ids = number[order]
    pairs = []
    for dr, dc in _forward(connectivity):
        target = ids + dr * _STRIDE + dc
        at = np.minimum(np.searchsorted(ids, target), len(ids) - 1)
        hit = np.flatnonzero(ids[at] == target)
        pairs.append(np.stack([hit, at[hit]]))
    a, b = np.concatenate(pairs, axis=1)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = np.minimum(root, root[root])
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    out = np.empty_like(number)
    out[order] = ids[root]
    return out


def merge_labels(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Component of every node of an undirected edge table ``a``, ``b``: columns ``node``, ``root``.

    Large-star and small-star rounds; each leaves every node connected and moves it to a
    smaller neighbour, until the edges form stars.
    """
    keys = list(keys)
    e = cut_lineage(edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).select(*keys, "u", "v", "m")
        e = small.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select(*keys, "u", F.col("m").alias("v")))
        e = cut_lineage(e.distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state:
            return e.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        state = (now["n"], now["h"])


def tile_parts(cells: DataFrame, keys: Sequence[str] = DATE, *, connectivity: int = 8, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Cells with the ``label`` of their part inside a tile, and pairs ``a``, ``b`` of parts that touch across tiles."""
    keys = list(keys)
    base = cells.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    base = base.withColumns({"_tr": F.floor(F.col("row") / tile).cast("int"), "_tc": F.floor(F.col("col") / tile).cast("int")})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["row", "col"])
        number = pdf["row"].to_numpy("int64") * _STRIDE + pdf["col"].to_numpy("int64")
        return pdf.assign(label=_label_tile(number, connectivity))

    schema = T.StructType([*base.schema.fields, T.StructField("label", T.LongType())])
    local = cut_lineage(base.groupBy(*keys, "_tr", "_tc").applyInPandas(label, schema))
    edge = lambda a, lo: F.pmod(F.col(a), F.lit(tile)) == (0 if lo else tile - 1)
    border = local.where(edge("row", True) | edge("row", False) | edge("col", True) | edge("col", False))
    heads = shifted(border.select(*keys, "row", "col", "_tr", "_tc", F.col("label").alias("a")), _forward(connectivity))
    heads = heads.where((F.floor(F.col("row") / tile) != F.col("_tr")) | (F.floor(F.col("col") / tile) != F.col("_tc")))
    edges = heads.select(*keys, "row", "col", "a").join(border.select(*keys, "row", "col", F.col("label").alias("b")), [*keys, "row", "col"]).select(*keys, "a", "b").distinct()
    return local.drop("_tr", "_tc"), cut_lineage(edges)


def label_components(cells: DataFrame, keys: Sequence[str] = DATE, *, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """Adds ``label``, the first cell number of the component, to a cell set (keys, row, col, ...)."""
    keys = list(keys)
    labelled, edges = tile_parts(cells, keys, connectivity=connectivity, tile=tile)
    if not edges.isEmpty():
        roots = merge_labels(edges, keys).withColumnRenamed("node", "label")
        labelled = labelled.join(roots, [*keys, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    return labelled.select(*keys, "row", "col", "label")


def drop_small(cells: DataFrame, least: int, keys: Sequence[str] = DATE, *, connectivity: int = 8) -> DataFrame:
    """Cells of components of at least ``least`` cells, with label and size."""
    lab = label_components(cells, keys, connectivity=connectivity)
    size = lab.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= least)
    return lab.join(size, [*keys, "label"])


def fill_holes(cells: DataFrame, grid: DataFrame, largest: int, keys: Sequence[str] = DATE, *, touch_border: bool = True, tile: int = TILE) -> DataFrame:
    """Cell set with background components (4-connected) of at most ``largest`` cells added.

    ``grid`` lists all cells; without ``touch_border`` holes at the edge of the grid stay.
    A part of a tile that is larger than a hole, or on a border that holes may not touch, is
    open: it is never merged, it only opens the small parts beside it.
    """
    keys = list(keys)
    cell, part = [*keys, "row", "col"], [*keys, "label"]
    back, edges = tile_parts(grid.select(*cell).join(cells.select(*cell), cell, "left_anti"), keys, connectivity=4, tile=tile)
    size = back.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    is_open = F.col("n") > largest
    if not touch_border:
        box = grid.groupBy(*keys).agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))
        size = size.join(box, keys)
        is_open = is_open | (F.col("r0") <= F.col("top")) | (F.col("r1") >= F.col("bottom")) | (F.col("c0") <= F.col("left")) | (F.col("c1") >= F.col("right"))
    size = cut_lineage(size.select(*part, "n", is_open.alias("open")))
    small = size.where("NOT open").select(*part, "n")
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    opened = both.join(size.where("open").select(*keys, F.col("label").alias("b")), [*keys, "b"], "left_semi").select(*keys, F.col("a").alias("label")).distinct()
    is_small = lambda end: small.select(*keys, F.col("label").alias(end))
    inner = cut_lineage(edges.join(is_small("a"), [*keys, "a"], "left_semi").join(is_small("b"), [*keys, "b"], "left_semi"))
    whole = small.join(opened.withColumn("_open", F.lit(True)), part, "left").withColumn("root", F.col("label"))
    if not inner.isEmpty():
        roots = merge_labels(inner, keys).select(*keys, F.col("node").alias("label"), F.col("root").alias("_root"))
        whole = whole.join(roots, part, "left").withColumn("root", F.coalesce("_root", "root")).drop("_root")
    holes = whole.groupBy(*keys, "root").agg(F.sum("n").alias("_n"), F.coalesce(F.bool_or("_open"), F.lit(False)).alias("_o")).where((F.col("_n") <= largest) & ~F.col("_o"))
    labels = whole.join(holes.select(*keys, "root"), [*keys, "root"], "left_semi").select(*part)
    return cells.select(*cell).unionByName(back.join(labels, part, "left_semi").select(*cell)).distinct()


def clean_mask(cells: DataFrame, grid: DataFrame, min_patch: int, largest_hole: int, keys: Sequence[str] = DATE) -> DataFrame:
    """Small patches removed, then small holes filled (both 4-connected); sizes of 1 or less do nothing."""
    out = cells.select(*keys, "row", "col")
    if min_patch > 1:
        out = drop_small(out, min_patch, keys, connectivity=4).select(*keys, "row", "col")
    return fill_holes(out, grid, largest_hole - 1, keys) if largest_hole > 1 else out


# --- detections --------------------------------------------------------------------------
def interval_detections(flags: DataFrame, dates: Sequence[int], *, least: int = min_cells(P.MMU_HA), growth: int = min_cells(P.GROWTH_MMU_HA), tile: int = TILE) -> DataFrame:
    """Objects kept per date: at least ``least`` cells, or ``growth`` cells where they touch an
    earlier kept detection. Returns the cells (unit, t, row, col, label, n_cells) of kept objects.

    Dates are few and ordered; the loop runs over them on the object table only.
    """
    growth = min(growth, least)
    lab = cut_lineage(label_components(flags, DATE, tile=tile))
    size = lab.groupBy(*DATE, "label").agg(F.count(F.lit(1)).alias("n_cells"))
    size = cut_lineage(size.where(F.col("n_cells") >= growth))
    kept = size.where(F.col("n_cells") >= least)
    if growth < least:
        objects = lab.join(size.select(*DATE, "label"), [*DATE, "label"], "left_semi")
        near = shifted(objects.join(size.where(F.col("n_cells") < least).select(*DATE, "label"), [*DATE, "label"], "left_semi"), square(1)).select(*DATE, "label", "row", "col")
        other = objects.select("unit", F.col("t").alias("t0"), F.col("label").alias("label0"), "row", "col")
        touch = near.join(other, CELL).where("t0 < t").select(*DATE, "label", "t0", "label0").distinct()
        touch = cut_lineage(touch)
        for t in dates[1:]:
            base = kept.select("unit", F.col("t").alias("t0"), F.col("label").alias("label0")).where(F.col("t0") < t)
            grown = touch.where(F.col("t") == t).join(base, ["unit", "t0", "label0"], "left_semi").select(*DATE, "label").distinct()
            kept = cut_lineage(kept.unionByName(size.join(grown, [*DATE, "label"], "left_semi").where(F.col("n_cells") < least)))
    return lab.join(kept, [*DATE, "label"])


def onset_objects(onset: DataFrame, least: int) -> DataFrame:
    """Cells of one onset date form objects; objects under the minimum lose their onset."""
    flagged = onset.where(F.col("onset_index") >= 0).withColumnRenamed("onset_index", "t")
    return drop_small(flagged, least, DATE).select("unit", "t", "row", "col", "label", "n_cells")


def detection_objects(detected: DataFrame, layers: DataFrame, years: DataFrame, *, growth_below: int | None = None, cell_m: float = P.GRAIN_M) -> DataFrame:
    """One row per object: interval, size, share detected before, growth, mean and highest
    probability, mean z and whether a later image exists.

    ``detected`` are labelled cells, ``layers`` has probability and z, ``years`` (unit, t, year).
    """
    first = W.partitionBy(*CELL)
    cells = detected.withColumn("_earlier", F.col("t") > F.min("t").over(first)).join(layers.select(*DATE, "row", "col", "probability", "z"), [*DATE, "row", "col"], "left")
    obj = cells.groupBy(*DATE, "label").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("_earlier").cast("double")).alias("earlier_share"),
        F.avg("probability").alias("mean_prob"), F.max("probability").alias("max_prob"), F.avg("z").alias("mean_z"),
        F.avg(F.col("col") + 0.5).alias("_x"), F.avg(F.col("row") + 0.5).alias("_y"),
    )
    named = years.withColumns({
        "year_before": F.lag("year").over(W.partitionBy("unit").orderBy("t")),
        "follow_up": F.lead("year").over(W.partitionBy("unit").orderBy("t")).isNotNull(),
    })
    obj = obj.join(named, DATE)
    number = F.row_number().over(W.partitionBy("unit").orderBy("t", "label"))
    growth = F.col("n_cells") < growth_below if growth_below is not None else F.lit(False)
    return obj.select(
        "unit", number.alias("object_id"), F.col("year").alias("onset_year"), "year_before", interval_label(F.col("year_before"), F.col("year")).alias("interval"),
        F.col("t").alias("onset_index"), "label", "n_cells", (F.col("n_cells") * cell_ha(cell_m)).alias("area_ha"), "earlier_share", growth.alias("growth"),
        "mean_prob", "max_prob", "mean_z", "follow_up", (F.col("_x") * cell_m).alias("x"), (-F.col("_y") * cell_m).alias("y"),
    )


def touching(objects: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels of ``objects`` with a cell on or beside a cell of ``others``."""
    near = dilate(others, square(1), keys)
    return objects.join(near, [*keys, "row", "col"], "left_semi").select(*keys, "label").distinct()


def unmatched_patches(percent: DataFrame, objects: DataFrame, keys: Sequence[str], *, cut: int, least: int, forest_share: float | None = None) -> DataFrame:
    """Patches of flagged cells that touch no object within one cell, with size, mean percent,
    forest share and centre. ``percent`` has percent and forest per cell."""
    keys = list(keys)
    lab = label_components(percent.where((F.col("percent") >= cut) & (F.col("percent") <= 100)), keys)
    seen = touching(lab, objects, keys)
    own = lab.join(seen, [*keys, "label"], "left_anti").join(percent, [*keys, "row", "col"])
    out = own.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("percent").alias("mean_percent"), F.avg(F.col("forest").cast("double")).alias("forest_share"),
        F.avg("row").alias("row_centre"), F.avg("col").alias("col_centre"),
    ).where(F.col("cells") >= least)
    return out if forest_share is None else out.where(F.col("forest_share") >= forest_share)


def other_candidates(cells: DataFrame, detected: DataFrame, *, rule: dict = P.CANDIDATES, cell_m: float = P.GRAIN_M) -> DataFrame:
    """Weak or height-loss cells of each interval outside a buffer of its detections, as objects.

    ``cells`` has forest (dips filled), chm_cover and probability per date; the source is
    the height loss when it covers at least half of the cells.
    """
    w = W.partitionBy(*CELL).orderBy("t")
    f0, c0 = F.lag("forest").over(w), F.lag("chm_cover").over(w)
    lost = holds(f0 & ~F.col("forest") & (c0 - F.col("chm_cover") >= rule["chm_loss_min_drop"]))
    use = cells.select(*DATE, "row", "col", "probability", holds(f0).alias("_f0"), lost.alias("lost")).where(F.col("_f0") & (holds(F.col("probability") >= rule["weak_prob"]) | F.col("lost")))
    near = dilate(detected, square(rule["detected_buffer_cells"]))
    use = use.join(near, [*DATE, "row", "col"], "left_anti")
    lab = drop_small(use, min_cells(rule["min_ha"], cell_m)).join(use, [*DATE, "row", "col"])
    obj = lab.groupBy(*DATE, "label").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("lost").cast("double")).alias("_l"), F.avg("probability").alias("mean_prob"))
    return obj.select(*DATE, "label", F.when(F.col("_l") >= 0.5, "chm").otherwise("weak").alias("source"), "n_cells", (F.col("n_cells") * cell_ha(cell_m)).alias("area_ha"), "mean_prob")


def cluster_probability(cells: DataFrame, z: str, null: DataFrame, flag: str, mirrored: str, *, keys: Sequence[str] = DATE) -> DataFrame:
    """Clusters of flagged cells with their mass and one minus the monotone empirical fdr.

    ``flag`` marks loss cells, ``mirrored`` those of the field mirrored at the null centre.
    Works on the cluster table, which is small against the cells.
    """
    keys = list(keys)
    rows = cells.join(null.select(*keys, "mu0", "sigma0"), keys)

    def mass(mask: str, sign: int) -> DataFrame:
        use = rows.where(F.col(mask))
        weight = F.greatest(F.lit(0.0), F.try_divide(sign * (F.col("mu0") - F.col(z)), F.col("sigma0")))
        lab = label_components(use, keys).join(use.select(*keys, "row", "col", weight.alias("w")), [*keys, "row", "col"])
        return lab.groupBy(*keys, "label").agg(F.sum("w").alias("mass"), F.count(F.lit(1)).alias("n_cells"))

    obs = mass(flag, 1).withColumn("own", F.lit(1))
    null_mass = mass(mirrored, -1).withColumn("own", F.lit(0))
    every = obs.unionByName(null_mass).withColumn("mass", F.round("mass", 9))
    at_least = W.partitionBy(*keys).orderBy(F.col("mass").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    fdr = F.least(F.lit(1.0), F.sum(1 - F.col("own")).over(at_least) / F.greatest(F.sum("own").over(at_least), F.lit(1)))
    scored = every.withColumn("fdr", fdr).where("own = 1")
    q = F.min("fdr").over(W.partitionBy(*keys).orderBy("mass").rangeBetween(W.unboundedPreceding, W.currentRow))
    return scored.select(*keys, "label", "n_cells", "mass", (1.0 - q).alias("probability"))


# --- refinement of loss on pixels -----------------------------------------------------------
def loss_pixels(pixels: DataFrame, keys: Sequence[str], *, canopy_m: float = 10.0, open_m: float = 5.0, drop_m: float = 8.0, tolerance_px: int = 1) -> DataFrame:
    """Pixels that were canopy (``h0``) and are lost after: the highest later height ``h1`` around
    them is open or far lower; an unknown later height counts as tall."""
    keys = list(keys)
    tall = pixels.select(*keys, "row", "col", F.coalesce("h1", F.lit(float("inf"))).alias("_h"))
    top = shifted(tall, square(tolerance_px)).groupBy(*keys, "row", "col").agg(F.max("_h").alias("_top"))
    df = pixels.join(top, [*keys, "row", "col"])
    h0, t = F.col("h0"), F.col("_top")
    lost = (t < float("inf")) & (h0 >= canopy_m) & ((t < open_m) | (t - h0 <= -drop_m))
    return df.where(holds(lost)).select(*keys, "row", "col")


def refine(pixels: DataFrame, seed: DataFrame, keys: Sequence[str], pixel_m: float, *, open_radius_m: float = 1.0, min_opening_m2: float = 25.0, close_radius_m: float = 8.0, fill_holes_m2: float = 2500.0, min_envelope_m2: float = 1000.0, canopy_m: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Openings, envelope and statistics of pixel-level loss around seed cells.

    Opening by a disk, small parts dropped; closing by a disk, holes filled unless they
    touch the border, small parts and parts without a seed dropped. A disk closing is a
    dilation followed by an erosion on a frame wide enough that the border has no effect.
    """
    keys = list(keys)
    cell = [*keys, "row", "col"]
    loss = loss_pixels(pixels, keys, canopy_m=canopy_m)
    d_open, d_close = disk(open_radius_m / pixel_m), disk(close_radius_m / pixel_m)
    opened = dilate(erode(loss, d_open, keys), d_open, keys)
    openings = drop_small(opened, max(1, round(min_opening_m2 / pixel_m**2)), keys).select(*cell)
    env = erode(dilate(openings, d_close, keys), d_close, keys).join(pixels.select(*cell), cell, "left_semi")
    env = fill_holes(env, pixels, round(fill_holes_m2 / pixel_m**2), keys, touch_border=False)
    lab = drop_small(env, max(1, round(min_envelope_m2 / pixel_m**2)), keys)
    seeded = lab.join(seed.select(*cell), cell, "left_semi").select(*keys, "label").distinct()
    env = cut_lineage(lab.join(seeded, [*keys, "label"], "left_semi").select(*cell))
    openings = cut_lineage(openings.join(env, cell, "left_semi"))
    parts = label_components(openings, keys).groupBy(*keys).agg(F.countDistinct("label").alias("n_openings"))
    flags = (
        env.withColumn("e", F.lit(1)).join(openings.withColumn("o", F.lit(1)), cell, "left")
        .join(seed.select(*cell).distinct().withColumn("s", F.lit(1)), cell, "full").join(pixels.select(*cell, "h0"), cell, "left")
    )
    e, o, s = (F.col(c).isNotNull() for c in "eos")
    n = lambda c: F.count(F.when(c, 1))
    ha = pixel_m * pixel_m / 1e4
    stats = flags.groupBy(*keys).agg(
        (n(e) * ha).alias("envelope_ha"), (n(o) * ha).alias("openings_ha"), (n(o) / F.greatest(n(e), F.lit(1))).alias("opening_share"),
        (n(e & holds(F.col("h0") >= canopy_m)) / F.greatest(n(e), F.lit(1))).alias("canopy0_share"),
        (n(e & s) / F.greatest(n(e | s), F.lit(1))).alias("iou_seed"),
    )
    return openings, env, stats.join(parts, keys, "left").withColumn("n_openings", F.coalesce("n_openings", F.lit(0)))
