"""Spatial joins without geometry types: polygons are vertex arrays, objects are cell sets.

Shapes are spread to the grid tiles their box covers, so every join is an equality on
the tile; the exact test is an expression over the vertices of one shape.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow.functions.columns import finite, holds, lookup
from sylvaflow.operators.ranks import exact_quantiles


def contains(vertices: Column, x: Column, y: Column) -> Column:
    """Crossing-number test of a point in a ring of ``struct(x, y)`` (closing edge implied)."""
    n = F.size(vertices)

    def crosses(i: Column) -> Column:
        a, b = F.get(vertices, i), F.get(vertices, (i + 1) % n)
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans, (x < a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"])).cast("int")).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1


def with_box(polygons: DataFrame) -> DataFrame:
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    return polygons.withColumns({"minx": F.array_min(xs), "maxx": F.array_max(xs), "miny": F.array_min(ys), "maxy": F.array_max(ys)})


def _tiles(lo: str, hi: str, tile: float, pad: float = 0.0) -> Column:
    return F.explode(F.sequence(F.floor((F.col(lo) - pad) / tile), F.floor((F.col(hi) + pad) / tile)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, tile: float) -> DataFrame:
    """Points (x, y, ...) with the polygons (vertices, ...) that hold them."""
    p = with_box(polygons).select("*", _tiles("minx", "maxx", tile).alias("_tx")).select("*", _tiles("miny", "maxy", tile).alias("_ty"))
    q = points.withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    both = q.join(p, ["_tx", "_ty"]).where("x >= minx AND x <= maxx AND y >= miny AND y <= maxy")
    return both.where(contains(F.col("vertices"), F.col("x"), F.col("y"))).drop("_tx", "_ty", "vertices", "minx", "maxx", "miny", "maxy")


def _touches(vertices: Column, x0: Column, y0: Column, size: float) -> Column:
    """Whether an edge of a ring may touch a square; squares it misses by a hair count too."""
    n, half = F.size(vertices), size / 2 * (1 + 1e-6)
    mx, my = x0 + size / 2, y0 + size / 2

    def edge(i: Column) -> Column:
        a, b = F.get(vertices, i), F.get(vertices, (i + 1) % n)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        near = (F.least(a["x"], b["x"]) <= mx + half) & (F.greatest(a["x"], b["x"]) >= mx - half) & (F.least(a["y"], b["y"]) <= my + half) & (F.greatest(a["y"], b["y"]) >= my - half)
        return near & (F.abs(dx * (my - a["y"]) - dy * (mx - a["x"])) <= (F.abs(dx) + F.abs(dy)) * half)

    return F.exists(F.sequence(F.lit(0), n - 1), edge)


def polygon_sums(points: DataFrame, polygons: DataFrame, zone: str, tile: float, sums: Mapping[str, Column]) -> DataFrame:
    """Sums over the points (x, y, ...) inside the polygons (vertices, ...) of each zone.

    Points of one place are added up first. A tile that no edge touches lies on one side of the
    outline and gives its total; only the places of the other tiles are tested one by one.
    """
    places = points.groupBy("x", "y").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    places = places.withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    totals = places.groupBy("_tx", "_ty").agg(*[F.sum(n).alias(n) for n in sums])
    # few rows become many: dealt by a given number, which is not lowered for their small size
    dealt = with_box(polygons).repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")), zone)
    cover = dealt.select(zone, "vertices", _tiles("minx", "maxx", tile).alias("_tx"), "miny", "maxy").select(zone, "vertices", "_tx", _tiles("miny", "maxy", tile).alias("_ty"))
    x0, y0 = F.col("_tx") * tile, F.col("_ty") * tile
    cover = cover.withColumn("_touched", _touches(F.col("vertices"), x0, y0, tile))
    # Spark sizes the cover by the polygons, without their tiles, and would send it to every task: both sides are dealt by tile
    whole = cover.where(~F.col("_touched") & contains(F.col("vertices"), x0 + tile / 2, y0 + tile / 2)).select(zone, "_tx", "_ty").join(totals.hint("merge"), ["_tx", "_ty"])
    part = cover.where("_touched").join(places.hint("merge"), ["_tx", "_ty"]).where(contains(F.col("vertices"), F.col("x"), F.col("y")))
    both = whole.select(zone, *sums).unionByName(part.select(zone, *sums))
    return both.groupBy(zone).agg(*[F.sum(n).alias(n) for n in sums])


def zone_runs(polygons: DataFrame, zone: str, cell: float, rows: int, cols: int, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Runs of cells whose centre lies in each zone: zone, row, first and last column, and the
    cells of its box.

    Edges are dealt to the rows of cells whose centre line they cross; the crossings of a row,
    in order, pair into runs. No row carries a polygon, and no task holds one. Rings of the
    same zone are taken together by the even-odd rule, so holes and parts are rings too.
    """
    left, top = origin
    n = F.size("vertices")
    at = polygons.select(zone, "vertices", n.alias("_n"), F.posexplode("vertices").alias("_i", "_a"))
    nxt = F.get("vertices", (F.col("_i") + 1) % F.col("_n"))
    edges = at.select(zone, F.col("_a.x").alias("ax"), F.col("_a.y").alias("ay"), nxt["x"].alias("bx"), nxt["y"].alias("by"))
    box = edges.groupBy(zone).agg(F.min("ax").alias("minx"), F.max("ax").alias("maxx"), F.min("ay").alias("miny"), F.max("ay").alias("maxy"))
    first = lambda lo, size: F.greatest(F.floor(lo).cast("int"), F.lit(0))
    stop = lambda hi, size: F.least(F.ceil(hi).cast("int"), F.lit(size)) - 1
    box = box.select(
        zone, first((F.col("minx") - left) / cell, cols).alias("_c0"), stop((F.col("maxx") - left) / cell, cols).alias("_c1"),
        first((F.lit(top) - F.col("maxy")) / cell, rows).alias("_r0"), stop((F.lit(top) - F.col("miny")) / cell, rows).alias("_r1"),
    ).where("_r0 <= _r1 AND _c0 <= _c1")
    box = box.select(zone, "_c0", "_c1", "_r0", "_r1", ((F.col("_r1") - F.col("_r0") + 1) * (F.col("_c1") - F.col("_c0") + 1)).alias("box_cells"))
    low = F.greatest(F.floor((F.lit(top) - F.greatest("ay", "by")) / cell - 0.5).cast("int"), F.lit(0))
    high = F.least(F.ceil((F.lit(top) - F.least("ay", "by")) / cell - 0.5).cast("int"), F.lit(rows - 1))
    y = F.lit(top) - (F.col("row") + 0.5) * cell
    spread = edges.where((F.col("ay") != F.col("by")) & (low <= high)).select(zone, "ax", "ay", "bx", "by", F.explode(F.sequence(low, high)).alias("row"))
    hits = spread.where((F.col("ay") > y) != (F.col("by") > y))
    cross = F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    line = W.partitionBy(zone, "row").orderBy("x")
    pairs = hits.select(zone, "row", cross.alias("x")).withColumns({"_turn": F.row_number().over(line), "_x1": F.lead("x").over(line)}).where("_turn % 2 = 1")
    # the first column whose centre is not left of a crossing; the step to a neighbour settles rounding
    centre = lambda c: (c + 0.5) * cell + left

    def column(x: str) -> Column:
        guess = F.ceil((F.col(x) - left) / cell - 0.5).cast("int")
        return F.when(centre(guess - 1) >= F.col(x), guess - 1).when(centre(guess) < F.col(x), guess + 1).otherwise(guess)

    runs = pairs.select(zone, "row", F.greatest(column("x"), F.lit(0)).alias("col0"), F.least(column("_x1") - 1, F.lit(cols - 1)).alias("col1")).where("col0 <= col1")
    return runs.join(box.select(zone, "box_cells"), zone)


def zone_cells(polygons: DataFrame, zone: str, cell: float, rows: int, cols: int, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Cells whose centre lies in each zone, with the number of cells of its box."""
    runs = zone_runs(polygons, zone, cell, rows, cols, origin)
    return runs.select(zone, "box_cells", "row", F.explode(F.sequence("col0", "col1")).alias("col"))


def zone_support(cells: DataFrame, zone: str, cell: float) -> DataFrame:
    agg = cells.groupBy(zone).agg(F.count(F.lit(1)).alias("n_inside"), F.max("box_cells").alias("_b"))
    return agg.select(zone, "n_inside", (F.col("n_inside") * cell * cell).alias("area_m2"), (F.col("n_inside") / F.col("_b")).alias("bbox_fill_fraction"))


def code_under_points(points: DataFrame, cells: DataFrame, cell: float, code: str, origin: tuple[float, float] = (0.0, 0.0), keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Code of the cell of the same unit under each point, 0 outside the coded cells."""
    left, top = origin
    at = points.withColumns({"row": F.floor((F.lit(top) - F.col("y")) / cell).cast("int"), "col": F.floor((F.col("x") - left) / cell).cast("int")})
    return at.join(cells.select(*keys, "row", "col", code), [*keys, "row", "col"], "left").withColumn(code, F.coalesce(code, F.lit(0)))


def at_centres(fine: DataFrame, coarse: DataFrame, fine_m: float, coarse_m: float, value: str, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Coarse value of the same unit under the centre of each fine cell, with a flag for cells outside."""
    own = lambda a: F.floor((F.col(a) + 0.5) * fine_m / coarse_m).cast("int")
    df = fine.withColumns({"_r": own("row"), "_c": own("col")})
    c = coarse.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), value, F.lit(True).alias("_in"))
    out = df.join(c, [*keys, "_r", "_c"], "left")
    return out.withColumns({"inside": F.coalesce("_in", F.lit(False)), value: F.coalesce(value, F.lit(0))}).drop("_r", "_c", "_in")


def label_cells(pixels: DataFrame, prior: DataFrame, cell_px: int) -> DataFrame:
    """Label pixels pooled to map cells, with the prior percent of the cell's centre pixel.

    ``pixels``: unit, k, row, col (global pixel), change, agent; ``prior``: unit, k, row, col, percent.
    """
    from sylvaflow.operators.cells import pool_labels

    place = {"row": F.floor(F.col("row") / cell_px).cast("int"), "col": F.floor(F.col("col") / cell_px).cast("int")}
    keys = ["unit", "k", "row", "col"]
    pooled = pool_labels(pixels.withColumns(place), keys)
    half = cell_px // 2
    centre = prior.where((F.col("row") % cell_px == half) & (F.col("col") % cell_px == half)).withColumns(place)
    out = pooled.join(centre, keys, "left")
    return out.select(*keys, F.when(F.col("pooled") == 2, 1).otherwise(F.col("pooled")).alias("target"), "agent", F.coalesce("percent", F.lit(255)).alias("di"))


def nearby(objects: DataFrame, focus: DataFrame, radius: float, tile: float, refined: DataFrame | None = None, one_box: bool = False) -> DataFrame:
    """Objects whose box is within a radius of a focus box; a refined outline is preferred.

    Boxes are minx, maxx, miny, maxy; ``focus`` has focus_id, ``refined`` object_id and area_ha.
    A pair of boxes is made only in the tile of its common corner, so pairs need not be compared; only those of a
    focus_id with several boxes are. With ``one_box`` there is no such focus_id. Outlines meet the objects before the pairs do.
    """
    names = list(objects.columns)
    box = ["minx", "maxx", "miny", "maxy"]
    # dealt by the key of the next step, so that rows are compared and joined after one shuffle
    objects = objects.repartition("object_id").distinct()
    focus = focus.select("focus_id", *box).repartition("focus_id").distinct()
    if not one_box:
        focus = focus.withColumn("_boxes", F.count(F.lit(1)).over(W.partitionBy("focus_id")))
    carried = list(names)
    if refined is not None:
        fine = refined.select("object_id", F.col("area_ha").alias("_fine"))
        if not one_box:  # several outlines of an object stay several rows
            fine = fine.withColumn("_outline", F.row_number().over(W.partitionBy("object_id").orderBy("_fine")))
        objects = objects.join(fine, "object_id", "left")
        carried += [c for c in fine.columns if c != "object_id"]
    o = objects.select(*carried, _tiles("minx", "maxx", tile).alias("_tx")).select("*", _tiles("miny", "maxy", tile).alias("_ty"))
    f = focus.select("focus_id", *[F.col(c).alias(f"f_{c}") for c in box], *(c for c in focus.columns if c == "_boxes"))
    f = f.select("*", _tiles("f_minx", "f_maxx", tile, radius).alias("_tx")).select("*", _tiles("f_miny", "f_maxy", tile, radius).alias("_ty"))
    r = F.lit(radius)
    hit = (F.col("maxx") >= F.col("f_minx") - r) & (F.col("minx") <= F.col("f_maxx") + r) & (F.col("maxy") >= F.col("f_miny") - r) & (F.col("miny") <= F.col("f_maxy") + r)
    corner = lambda low: F.floor(F.greatest(F.col(low), F.col(f"f_{low}") - r) / tile)

    def pairs(f: DataFrame) -> DataFrame:
        both = o.join(f, ["_tx", "_ty"]).where(hit & (F.col("_tx") == corner("minx")) & (F.col("_ty") == corner("miny")))
        return both.select("focus_id", *carried)

    if one_box:
        out = pairs(f)
    else:
        out = pairs(f.where("_boxes = 1")).unionByName(pairs(f.where("_boxes > 1")).distinct())
    if refined is None:
        return out.withColumn("geom_src", F.lit("object"))
    return out.withColumns({"geom_src": F.when(F.col("_fine").isNotNull(), "refined").otherwise("object"), "area_ha": F.coalesce("_fine", "area_ha")}).drop("_fine", "_outline")


def tile_strata(cover: DataFrame, tile_cells: int, min_share: float, stratum: str = "dist_label") -> DataFrame:
    """Stratum of the stand that covers most of a tile, if above a share, else undisturbed.

    ``cover`` lists (tile, stand_id, label, row, col).
    """
    n = cover.groupBy("tile", "stand_id", stratum).agg(F.countDistinct("row", "col").alias("n"))
    best = n.groupBy("tile").agg(F.max_by(F.struct("stand_id", stratum, "n"), F.struct("n", "stand_id")).alias("b"))
    ok = F.col("b.n") / float(tile_cells) >= min_share
    return best.select("tile", F.when(ok, F.col("b.stand_id")).otherwise("").alias("stand_id"), F.when(ok, F.col(f"b.{stratum}")).otherwise("undisturbed").alias("stratum"))


def whole_tiles(extent: DataFrame, size: float) -> DataFrame:
    """Whole tiles over the extent of each unit (minx, miny, maxx, maxy); a tile that ends on the edge is left out."""
    steps = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - size - F.col(lo)) / size), F.lit(0)).cast("int")
    df = extent.withColumns({"_nx": steps("minx", "maxx"), "_ny": steps("miny", "maxy")}).where("_nx > 0 AND _ny > 0")
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)).alias("tx")).select("*", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)).alias("ty"))
    return df.select("unit", "tx", "ty", (F.col("minx") + F.col("tx") * size).alias("x0"), (F.col("miny") + F.col("ty") * size).alias("y0"))


def tile_canopy(heights: DataFrame, tile_cells: int, *, canopy_m: float, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Canopy statistics of tiles of ``tile_cells`` cells: shares without data and with canopy of
    all its cells, median and 90th percentile of the canopy heights."""
    tile = [*keys, "tr", "tc"]
    h = finite("height")
    rows = heights.select(*keys, F.floor(F.col("row") / tile_cells).cast("int").alias("tr"), F.floor(F.col("col") / tile_cells).cast("int").alias("tc"), h.alias("h"))
    whole = float(tile_cells * tile_cells)
    canopy = F.when(F.col("h") >= canopy_m, F.col("h"))
    agg = rows.groupBy(*tile).agg((1.0 - F.count("h") / whole).alias("nodata_fraction"), (F.count(canopy) / whole).alias("canopy_fraction"))
    tall = exact_quantiles(rows.where(F.col("h") >= canopy_m), tile, "h", {"height_median": 0.5, "height_p90": 0.9}, 0.25)
    return agg.join(tall, tile, "left")


def tile_cover(runs: DataFrame, zone: str, tile_cells: int) -> DataFrame:
    """Share of each tile that a zone covers, from the runs of ``zone_runs``: a run is cut at tile borders, never spread to cells."""
    wide = runs.select(zone, F.floor(F.col("row") / tile_cells).cast("int").alias("tr"), "col0", "col1", F.explode(F.sequence(F.floor(F.col("col0") / tile_cells).cast("int"), F.floor(F.col("col1") / tile_cells).cast("int"))).alias("tc"))
    cells = F.least(F.col("col1"), (F.col("tc") + 1) * tile_cells - 1) - F.greatest(F.col("col0"), F.col("tc") * tile_cells) + 1
    return wide.groupBy("tr", "tc", zone).agg((F.sum(cells) / float(tile_cells * tile_cells)).alias("cover"))


def describe_tiles(canopy: DataFrame, cover: DataFrame, labels: DataFrame, strata: dict[str, str], *, zone: str = "stand_id", min_cover: float = 0.15, max_nodata: float = 0.02, min_canopy: float = 0.75) -> DataFrame:
    """Stratum of every tile: that of the stand that covers most of it, else edge and gap, tall or mixed.

    ``labels`` has zone and dist_label. A tile takes the stratum of its main stand when the
    stand covers enough and its label has one. Of the others, tiles with much missing or little
    canopy are ``edge_and_gap``; the rest is parted at the median of their median heights.
    """
    best = cover.groupBy("tr", "tc").agg(F.max_by(F.struct(zone, "cover"), F.struct("cover", zone)).alias("b")).select("tr", "tc", F.col(f"b.{zone}").alias(zone), F.col("b.cover").alias("cover"))
    named = best.where(F.col("cover") >= min_cover).join(labels, zone).withColumn("stratum", lookup("dist_label", strata)).where("stratum IS NOT NULL")
    out = canopy.join(named.select("tr", "tc", zone, "dist_label", "stratum"), ["tr", "tc"], "left")
    broken = (F.col("nodata_fraction") > max_nodata) | (F.col("canopy_fraction") < min_canopy)
    out = out.withColumn("stratum", F.coalesce("stratum", F.when(holds(broken), "edge_and_gap")))
    rest = out.where("stratum IS NULL AND height_median IS NOT NULL").withColumn("_all", F.lit(0))
    cut = exact_quantiles(rest, ["_all"], "height_median", {"m": 0.5}, 0.25).agg(F.max("m")).scalar()
    stature = F.when(F.col("height_median") >= cut, "undisturbed_tall").when(F.col("height_median") < cut, "undisturbed_mixed").otherwise("undisturbed")
    return out.withColumn("stratum", F.coalesce("stratum", stature))


def ring_series(heights: DataFrame, objects: DataFrame, ring_cells: float, keys: Sequence[str] = ("unit", "object_id")) -> DataFrame:
    """Mean height inside each object and in a ring around it, per year; ``heights`` has the unit of the objects."""
    from sylvaflow.operators.cells import dilate, disk

    keys = list(keys)
    inside = objects.select(*keys, "row", "col").withColumn("zone", F.lit("inside"))
    ring = dilate(objects, disk(ring_cells), keys).join(objects.select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti").withColumn("zone", F.lit("ring"))
    both = inside.unionByName(ring).join(heights, ["unit", "row", "col"])
    mean = lambda z: F.avg(F.when(F.col("zone") == z, F.col("height"))).alias(z)
    return both.groupBy(*keys, "year").agg(mean("inside"), mean("ring"))
