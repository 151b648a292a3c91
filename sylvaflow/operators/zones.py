"""Structure metrics of zones (stands, windows, components) from pixel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import finite, holds, share
from sylvaflow.operators.ranks import exact_quantiles

HEIGHT_WIDTH = 0.25


def share_where(condition: Column) -> Column:
    """Share of the rows on which the condition is known and holds."""
    return F.avg(condition.cast("double"))


def pixel_aggregates(height: Column, canopy_m: float = P.CANOPY_M) -> list[Column]:
    """Pixel shares of one group: gap, crown and the half-open height bands."""
    bands = [share_where((height >= lo) & (height < hi)).alias(n) for n, (lo, hi) in P.HEIGHT_BANDS.items()]
    return [share_where(height < canopy_m).alias("gap_fraction"), share_where(height >= canopy_m).alias("crown_fraction"), *bands]


def zone_pixel_metrics(
    pixels: DataFrame, keys: Sequence[str], height: str = "height", *, canopy_m: float = P.CANOPY_M,
    min_pixels: int = P.MIN_CANOPY_PIXELS,
) -> DataFrame:
    """Gap, crown and band shares over valid pixels, height statistics over canopy pixels.

    Groups without a valid pixel keep a row with null metrics.
    """
    keys = list(keys)
    rows = pixels.select(*keys, finite(height).alias("_h"))
    h = F.col("_h")
    canopy = F.when(h >= canopy_m, h)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_inside"), F.count("_h").alias("n_valid_pixels"), *pixel_aggregates(h, canopy_m),
        F.count(canopy).alias("_n"), F.avg(canopy).alias("height_mean"), F.max(canopy).alias("height_max"),
        F.stddev_pop(canopy).alias("_sd"),
    )
    tall = exact_quantiles(
        rows.where(h >= canopy_m), keys, "_h", {"height_median": 0.5, "height_p90": 0.9}, HEIGHT_WIDTH
    )
    out = out.join(tall, keys, "left")
    gate = lambda c: F.when(F.col("_n") >= min_pixels, c)
    return out.select(
        *keys, "n_valid_pixels",
        (1.0 - F.col("n_valid_pixels") / F.col("_inside")).alias("nodata_fraction"),
        "gap_fraction", "crown_fraction", *P.HEIGHT_BANDS,
        *[gate(F.col(c)).alias(c) for c in ("height_mean", "height_median", "height_p90", "height_max")],
        gate(share(F.col("_sd"), F.col("height_mean"))).alias("height_cv"),
    )


def previous_dates(frame: DataFrame, zone: str = "stand_id") -> DataFrame:
    """Dates of each zone with the date before in the series."""
    dates = frame.select(zone, "year").distinct()
    return dates.withColumn("prev_year", F.lag("year").over(W.partitionBy(zone).orderBy("year")))


def gap_persistence(
    pixels: DataFrame, zone: str = "stand_id", cell: Sequence[str] = ("row", "col"), *, canopy_m: float = P.CANOPY_M
) -> DataFrame:
    """Share of cells valid on two consecutive dates of the zone that are gap on both."""
    rows = pixels.select(zone, "year", *cell, finite("height").alias("h")).where("h IS NOT NULL")
    links = previous_dates(pixels, zone).where("prev_year IS NOT NULL")
    now = rows.join(links, [zone, "year"])
    before = rows.select(zone, F.col("year").alias("prev_year"), *cell, F.col("h").alias("h0"))
    both = now.join(before, [zone, "prev_year", *cell], "left")
    seen = F.col("h0").isNotNull()
    joint = seen & (F.col("h") < canopy_m) & (F.col("h0") < canopy_m)
    return both.groupBy(zone, "year").agg(
        share(F.count(F.when(joint, 1)), F.count(F.when(seen, 1))).alias("gap_persistence")
    )


def crown_stats(crowns: DataFrame, keys: Sequence[str], diameter: str = "crown_diam_m", *, min_crowns: int = P.MIN_CROWNS) -> DataFrame:
    """Count, CV, p90, mean, median and deviation of crown diameters, with the reason when too few."""
    keys = list(keys)
    rows = crowns.select(*keys, finite(diameter).alias("_d"))
    agg = rows.groupBy(*keys).agg(F.count("_d").alias("n_crowns"), F.avg("_d").alias("m"), F.stddev_pop("_d").alias("sd"))
    qs = exact_quantiles(rows, keys, "_d", {"q50": 0.5, "q90": 0.9}, HEIGHT_WIDTH)
    ok = F.col("n_crowns") >= min_crowns
    return agg.join(qs, keys, "left").select(
        *keys, "n_crowns", F.col("n_crowns").alias("crown_count"),
        F.when(ok, share(F.col("sd"), F.col("m"))).alias("crown_cv"), F.when(ok, F.col("q90")).alias("crown_p90"),
        F.when(ok, F.col("m")).alias("crown_mean"), F.when(ok, F.col("q50")).alias("crown_median"),
        F.when(ok, F.col("sd")).alias("crown_std"),
        F.when(~ok, F.concat(F.lit("n_crowns="), F.col("n_crowns"), F.lit(f" < min_crowns={min_crowns}"))).alias("crown_reason"),
    )


def add_change(frame: DataFrame, metrics: Sequence[str], by: str = "stand_id", order: str = "year") -> DataFrame:
    """Difference to the previous row of the stand; a missing metric gives a null column."""
    w = W.partitionBy(by).orderBy(order)
    new = {}
    for name in metrics:
        new[f"d_{name}"] = F.col(name) - F.lag(name).over(w) if name in frame.columns else F.lit(None).cast("double")
    return frame.withColumns(new)


def stand_records(pixels: DataFrame, *, crowns: DataFrame | None = None, texture: DataFrame | None = None, spatial: DataFrame | None = None) -> DataFrame:
    """Stand by date table: pixel metrics, persistence and, where given, crown, texture and
    spatial metrics, with support and the reasons of missing values."""
    keys = ["stand_id", "year"]
    first = previous_dates(pixels).select(*keys, F.col("prev_year").isNull().alias("_first"))
    out = zone_pixel_metrics(pixels, keys).join(gap_persistence(pixels), keys, "left").join(first, keys, "left")
    why = {"gap_persistence": F.when(F.col("_first"), "first date of the series, nothing to compare to")}
    for part, names, none in (
        (crowns and crown_stats(crowns, keys), ("crown_cv", "crown_mean", "crown_p90"), "no crown segmentation supplied"),
        (texture, ("glcm_texture",), "no image supplied"),
        (spatial, ("edge_density", "linearity_index", "row_directionality"), "no spatial metrics supplied"),
    ):
        if part is None:
            out = out.withColumns({n: F.lit(None).cast("double") for n in names})
            why |= {n: F.lit(none) for n in names}
            continue
        out = out.join(part, keys, "left")
        for n in names:
            reason = f"{n}_reason" if f"{n}_reason" in part.columns else "crown_reason" if n.startswith("crown") else None
            if reason:
                why[n] = F.col(reason)
    text = F.concat_ws("; ", *[F.concat(F.lit(f"{n}: "), why[n]) for n in sorted(why)])
    drop = [c for c in out.columns if c.endswith("_reason")] + ["_first"]
    return out.withColumn("unavailable", text).drop(*drop)


def metric_matrix(frame: DataFrame, metrics: Sequence[str], years: Sequence[int]) -> DataFrame:
    """One row per stand and metric, one column per date."""
    long = frame.unpivot(["stand_id", "year"], list(metrics), "metric", "value")
    return long.groupBy("stand_id", "metric").pivot("year", list(years)).agg(F.first("value", ignorenulls=True))


def join_satellite(stand: DataFrame, annual: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Attach the yearly satellite metrics to stand dates; both reason texts are kept.

    A metric defined in both tables is refused, and so is a second row of a stand-year.
    """
    keys, skip = ["stand_id", "year"], {"stand_id", "year", "area_m2", "satellite_unavailable"}
    names = list(metrics or [c for c in annual.columns if c not in skip and not c.startswith("sat_")])
    both = sorted(set(names) & set(stand.columns))
    if both:
        raise ValueError(f"Both tables define {both}; one metric name must mean one thing")
    carried = [*names, *[c for c in annual.columns if c.startswith("sat_")]]
    one = annual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in [*carried, "satellite_unavailable"]])
    out = stand.join(one, keys, "left")
    single = F.when(F.coalesce("_rows", F.lit(1)) == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("the satellite table has two rows of one stand and year")).cast("boolean")
    )
    text = F.concat_ws("; ", F.expr("nullif(unavailable, '')"), F.expr("nullif(satellite_unavailable, '')"))
    return out.where(single).withColumn("unavailable", text).drop("satellite_unavailable", "_rows")


# --- components of a stand after an event ---------------------------------------
COMPONENTS = {"residual": 1, "new_gap": 2, "preexisting_gap": 3}


def component_code(post: Column, reference: Column | None = None, canopy_m: float = P.CANOPY_M) -> Column:
    """1 residual canopy, 2 new gap, 3 gap before the event, null without data."""
    if reference is None:
        return F.when(post >= canopy_m, 1).when(post < canopy_m, 2)
    known = post.isNotNull() & reference.isNotNull()
    return F.when(known & (reference < canopy_m), 3).when(known & (post >= canopy_m), 1).when(known, 2)


def component_cells(pixels: DataFrame, post_year: Column | int, ref_year: Column | int | None) -> DataFrame:
    """Component of every cell of a stand, fixed from the first date after and the last before."""
    key = ["stand_id", "row", "col"]
    h, year = finite("height"), F.col("year")
    agg = pixels.groupBy(*key).agg(
        F.max(F.when(year == post_year, h)).alias("_post"),
        F.max(F.when(year == ref_year, h)).alias("_ref") if ref_year is not None else F.lit(None).cast("double").alias("_ref"),
    )
    code = component_code(F.col("_post"), F.col("_ref") if ref_year is not None else None)
    return agg.select(*key, code.alias("component")).where(F.col("component").isNotNull())


def component_stats(cells: DataFrame, keys: Sequence[str], *, canopy_m: float = P.CANOPY_M, min_pixels: int = P.MIN_CANOPY_PIXELS) -> DataFrame:
    """Height statistics per component and for the whole zone (component 0)."""
    keys = list(keys)
    both = cells.withColumn("component", F.explode(F.array(F.lit(0), F.col("component"))))
    by = [*keys, "component"]
    h = F.col("height")
    rows = both.where(h.isNotNull())
    canopy = F.when(h >= canopy_m, h)
    agg = rows.groupBy(*by).agg(
        F.count("height").alias("n_pixels"), share_where(h >= canopy_m).alias("canopy_fraction"),
        F.avg("height").alias("height_mean"), F.stddev_pop("height").alias("_sd"),
        F.count(canopy).alias("_nc"), F.avg(canopy).alias("_mc"), F.stddev_pop(canopy).alias("_sdc"),
    )
    q = exact_quantiles(rows, by, "height", {"height_median": 0.5, "height_p90": 0.9}, HEIGHT_WIDTH)
    qc = exact_quantiles(rows.where(h >= canopy_m), by, "height", {"canopy_height_median": 0.5, "canopy_height_p90": 0.9}, HEIGHT_WIDTH)
    enough, enough_c = F.col("n_pixels") >= min_pixels, (F.col("n_pixels") >= min_pixels) & (F.col("_nc") >= min_pixels)
    return agg.join(q, by, "left").join(qc, by, "left").select(
        *by, "n_pixels",
        *[F.when(enough, F.col(c)).alias(c) for c in ("canopy_fraction", "height_mean", "height_median", "height_p90")],
        F.when(enough, share(F.col("_sd"), F.col("height_mean"))).alias("height_cv"),
        *[F.when(enough_c, F.col(c)).alias(c) for c in ("canopy_height_median", "canopy_height_p90")],
        F.when(enough_c, share(F.col("_sdc"), F.col("_mc"))).alias("canopy_height_cv"),
    )


def variance_parts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total variance of heights as the sum of the parts within and between components."""
    keys = list(keys)
    part = cells.where(F.col("height").isNotNull()).groupBy(*keys, "component").agg(
        F.count("height").alias("n"), F.avg("height").alias("m"), F.var_pop("height").alias("v")
    )
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    agg = part.groupBy(*keys).agg(
        F.sum("n").alias("N"), (F.sum(n * m) / F.sum("n")).alias("mean"), F.sum(n * m * m).alias("q"),
        *[F.sum(F.when(F.col("component") == c, n * v)).alias(f"_w{c}") for c in COMPONENTS.values()],
    )
    between = F.greatest(F.lit(0.0), F.col("q") / F.col("N") - F.col("mean") * F.col("mean"))
    within = {name: F.col(f"_w{c}") / F.col("N") for name, c in COMPONENTS.items()}
    total = between
    for w in within.values():
        total = total + F.coalesce(w, F.lit(0.0))
    return agg.select(
        *keys, "mean", total.alias("total"), share(F.sqrt(total), F.col("mean")).alias("cv"),
        *[w.alias(f"within_{name}") for name, w in within.items()], between.alias("between"),
    )


def patch_table(cells: DataFrame, pixel_m: float, *, canopy_m: float = P.CANOPY_M) -> DataFrame:
    """Area, canopy share, median and p90 height per patch and year."""
    rows = cells.where(F.col("height").isNotNull())
    by = ["patch_id", "year"]
    agg = rows.groupBy(*by).agg(
        F.count("height").alias("n_pixels"), (F.count("height") * pixel_m**2).alias("area_m2"),
        share_where(F.col("height") >= canopy_m).alias("canopy_fraction"),
    )
    return agg.join(exact_quantiles(rows, by, "height", {"height_median": 0.5, "height_p90": 0.9}, HEIGHT_WIDTH), by)


def height_by_distance(cells: DataFrame, edges: Sequence[float], *, canopy_m: float = P.CANOPY_M, min_pixels: int = P.MIN_CANOPY_PIXELS) -> DataFrame:
    """Height statistics per distance bin ``[lo, hi)``; empty bins keep a row."""
    bins = list(zip(edges[:-1], edges[1:], strict=True))
    which = None
    for i, (lo, hi) in enumerate(bins):
        hit = (F.col("distance") >= lo) & (F.col("distance") < hi)
        which = F.when(hit, i) if which is None else which.when(hit, i)
    rows = cells.where(F.col("height").isNotNull()).withColumn("bin", which).where(F.col("bin").isNotNull())
    agg = rows.groupBy("bin").agg(F.count("height").alias("n"), share_where(F.col("height") >= canopy_m).alias("c"))
    q = exact_quantiles(rows, ["bin"], "height", {"q50": 0.5, "q90": 0.9}, HEIGHT_WIDTH)
    frame = cells.sparkSession.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(bins)], "bin int, bin_lo double, bin_hi double")
    ok = F.col("n") >= min_pixels
    return frame.join(agg, "bin", "left").join(q, "bin", "left").select(
        "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("n_pixels"), F.when(ok, F.col("c")).alias("canopy_fraction"),
        F.when(ok, F.col("q50")).alias("height_median"), F.when(ok, F.col("q90")).alias("height_p90"),
    )


# --- fixed windows -------------------------------------------------------------
def window_pixels(window_m: float, pixel_m: float) -> int:
    return max(1, round(window_m / pixel_m))


def window_metrics(pixels: DataFrame, sizes_m: Sequence[float], pixel_m: float, rows: int, cols: int, *, canopy_m: float = P.CANOPY_M) -> DataFrame:
    """Gap, crown and band shares per fixed window, for several window sizes at once.

    Partial windows at the right and lower edge are left out.
    """
    size = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("window_m"), F.lit(window_pixels(s, pixel_m)).alias("px")) for s in sizes_m]))
    tiled = pixels.select("*", size.alias("_w")).select(
        F.col("_w.window_m").alias("window_m"), F.floor(F.col("row") / F.col("_w.px")).cast("int").alias("wr"),
        F.floor(F.col("col") / F.col("_w.px")).cast("int").alias("wc"), F.col("_w.px").alias("px"), finite("height").alias("h"),
    )
    whole = (F.col("wr") < F.floor(F.lit(rows) / F.col("px"))) & (F.col("wc") < F.floor(F.lit(cols) / F.col("px")))
    valid = F.col("h").isNotNull()
    agg = tiled.where(whole & valid).groupBy("window_m", "wr", "wc")
    return agg.agg(F.count("h").alias("n_valid"), *pixel_aggregates(F.col("h"), canopy_m))


def window_crowns(crowns: DataFrame, window_m: float, origin: tuple[float, float], shape: tuple[int, int], *, min_crowns: int = 3) -> DataFrame:
    """Crown statistics per window; every window of the grid has a row, with count 0 where empty."""
    n_rows, n_cols = shape
    rc = window_of_point(F.col("x"), F.col("y"), origin, window_m, shape)
    placed = crowns.select(rc["row"].alias("wr"), rc["col"].alias("wc"), "crown_diam_m").where(F.col("wr") >= 0)
    stats = crown_stats(placed, ["wr", "wc"], min_crowns=min_crowns)
    spark = crowns.sparkSession
    frame = spark.range(n_rows * n_cols).select((F.col("id") / n_cols).cast("int").alias("wr"), (F.col("id") % n_cols).cast("int").alias("wc"))
    out = frame.join(stats, ["wr", "wc"], "left")
    return out.select("wr", "wc", F.coalesce("crown_count", F.lit(0)).alias("crown_count"), "crown_cv", "crown_p90", "crown_mean", "crown_median", "crown_std")


def window_of_point(x: Column, y: Column, origin: tuple[float, float], window_m: float, shape: tuple[int, int]) -> Column:
    """Window row and column of a point, -1 for both outside the grid."""
    col, row = F.floor((x - origin[0]) / window_m), F.floor((F.lit(origin[1]) - y) / window_m)
    inside = (col >= 0) & (col < shape[1]) & (row >= 0) & (row < shape[0])
    return F.struct(F.when(inside, row).otherwise(-1).cast("int").alias("row"), F.when(inside, col).otherwise(-1).cast("int").alias("col"))


def metric_delta(a: DataFrame, b: DataFrame, value: str = "value", keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Difference of two metric layers; layers that are not on the same cells are refused."""
    keys = list(keys)
    left, right = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia")), b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    aligned = F.when(F.col("_ia").isNotNull() & F.col("_ib").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit("the two layers are not aligned")).cast("boolean")
    )
    return left.join(right, keys, "full").where(aligned).select(*keys, (F.col("_a") - F.col("_b")).alias("delta"))


# --- registries of metrics -------------------------------------------------------
class Registry:
    """Named builders of column expressions with merged defaults; a second registration is refused."""

    def __init__(self, defaults: Mapping[str, object] | None = None) -> None:
        self._defaults, self._items = dict(defaults or {}), {}

    def register(self, name: str, **params):
        def add(fn):
            if name in self._items:
                raise ValueError(f"{name!r} is registered twice")
            self._items[name] = (fn, params)
            return fn

        return add

    def names(self) -> list[str]:
        return sorted(self._items)

    def build(self, name: str, **override) -> Column:
        if name not in self._items:
            raise KeyError(f"Unknown metric {name!r}. Known: {self.names()}")
        fn, params = self._items[name]
        return fn(**{**self._defaults, **params, **override}).alias(name)


METRICS = Registry({"height": "height", "canopy_m": P.CANOPY_M})
DELTAS = Registry({"by": "stand_id", "order": "year"})


@METRICS.register("gap_fraction")
def _gap(height, canopy_m, **_):
    return share_where(F.col(height) < canopy_m)


@METRICS.register("crown_fraction")
def _crown(height, canopy_m, **_):
    return share_where(F.col(height) >= canopy_m)


for _name, (_lo, _hi) in P.HEIGHT_BANDS.items():

    @METRICS.register(_name, lo=_lo, hi=_hi)
    def _band(height, lo, hi, **_):
        return share_where((F.col(height) >= lo) & (F.col(height) < hi))


for _name in ("crown_fraction", "gap_fraction", "crown_p90", "crown_count", "edge_density"):

    @DELTAS.register(f"delta_{_name}", metric=_name)
    def _delta(metric, by, order, **_):
        return F.col(metric) - F.lag(metric).over(W.partitionBy(by).orderBy(order))


def registered_metrics(pixels: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None, **params) -> DataFrame:
    """All named metrics of a group in one aggregation."""
    valid = pixels.where(holds(finite(params.get("height", "height")).isNotNull()))
    return valid.groupBy(*keys).agg(*[METRICS.build(n, **params) for n in (names or METRICS.names())])
