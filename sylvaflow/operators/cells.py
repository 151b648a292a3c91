"""Cells: block aggregates, change over dates, moving windows and neighbourhoods.

A cell table has one row per cell of a grid and date, with nulls for missing
values. Moving sums and kernels are separable: one window along the row, one
along the column, so a task holds a row or column of a grid and never a whole
date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, cos, exp, pi, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaflow import params as P
from sylvaflow.functions.columns import finite, holds
from sylvaflow.operators.ranks import exact_quantiles, join_groups, robust_stats
from sylvaflow.session import cut_lineage

DATE = ["unit", "t"]
CELL = ["unit", "row", "col"]


def densify(cells: DataFrame, rows: int, cols: int, dates: DataFrame) -> DataFrame:
    """A row for every cell of a ``rows`` x ``cols`` grid at every (unit, t) of ``dates``."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    frame = dates.select(*DATE, grid.alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    return frame.join(cells, [*DATE, "row", "col"], "left")


# --- pixels to cells -------------------------------------------------------------
def block_aggregate(
    pixels: DataFrame, block_px: int, keys: Sequence[str] = ("unit", "year"), *, height_m: float = P.FOREST_HEIGHT_M,
    min_valid_share: float = P.MIN_VALID_SHARE, bands: bool = False,
) -> DataFrame:
    """Mean height, cover and valid share per block of pixels, null under the valid share.

    With ``bands`` also the mean pixel NDVI of ``red`` and ``nir`` under the same rule.
    """
    h = finite("height")
    size = float(block_px * block_px)
    aggs = [F.count(h).alias("_n"), F.avg(h).alias("_h"), F.avg(F.when(h > height_m, 1.0).when(h.isNotNull(), 0.0)).alias("_c")]
    if bands:
        red, nir = finite("red"), finite("nir")
        ndvi = F.when((red + nir) > 0, (nir - red) / F.greatest(red + nir, F.lit(1.0)))
        aggs += [F.count(ndvi).alias("_nn"), F.avg(ndvi).alias("_ndvi")]
    out = pixels.groupBy(*keys, F.floor(F.col("row") / block_px).cast("int").alias("row"), F.floor(F.col("col") / block_px).cast("int").alias("col")).agg(*aggs)
    enough = F.col("_n") / size >= min_valid_share
    cols = [F.when(enough, F.col("_h")).alias("chm_height"), F.when(enough, F.col("_c")).alias("chm_cover"), (F.col("_n") / size).alias("valid_share")]
    if bands:
        cols.append(F.when(F.col("_nn") / size >= min_valid_share, F.col("_ndvi")).alias("ndvi"))
    return out.select(*keys, "row", "col", *cols)


def band_mean_ndvi(pixels: DataFrame, block_px: int, keys: Sequence[str], *, min_share: float = 0.5) -> DataFrame:
    """NDVI of the band means of a cell; a pixel that is zero in all bands is unseen."""
    seen = (F.col("red") != 0) | (F.col("nir") != 0) | (F.coalesce(F.col("other"), F.lit(0)) != 0)
    out = pixels.groupBy(*keys, F.floor(F.col("row") / block_px).cast("int").alias("row"), F.floor(F.col("col") / block_px).cast("int").alias("col")).agg(
        F.count(F.when(seen, 1)).alias("_n"), F.sum(F.when(seen, F.col("red"))).alias("_r"), F.sum(F.when(seen, F.col("nir"))).alias("_i")
    )
    r, i = F.col("_r"), F.col("_i")
    ok = (F.col("_n") >= min_share * block_px * block_px) & (r + i > 0)
    return out.select(*keys, "row", "col", F.when(ok, (i - r) / (i + r)).alias("ndvi"))


def never_green(ndvi: DataFrame, threshold: float) -> DataFrame:
    """Cells known on all dates whose highest NDVI stays under the threshold."""
    agg = ndvi.groupBy(*CELL).agg(F.bool_and(F.col("ndvi").isNotNull()).alias("_k"), F.max("ndvi").alias("_m"))
    return agg.where(F.col("_k") & (F.col("_m") < threshold)).select(*CELL)


def pool_labels(pixels: DataFrame, keys: Sequence[str], rule: Mapping = P.POOLING) -> DataFrame:
    """Pooled change (255 unlabelled, 0, 1, 2) and most common agent of groups of label pixels."""
    keys = list(keys)
    agg = pixels.groupBy(*keys, "change", "agent").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    of = lambda c: F.sum(F.when(F.col("change") == c, n).otherwise(0))
    known = F.when(F.col("agent") != P.IGNORE, F.col("agent"))
    by_agent = agg.groupBy(*keys, "agent").agg(F.sum("n").alias("n"))
    top = by_agent.groupBy(*keys).agg(F.min_by(F.when(known.isNotNull(), F.col("agent")), F.when(known.isNotNull(), F.struct(-F.col("n"), F.col("agent")))).alias("_agent"))
    out = agg.groupBy(*keys).agg(of(P.IGNORE).alias("_i"), of(0).alias("_b"), of(1).alias("_p"), of(2).alias("_f"), F.sum("n").alias("_n")).join(top, keys)
    lab, part, full = F.col("_b") + F.col("_p") + F.col("_f"), F.col("_p"), F.col("_f")
    usable = (F.col("_i") / F.col("_n") < rule["ignore_share"]) & (lab > 0)
    loss = (part + full) / F.greatest(lab, F.lit(1))
    change = (
        F.when(usable & (loss >= rule["loss_share"]), F.when(full >= part, 2).otherwise(1))
        .when(usable & (loss <= rule["background_share"]), 0)
        .otherwise(P.IGNORE)
    )
    return out.withColumn("pooled", change).select(
        *keys, "pooled", F.when(F.col("pooled").isin(1, 2), F.coalesce("_agent", F.lit(P.IGNORE))).otherwise(P.IGNORE).alias("agent")
    )


# --- forest masks --------------------------------------------------------------------
def forest_flag(cover: Column, min_cover: float = P.FOREST_MIN_COVER) -> Column:
    return holds(cover >= min_cover)


def over_dates(cell: Sequence[str] = CELL, date: str = "t") -> object:
    return W.partitionBy(*cell).orderBy(date)


def date_index(df: DataFrame, year: str = "year") -> DataFrame:
    """Index of each date among the dates of the unit."""
    dates = df.select("unit", year).distinct()
    t = F.row_number().over(W.partitionBy("unit").orderBy(year)) - 1
    return df.join(dates.withColumn("t", t), ["unit", year])


def monitored_flags(cells: DataFrame, forest: str = "forest") -> DataFrame:
    """Monitored if forest at the date before; the population also takes the first date."""
    before = F.lag(forest).over(over_dates())
    return cells.withColumns({
        "monitored": holds(before),
        "population": F.when(F.col("t") == 0, F.col(forest)).otherwise(holds(before)),
    })


def fill_dips(cells: DataFrame, forest: str = "forest") -> DataFrame:
    """A single non-forest date between two forest dates becomes forest."""
    w = over_dates()
    f = F.col(forest)
    return cells.withColumn(forest, f | (holds(F.lag(forest).over(w)) & holds(F.lead(forest).over(w))))


def unstable_intervals(cells: DataFrame, threshold: float = P.RULES["unstable_change"], forest: str = "forest") -> DataFrame:
    """Intervals in which the forest area of the unit changes by more than a share."""
    area = cells.groupBy(*DATE).agg(F.sum(F.col(forest).cast("int")).alias("area"))
    before = F.lag("area").over(W.partitionBy("unit").orderBy("t"))
    change = F.when(F.col("_b") > 0, F.abs(F.col("area") - F.col("_b")) / F.col("_b")).otherwise(1.0)
    return area.withColumn("_b", before).where("_b IS NOT NULL").select("unit", (F.col("t") - 1).alias("k"), "area", (change > threshold).alias("unstable"))


def combine_masks(chm: Column, ndvi: Column, rule: str) -> Column:
    """Coded masks (1 forest, 0 none, 255 unknown) by rule chm, ndvi, and, or."""
    if rule in ("chm", "ndvi"):
        return chm if rule == "chm" else ndvi
    both = (chm == 1) & (ndvi == 1) if rule == "and" else (chm == 1) | (ndvi == 1)
    return F.when((chm == P.BYTE_NODATA) | (ndvi == P.BYTE_NODATA), P.BYTE_NODATA).otherwise(both.cast("int"))


def coded_mask(value: Column, threshold: float | Column, *, strict: bool = False) -> Column:
    test = value > threshold if strict else value >= threshold
    return F.when(value.isNull(), P.BYTE_NODATA).otherwise(test.cast("int"))


def stable_forest(masks: DataFrame) -> DataFrame:
    """Forest in all years, number of forest years; no data if any year has none."""
    m = F.col("mask")
    agg = masks.groupBy(*CELL).agg(
        F.bool_or(m == P.BYTE_NODATA).alias("_x"), F.bool_and(m == 1).alias("_f"), F.sum((m == 1).cast("int")).alias("n_forest_years")
    )
    return agg.select(*CELL, F.when(F.col("_x"), P.BYTE_NODATA).otherwise(F.col("_f").cast("int")).alias("stable"), "n_forest_years")


def reference_stats(values: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Median and scaled MAD of reference cells; the scale is 1 when the MAD is zero."""
    med = cut_lineage(exact_quantiles(values, keys, value, {"median": 0.5}, width))
    dev = join_groups(values, med, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_d"))
    mad = exact_quantiles(dev, keys, "_d", {"mad": 0.5}, width)
    s = F.col("mad") * P.MAD_SCALE
    return med.join(mad, list(keys)).select(*keys, "median", F.when(s > 0, s).otherwise(1.0).alias("scale"))


def otsu_threshold(values: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Threshold that maximizes the between-class variance of a histogram over the value range."""
    keys = list(keys)
    v = F.col(value)
    rows = values.where(v.isNotNull()).select(*keys, value)
    span = cut_lineage(rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    index = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    hist = join_groups(rows, span, keys).where(F.col("hi") > F.col("lo")).groupBy(*keys, index.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    centre = F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    hist = hist.withColumn("c", centre)
    low = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    high = W.partitionBy(*keys).orderBy("b").rowsBetween(1, W.unboundedFollowing)
    hist = hist.select(
        *keys, "b", "c", F.sum("n").over(low).alias("w1"), F.sum("n").over(high).alias("w2"),
        (F.sum(F.col("n") * F.col("c")).over(low)).alias("m1"), (F.sum(F.col("n") * F.col("c")).over(high)).alias("m2"),
    )
    gap = F.col("m1") / F.col("w1") - F.col("m2") / F.col("w2")
    var = F.col("w1") * F.col("w2") * gap * gap
    best = hist.where("w2 IS NOT NULL").groupBy(*keys).agg(F.max_by("c", F.struct(F.round(var, 6), -F.col("b"))).alias("threshold"))
    return best


# --- change over dates -----------------------------------------------------------------
def change_layer(cells: DataFrame, value: str) -> DataFrame:
    """Change to the previous date and the two-step changes that end and centre at the date."""
    w = over_dates()
    x = F.col(value)
    two = F.lag(value, 2).over(w)
    return cells.withColumns({
        "change": x - F.lag(value, 1).over(w),
        "back": x - two,
        "forward": F.lead(value, 1).over(w) - F.lag(value, 1).over(w),
    })


def onset(flags: DataFrame, flag: str = "flag", year: str = "year") -> DataFrame:
    """First flagged date of every cell: its index and year, 0 none, -1 never monitored."""
    f = F.col(flag)
    agg = flags.groupBy(*CELL).agg(
        F.min(F.when(f, F.col("t"))).alias("_t"), F.min_by(year, F.when(f, F.col("t"))).alias("_y"),
        F.bool_or(F.col("monitored") & (F.col("t") > 0)).alias("_m"),
    )
    code = F.when(F.col("_t").isNotNull(), F.col("_y")).when(F.col("_m"), 0).otherwise(-1)
    return agg.select(*CELL, F.coalesce("_t", F.lit(-1)).alias("onset_index"), code.cast("int").alias("onset_year"))


def history(cells: DataFrame, value: str, where: str) -> DataFrame:
    """Count, mean and sample variance of a cell over earlier dates."""
    w = over_dates().rowsBetween(W.unboundedPreceding, -1)
    x = F.when(F.col(where), F.col(value))
    n = F.count(x).over(w)
    return cells.withColumns({
        "hist_n": n, "hist_mean": F.avg(x).over(w),
        "hist_var": F.when(n >= 2, F.greatest(F.lit(0.0), F.var_samp(x).over(w))),
    })


def shrunk_sd(hist: DataFrame, population: str, *, prior_df: float = 2.0, min_pop: int = P.MIN_POPULATION, width: float = 1 / 16) -> DataFrame:
    """Deviation of a cell's history, its variance shrunk to the median of the population per date."""
    pool = hist.where(F.col(population) & F.col("hist_var").isNotNull())
    median = exact_quantiles(pool, DATE, "hist_var", {"s0": 0.5}, width)
    size = pool.groupBy(*DATE).agg(F.count(F.lit(1)).alias("_p")).where(F.col("_p") >= min_pop)
    df = F.greatest(F.col("hist_n") - 1, F.lit(0))
    sd = F.sqrt((df * F.col("hist_var") + prior_df * F.col("s0")) / (df + prior_df))
    return join_groups(hist, cut_lineage(median.join(size, DATE)), DATE, "left").withColumn("hist_sd", sd).drop("s0", "_p")


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def expit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


LFDR_CLIP = (1e-4, 1.0 - 1e-4)


def confirm_next(cells: DataFrame, prior: float, llr: str = "llr") -> DataFrame:
    """Posterior from the log-likelihood ratio of this and the next date."""
    base = logit(F.lit(min(max(prior, LFDR_CLIP[0]), LFDR_CLIP[1])))
    nxt = F.coalesce(F.lead(llr).over(over_dates()), F.lit(0.0))
    return cells.withColumn("confirmed", expit(base + F.col(llr) + nxt))


def accumulate(cells: DataFrame, prior: float, *, decay: float = 1.0, llr: str = "llr") -> DataFrame:
    """Running evidence of a cell over its dates with the start of the current run.

    One row per cell with arrays in date order: ``prob`` and ``onset`` (-1 when the
    evidence is not positive). The dates of a cell are few, so the fold is one array expression.
    """
    base = logit(F.lit(min(max(prior, LFDR_CLIP[0]), LFDR_CLIP[1])))
    seq = F.array_sort(F.collect_list(F.struct("t", F.coalesce(F.col(llr), F.lit(0.0)).cast("double").alias("x"), holds(F.col("monitored")).alias("m"))))
    agg = cells.groupBy(*CELL).agg(seq.alias("seq"))

    def step(acc: Column, e: Column) -> Column:
        carry = F.greatest(F.lit(0.0), decay * acc["s"])
        start = F.when(carry <= 0, e["t"]).otherwise(acc["start"])
        s = carry + e["x"]
        item = F.struct(s.alias("s"), F.when(s > 0, start).otherwise(-1).alias("onset"))
        return F.struct(s.alias("s"), start.cast("int").alias("start"), F.concat(acc["out"], F.array(item)).alias("out"))

    zero = F.expr("named_struct('s', 0D, 'start', -1, 'out', CAST(array() AS array<struct<s:double,onset:int>>))")
    run = F.aggregate("seq", zero, step, lambda acc: acc["out"])
    out = agg.withColumn("run", run)
    return out.select(*CELL, "seq", F.transform("run", lambda r: expit(base + r["s"])).alias("prob"), F.transform("run", lambda r: r["onset"]).alias("onset"))


def first_accumulated(runs: DataFrame, p_detect: float = 0.5) -> DataFrame:
    """Onset of the first date whose run is probable and started on a monitored date, else -1."""
    idx = F.sequence(F.lit(0), F.size("prob") - 1)
    start_ok = lambda i: (F.get("onset", i) >= 0) & F.get("seq", F.get("onset", i))["m"]
    hits = F.filter(idx, lambda i: holds(start_ok(i)) & (F.get("prob", i) > p_detect))
    return runs.select(*CELL, F.coalesce(F.get("onset", F.get(hits, F.lit(0))), F.lit(-1)).alias("first_onset"))


def stouffer(zs: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    w = list(weights or [1.0] * len(zs))
    total = sum((F.lit(wi) * z for wi, z in zip(w, zs, strict=True)), F.lit(0.0))
    return total / F.lit(sum(wi * wi for wi in w) ** 0.5)


# --- standardization ---------------------------------------------------------------------
Z_WIDTH = 1 / 64


def scene_z(cells: DataFrame, value: str, population: str, *, robust: bool = True, out: str = "z", width: float = Z_WIDTH) -> DataFrame:
    """z against the population of the date: median and MAD, or mean and deviation."""
    pop = cells.where(F.col(population))
    if robust:
        stats = robust_stats(pop, DATE, value, width, min_rows=P.MIN_POPULATION, scale=P.MAD_SCALE)
    else:
        stats = pop.groupBy(*DATE).agg(F.count(value).alias("n"), F.avg(value).alias("centre"), F.stddev_pop(value).alias("scale"))
        stats = cut_lineage(stats.where((F.col("n") >= P.MIN_POPULATION) & (F.col("scale") > 0)))
    z = (F.col(value) - F.col("centre")) / F.col("scale")
    return join_groups(cells, stats.select(*DATE, "centre", "scale"), DATE, "left").withColumn(out, z).drop("centre", "scale")


def history_z(cells: DataFrame, value: str, population: str, method: str, *, prior_df: float = 2.0) -> DataFrame:
    """Methods against a cell's own earlier dates: ``pixmean`` and ``pixz``."""
    hist = history(cells, value, population)
    if method == "pixmean":
        hist = hist.withColumn("_a", F.when(F.col("hist_n") >= 1, F.col(value) - F.col("hist_mean")))
    elif method == "pixz":
        hist = shrunk_sd(hist, population, prior_df=prior_df)
        hist = hist.withColumn("_a", F.when(F.col("hist_n") >= 2, F.try_divide(F.col(value) - F.col("hist_mean"), F.col("hist_sd"))))
    else:
        raise ValueError(f"Unknown method {method!r}")
    return scene_z(hist, "_a", population).drop("_a", "hist_sd", "hist_n", "hist_mean", "hist_var")


def box_sums(cells: DataFrame, columns: Mapping[str, Column], size: int) -> DataFrame:
    """Sum of each column over a moving square of ``size`` cells; outside the grid counts as zero.

    For an even size the window reaches one cell further to the lower side.
    """
    lo, hi = size // 2, size - 1 - size // 2
    block = max(ROW_BLOCK, 4 * size)
    at = lambda shift: F.floor((F.col("row") + shift) / block)
    along = W.partitionBy(*DATE, "row").orderBy("col").rangeBetween(-lo, hi)
    # blocks of rows come with the rows their windows reach, so a column is no task
    across = W.partitionBy(*DATE, "_b", "col").orderBy("row").rangeBetween(-lo, hi)
    first = cells.withColumns({f"_x_{n}": F.coalesce(c, F.lit(0.0)) for n, c in columns.items()})
    first = first.withColumns({f"_x_{n}": F.sum(f"_x_{n}").over(along) for n in columns})
    first = first.withColumn("_own", at(0)).withColumn("_b", F.explode_outer(F.sequence(at(-hi), at(lo))))
    second = first.withColumns({n: F.sum(f"_x_{n}").over(across) for n in columns})
    return second.where(F.col("_own").eqNullSafe(F.col("_b"))).drop("_own", "_b", *[f"_x_{n}" for n in columns])


def local_z(cells: DataFrame, value: str, population: str, size: int, *, rule: Mapping = P.LOCAL, out: str = "z", width: float = Z_WIDTH) -> DataFrame:
    """z against mean and deviation of trimmed population cells in a moving square.

    The deviation has a floor relative to the scene; thin windows fall back on the scene.
    """
    stats = robust_stats(cells.where(F.col(population)), DATE, value, width, min_rows=P.MIN_POPULATION, scale=P.MAD_SCALE)
    df = join_groups(cells, stats.select(*DATE, "centre", "scale"), DATE, "left")
    v, centre, scale = F.col(value), F.col("centre"), F.col("scale")
    use = holds(F.col(population) & v.isNotNull() & (F.abs((v - centre) / scale) <= rule["trim_z"]))
    x = F.when(use, v)
    df = box_sums(df, {"_w": F.when(use, 1.0), "_s": x, "_q": x * x}, size)
    frac = F.col("_w") / float(size * size)
    mean = F.when(F.col("_w") > 0, F.col("_s") / F.col("_w"))
    var = F.when(F.col("_w") > 0, F.col("_q") / F.col("_w")) - mean * mean
    sd = F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), rule["sd_floor"] * scale)
    thin = (frac < rule["min_frac"]) | ~holds(sd > 0)
    z = (v - F.when(thin, centre).otherwise(mean)) / F.when(thin, scale).otherwise(sd)
    return df.withColumn(out, z).drop("_w", "_s", "_q", "centre", "scale")


def kernel(sigma: float) -> list[float]:
    """Half of a normalized Gaussian kernel: weights of offsets 0 to ``int(4 sigma + 0.5)``."""
    radius = int(4.0 * sigma + 0.5)
    raw = [exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [r / total for r in raw]


_NO_PLACE = -(1 << 62)


def _place(table: pa.Table, name: str) -> np.ndarray:
    """A coordinate as whole numbers; cells without one come first."""
    return table[name].cast(pa.int64()).fill_null(_NO_PLACE).to_numpy()


def _weighted(table: pa.Table, names: Mapping[str, Sequence[float]], line: np.ndarray, order: np.ndarray) -> dict[str, np.ndarray]:
    """Kernel sums along lines of cells in the given order, zero beyond the ends of a line."""
    line = line[order]
    ahead = [line[k:] == line[:-k] for k in range(1, min(max(map(len, names.values())), len(line)))]
    out = {}
    for name, weights in names.items():
        x = table[name].to_numpy()[order]
        total = x * weights[0]
        for k, (w, same) in enumerate(zip(weights[1:], ahead), start=1):
            both = np.zeros(len(x))
            both[k:] += np.where(same, x[:-k], 0.0)
            both[:-k] += np.where(same, x[k:], 0.0)
            total += w * both
        out[name] = np.empty(len(x))
        out[name][order] = total
    return out


def convolve(cells: DataFrame, columns: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """Gaussian sums ``name -> (column, sigma)`` over a complete grid, zero outside.

    All columns share one pass along the rows and one along the columns. Neighbours are the
    cells next in a line. The first pass reads blocks of rows and numbers the cells of every
    column; the second one reads blocks of these numbers with the reach of the kernel on both
    sides, so a task never holds a whole column.
    """
    names = list(cells.columns)
    weights = {f"_k_{n}": kernel(s) for n, (_c, s) in columns.items()}
    reach = max(map(len, weights.values())) - 1
    size = max(ROW_BLOCK, 4 * reach)
    rows = F.floor(F.col("row") / size)
    df = cells.withColumns({**{f"_k_{n}": F.coalesce(c, F.lit(0.0)).cast("double") for n, (c, _s) in columns.items()}, "_b": rows})
    counts = cells.groupBy(*DATE, rows.alias("_b"), "col").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*DATE, "col").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*DATE, "_b", "col", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbers = [T.StructField(f"_k_{n}", T.DoubleType()) for n in columns]
    kept = [*names, *weights]

    def sums(table: pa.Table, line: np.ndarray, order: np.ndarray) -> pa.Table:
        out = table.select(names)
        for name, x in _weighted(table, weights, line, order).items():
            out = out.append_column(name, pa.array(x))
        return out

    def along(both: pa.Table) -> pa.Table:
        is_start = both["_before"].is_valid()
        start, table = both.filter(is_start), both.filter(pc.invert(is_start))
        row, col = _place(table, "row"), _place(table, "col")
        order = np.lexsort((row, col))
        c = col[order]
        new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        first = _place(start, "col")
        by = np.argsort(first)
        before = start["_before"].to_numpy()[by][np.searchsorted(first[by], c[new])]
        length = np.diff(np.r_[new, len(c)])
        at = np.empty(len(c), dtype="int64")
        at[order] = np.arange(len(c)) - np.repeat(new - before, length)
        return sums(table, row, np.lexsort((col, row))).append_column("_at", pa.array(at))

    def across(table: pa.Table) -> pa.Table:
        col, at = _place(table, "col"), table["_at"].to_numpy()
        return sums(table, col, np.lexsort((at, col))).filter(pc.equal(table["_own"], table["_b"]))

    field = cells.schema.fields
    first = df.unionByName(starts, allowMissingColumns=True).groupBy(*DATE, "_b").applyInArrow(along, T.StructType([*field, *numbers, T.StructField("_at", T.LongType())]))
    block = lambda shift: F.floor((F.col("_at") + shift) / size)
    wide = first.select(*kept, "_at", block(0).alias("_own")).withColumn("_b", F.explode(F.sequence(block(-reach), block(reach))))
    second = wide.groupBy(*DATE, "_b").applyInArrow(across, T.StructType([*field, *numbers]))
    return second.select(*names, *[F.col(f"_k_{n}").alias(n) for n in columns])


def smooth_fields(cells: DataFrame, fields: Mapping[str, tuple[Column, Column, float]]) -> DataFrame:
    """Gaussian means over valid cells: ``out -> (value, use, sigma)``, null where not in use."""
    use = {n: holds(u & v.isNotNull()) for n, (v, u, _s) in fields.items()}
    parts = {}
    for n, (v, _u, s) in fields.items():
        parts[f"_n_{n}"] = (F.when(use[n], v), s)
        parts[f"_d_{n}"] = (F.when(use[n], 1.0), s)
    df = convolve(cells, parts)
    return df.withColumns({n: F.when(use[n], F.col(f"_n_{n}") / F.col(f"_d_{n}")) for n in fields}).drop(*parts)


def smooth_z(cells: DataFrame, z: str, where: str, sigma: float, out: str) -> DataFrame:
    """Gaussian mean over valid cells of a complete grid (normalized convolution)."""
    return smooth_fields(cells, {out: (F.col(z), F.col(where), sigma)})


def residual_z(cells: DataFrame, *, n_bins: int = 10, min_reference: int = 200, keys: Sequence[str] = ("unit", "k"), width: float = Z_WIDTH) -> DataFrame:
    """z of the later greenness given the decile of the earlier one among reference cells.

    Columns ``pre``, ``post`` and ``reference``; bins under 5 reference cells, and groups
    under ``min_reference``, have no z.
    """
    keys = list(keys)
    ok = F.col("reference") & F.col("pre").isNotNull() & F.col("post").isNotNull()
    probs = {f"e{i}": i / n_bins for i in range(1, n_bins)}
    edges = exact_quantiles(cells.where(ok), keys, "pre", probs, width)
    size = cells.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_reference)
    index = F.lit(0)
    for name in probs:
        index = index + (F.col("pre") >= F.col(name)).cast("int")
    df = join_groups(cells, cut_lineage(edges.join(size, keys)), keys, "left").withColumn("bin", index).drop(*probs, "_n")
    by = [*keys, "bin"]
    ref = df.where(ok & F.col("bin").isNotNull())
    med = cut_lineage(exact_quantiles(ref, by, "post", {"median": 0.5}, width))
    dev = join_groups(ref, med, by).select(*by, F.abs(F.col("post") - F.col("median")).alias("_d"))
    mad = exact_quantiles(dev, by, "_d", {"mad": 0.5}, width)
    many = ref.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= 5)
    stats = cut_lineage(med.join(mad, by).join(many.select(*by), by))
    z = F.when(F.col("pre").isNotNull(), (F.col("post") - F.col("median")) / (F.col("mad") * P.MAD_SCALE + 1e-4))
    return join_groups(df, stats, by, "left").withColumn("z", z).drop("median", "mad", "bin")


# --- neighbourhoods -------------------------------------------------------------------------
def square(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)]


def disk(radius: float) -> list[tuple[int, int]]:
    n = int(radius + 1e-9)
    return [(r, c) for r, c in square(n) if r * r + c * c <= radius * radius + 1e-9]


def shifted(cells: DataFrame, offsets: Sequence[tuple[int, int]], *extra: Column) -> DataFrame:
    """Every cell copied to its targets ``(row + dr, col + dc)``."""
    moves = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets]))
    return cells.select("*", moves.alias("_o"), *extra).withColumns({"row": F.col("row") + F.col("_o.dr"), "col": F.col("col") + F.col("_o.dc")})


def dilate(cells: DataFrame, offsets: Sequence[tuple[int, int]], keys: Sequence[str] = DATE) -> DataFrame:
    """Cell set grown by an offset set."""
    return shifted(cells.select(*keys, "row", "col"), offsets).select(*keys, "row", "col").distinct()


def erode(cells: DataFrame, offsets: Sequence[tuple[int, int]], keys: Sequence[str] = DATE) -> DataFrame:
    """Cells whose whole neighbourhood is in the set."""
    hits = shifted(cells.select(*keys, "row", "col"), [(-r, -c) for r, c in offsets]).groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_n"))
    return hits.where(F.col("_n") == len(offsets)).select(*keys, "row", "col")


def within(cells: DataFrame, seeds: DataFrame, pixels: float, keys: Sequence[str] = DATE) -> DataFrame:
    """Cells at most ``pixels`` away from a seed."""
    near = dilate(seeds, disk(pixels) if pixels > 0 else [(0, 0)], keys)
    return cells.join(near, [*keys, "row", "col"], "left_semi")


ROW_BLOCK = 256


def _column_gap(seed: np.ndarray, above: np.ndarray, below: np.ndarray, first: int) -> np.ndarray:
    """Rows to the nearest seed of the same column for a block that begins at row ``first``.

    ``above`` and ``below`` hold the nearest seed row of each column outside the block, infinite where there is none.
    """
    at = np.arange(first, first + len(seed), dtype="float64")[:, None]
    up = np.maximum.accumulate(np.vstack([above, np.where(seed, at, -np.inf)]), axis=0)[1:]
    down = np.minimum.accumulate(np.vstack([np.where(seed, at, np.inf), below])[::-1], axis=0)[::-1][:-1]
    return np.minimum(at - up, down - at)


def distance_to(cells: DataFrame, seed: Column, keys: Sequence[str] = DATE) -> DataFrame:
    """Exact Euclidean distance in cells to the nearest seed cell, null only where the grid has none.

    Column pass: the first and last seed row of every column and block of rows, carried from
    block to block, then nearest seed above and below inside a block. Row pass: the smallest
    combination over the columns of the row; the reach grows until it exceeds the largest
    distance that is left. A task holds blocks of rows, never a whole column. Needs a complete grid.
    """
    keys, names = list(keys), cells.columns
    df = cells.withColumns({"_s": holds(seed), "_b": F.floor(F.col("row") / ROW_BLOCK)})
    at = F.when(F.col("_s"), F.col("row"))
    blocks = df.groupBy(*keys, "_b", "col").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    line = W.partitionBy(*keys, "col").rowsBetween(W.unboundedPreceding, -1)
    outside = blocks.select(
        *keys, "_b", "col", F.last("_last", ignorenulls=True).over(line.orderBy("_b")).cast("double").alias("_above"),
        F.last("_first", ignorenulls=True).over(line.orderBy(F.col("_b").desc())).cast("double").alias("_below"),
    )
    schema = T.StructType([*cells.schema.fields, T.StructField("distance", T.DoubleType())])

    def across(both: pa.Table) -> pa.Table:
        is_edge = both["_s"].is_null()
        edge, table = both.filter(is_edge), both.filter(pc.invert(is_edge))
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        first, left = row.min(), col.min()
        y, x = row - first, col - left
        shape = (y.max() + 1, x.max() + 1)
        seeds = np.zeros(shape, bool)
        here = table["_s"].to_numpy()
        seeds[y[here], x[here]] = True
        above, below = np.full(shape[1], -np.inf), np.full(shape[1], np.inf)
        place = edge["col"].to_numpy() - left
        above[place] = edge["_above"].fill_null(-np.inf).to_numpy()
        below[place] = edge["_below"].fill_null(np.inf).to_numpy()
        field = np.full(shape, np.inf)
        field[y, x] = _column_gap(seeds, above, below, first)[y, x] ** 2
        best = field.copy()
        some = np.isfinite(field).any(axis=1)
        for k in range(1, field.shape[1]):
            if not some.any() or k * k >= best[some].max():
                break
            best[:, k:] = np.minimum(best[:, k:], field[:, :-k] + k * k)
            best[:, :-k] = np.minimum(best[:, :-k], field[:, k:] + k * k)
        out = np.sqrt(best[y, x])
        return table.select(names).append_column("distance", pa.array(out, mask=~np.isfinite(out)))

    return df.unionByName(outside, allowMissingColumns=True).groupBy(*keys, "_b").applyInArrow(across, schema)


def distances(cells: DataFrame, seeds: Mapping[str, Column], reach: int, keys: Sequence[str] = DATE) -> DataFrame:
    """Exact distance in cells to the nearest seed of every mask, null beyond ``reach``.

    Blocks of rows come with ``reach`` rows more on both sides, and a row looks at most
    ``reach`` columns to both sides: one shuffle, and the work does not grow with the area of
    a disk or the height of the grid. Needs a complete grid.
    """
    keys, reach = list(keys), int(reach)
    size = max(ROW_BLOCK, 4 * reach)
    names = list(seeds)
    block = lambda shift: F.floor((F.col("row") + shift) / size)
    df = cells.withColumns({**{f"_s_{n}": holds(seed) for n, seed in seeds.items()}, "_own": block(0)})
    df = df.withColumn("_b", F.explode_outer(F.sequence(block(-reach), block(reach))))
    schema = T.StructType([*cells.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def across(table: pa.Table) -> pa.Table:
        if table["_b"].null_count:  # cells without a row are far from everything
            out = table.drop_columns([*[f"_s_{n}" for n in names], "_own", "_b"])
            for name in names:
                out = out.append_column(name, pa.nulls(len(out), pa.float64()))
            return out
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        y, x = row - row.min(), col - col.min()
        shape = (y.max() + 1, x.max() + 1)
        none = np.full(shape[1], np.inf)
        own = np.asarray(table["_own"].to_numpy() == table["_b"].to_numpy())
        out = table.filter(pa.array(own)).drop_columns([*[f"_s_{n}" for n in names], "_own", "_b"])
        for name in names:
            here = table[f"_s_{name}"].to_numpy()
            seeds = np.zeros(shape, bool)
            seeds[y[here], x[here]] = True
            gap = _column_gap(seeds, -none, none, 0)
            field = np.full(shape, np.inf)
            field[y, x] = np.where(gap > reach, np.inf, gap**2)[y, x]
            best = field.copy()
            for k in range(1, min(reach + 1, field.shape[1])):
                best[:, k:] = np.minimum(best[:, k:], field[:, :-k] + k * k)
                best[:, :-k] = np.minimum(best[:, :-k], field[:, k:] + k * k)
            far = np.sqrt(best[y[own], x[own]])
            out = out.append_column(name, pa.array(far, mask=~(far <= reach + 1e-9)))
        return out

    return df.groupBy(*keys, "_b").applyInArrow(across, schema)


def edge_cells(cells: DataFrame, flag: str, zone: Sequence[str]) -> DataFrame:
    """Adds ``edge`` (differs from a 4-neighbour of the zone) and ``interior`` (all 8 neighbours in the zone)."""
    zone = list(zone)
    w = W.partitionBy(*zone, "row").orderBy("col")
    h = W.partitionBy(*zone, "col").orderBy("row")
    step = lambda win, axis, k: F.max(F.struct(flag, axis)).over(win.rangeBetween(k, k))[flag]
    f = F.col(flag)
    differs = F.lit(False)
    for win, axis in ((w, "col"), (h, "row")):
        for k in (-1, 1):
            differs = differs | holds(step(win, axis, k) != f)
    around = cells.withColumns({"edge": differs, "_three": F.count(F.lit(1)).over(w.rangeBetween(-1, 1))})
    nine = F.sum("_three").over(h.rangeBetween(-1, 1))
    return around.withColumn("interior", nine == 9).drop("_three")


def edge_density(cells: DataFrame, flag: str, zone: Sequence[str], pixel_m: float, *, inner: bool = True) -> DataFrame:
    """Length of edges per area of the zone."""
    e = edge_cells(cells, flag, zone)
    hit = F.col("edge") & F.col("interior") if inner else F.col("edge")
    n = F.count(F.lit(1))
    return e.groupBy(*zone).agg((F.count(F.when(hit, 1)) * pixel_m / (n * pixel_m * pixel_m)).alias("edge_density"))


def linearity(edges: DataFrame, zone: Sequence[str], n_angles: int = 90) -> DataFrame:
    """Hough accumulator over ``n_angles``: one minus mean over peak of the filled bins.

    ``x`` and ``y`` are coordinates inside the zone's own box, so the rho bins do not
    depend on where it lies.
    """
    zone = list(zone)
    angles = [a * pi / n_angles - pi / 2 for a in range(n_angles)]
    turns = [F.struct(F.lit(i).alias("a"), F.lit(round(cos(t), 12)).alias("cos"), F.lit(round(sin(t), 12)).alias("sin")) for i, t in enumerate(angles)]
    points = edges.select(*zone, "x", "y", F.inline(F.array(*turns)))
    rho = F.round(F.col("cos") * F.col("x") + F.col("sin") * F.col("y")).cast("int")
    bins = points.groupBy(*zone, "a", rho.alias("rho")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy(*zone).agg((1.0 - F.avg("n") / F.max("n")).alias("linearity_index"))


GLCM_OFFSETS = [(0, 1), (1, 1), (1, 0), (1, -1)]


def texture_entropy(cells: DataFrame, zone: Sequence[str], value: str, *, levels: int = 16, min_valid: int = 256) -> DataFrame:
    """Co-occurrence entropy in bits of the zone, quantized to ``levels`` over the zone's range.

    Symmetric pairs with both ends in the zone, averaged over four directions.
    """
    zone = list(zone)
    rows = cells.where(F.col(value).isNotNull()).select(*zone, "row", "col", value)
    span = rows.groupBy(*zone).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n_valid"))
    q = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (levels - 1)).cast("int")
    quant = rows.join(span.where((F.col("hi") > F.col("lo")) & (F.col("n_valid") >= min_valid)), zone).select(*zone, "row", "col", q.alias("q"))
    heads = shifted(quant, GLCM_OFFSETS).select(*zone, "row", "col", F.col("q").alias("i"), (F.col("_o.dr") * 10 + F.col("_o.dc")).alias("o"))
    pairs = heads.join(quant.withColumnRenamed("q", "j"), [*zone, "row", "col"])
    half = pairs.groupBy(*zone, "o", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    both = half.select(*zone, "o", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "n")
    full = both.groupBy(*zone, "o", "p").agg(F.sum("n").alias("n"))
    # -sum(n/N log2(n/N)) = log2(N) - sum(n log2 n) / N
    per = full.groupBy(*zone, "o").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("e"))
    entropy = per.groupBy(*zone).agg((F.sum("e") / len(GLCM_OFFSETS)).alias("glcm_texture"))
    out = span.join(entropy, zone, "left")
    few = F.concat(F.lit("n_valid="), F.col("n_valid"), F.lit(f" < min_valid_pixels={min_valid}"))
    why = F.when(F.col("n_valid") < min_valid, few).when(F.col("hi") <= F.col("lo"), "no tonal variation inside the stand")
    return out.select(*zone, "n_valid", "glcm_texture", why.alias("glcm_texture_reason"))


def texture_properties(cells: DataFrame, zone: Sequence[str], value: str, *, levels: int = 16) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, ASM and energy of the co-occurrence table, averaged over directions."""
    zone = list(zone)
    rows = cells.where(F.col(value).isNotNull()).select(*zone, "row", "col", value)
    span = rows.groupBy(*zone).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("hi > lo")
    q = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (levels - 1)).cast("int")
    quant = rows.join(span, zone).select(*zone, "row", "col", q.alias("q"))
    heads = shifted(quant, GLCM_OFFSETS).select(*zone, "row", "col", F.col("q").alias("i"), (F.col("_o.dr") * 10 + F.col("_o.dc")).alias("o"))
    half = heads.join(quant.withColumnRenamed("q", "j"), [*zone, "row", "col"]).groupBy(*zone, "o", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    d, n = F.col("b") - F.col("a"), F.col("n")
    # a pair a < b fills two symmetric entries of n each, a pair a = a one entry of 2n
    squares = F.when(F.col("a") == F.col("b"), 4 * n * n).otherwise(2 * n * n)
    per = half.groupBy(*zone, "o").agg(
        (F.sum(n * d * d) / F.sum(n)).alias("contrast"), (F.sum(n * d) / F.sum(n)).alias("dissimilarity"),
        (F.sum(n / (1.0 + d * d)) / F.sum(n)).alias("homogeneity"), (F.sum(squares) / (4 * F.sum(n) * F.sum(n))).alias("asm"),
    )
    names = ["contrast", "dissimilarity", "homogeneity", "asm"]
    return per.withColumn("energy", F.sqrt("asm")).groupBy(*zone).agg(*[F.avg(c).alias(c) for c in [*names, "energy"]])


def relative_elevation(cells: DataFrame, value: str, size: int, rows: int, cols: int) -> DataFrame:
    """Elevation minus the mean of a moving square, the grid mirrored at its edges."""
    h = size // 2

    def mirror(axis: str, n: int) -> Column:
        x = F.col(axis)
        copies = [F.when(x < h, -1 - x), F.when(x >= n - h, 2 * n - 1 - x)]
        return F.explode(F.array_compact(F.array(x, *copies)))

    wide = cells.select(*DATE, "row", "col", value).select(*DATE, F.col("row").alias("_r0"), F.col("col").alias("_c0"), value, "row", "col")
    wide = wide.select(*DATE, "_r0", "_c0", value, mirror("row", rows).alias("row"), "col").select(*DATE, "_r0", "_c0", value, "row", mirror("col", cols).alias("col"))
    sums = box_sums(wide, {"_s": F.col(value), "_n": F.when(F.col(value).isNotNull(), 1.0)}, size)
    own = (F.col("row") == F.col("_r0")) & (F.col("col") == F.col("_c0"))
    return sums.where(own).select(*DATE, "row", "col", value, (F.col(value) - F.col("_s") / F.col("_n")).alias("rei"))


def terrain(cells: DataFrame, value: str, pixel_m: float) -> DataFrame:
    """Slope, aspect, northness, eastness and profile curvature from the 3 x 3 neighbourhood (Horn);
    null at the edge of the data."""
    spread = shifted(cells.where(F.col(value).isNotNull()).select(*DATE, "row", "col", value), square(1))
    part = {}
    for dr, dc in square(1):
        # a copy moved by (dr, dc) is the neighbour at (-dr, -dc) of its target
        part[(-dr, -dc)] = F.max(F.when((F.col("_o.dr") == dr) & (F.col("_o.dc") == dc), F.col(value)))
    agg = spread.groupBy(*DATE, "row", "col").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"z{r + 1}{k + 1}") for (r, k), c in part.items()])
    z = {(r, k): F.col(f"z{r + 1}{k + 1}") for r, k in part}
    p = ((z[-1, 1] + 2 * z[0, 1] + z[1, 1]) - (z[-1, -1] + 2 * z[0, -1] + z[1, -1])) / (8 * pixel_m)
    q = ((z[1, -1] + 2 * z[1, 0] + z[1, 1]) - (z[-1, -1] + 2 * z[-1, 0] + z[-1, 1])) / (8 * pixel_m)
    r = (z[0, 1] - 2 * z[0, 0] + z[0, -1]) / pixel_m**2
    t = (z[-1, 0] - 2 * z[0, 0] + z[1, 0]) / pixel_m**2
    s = (z[-1, 1] + z[1, -1] - z[-1, -1] - z[1, 1]) / (4 * pixel_m**2)
    parts = {"_p": p, "_q": q, "_r": r, "_s": s, "_t": t}
    out = agg.where(F.col("_n") == 9).select(*DATE, "row", "col", *[c.alias(n) for n, c in parts.items()])
    p, q, r, s, t = (F.col(n) for n in parts)
    g = p * p + q * q
    turn = F.degrees(F.atan2(q, -p))
    aspect = F.when(g > 0, F.when(turn > 90, 450.0 - turn).otherwise(90.0 - turn))
    curvature = F.when(g > 0, -(r * p * p - 2 * s * p * q + t * q * q) / g)
    out = out.select(*DATE, "row", "col", F.degrees(F.atan(F.sqrt(g))).alias("slope_deg"), aspect.alias("aspect"), curvature.alias("profile_curvature"))
    return out.withColumns({"northness": F.cos(F.radians("aspect")), "eastness": F.sin(F.radians("aspect"))})


def image_gaps(pixels: DataFrame, keys: Sequence[str], block_px: int, edge_cells_n: float, *, seed_share: float = 0.5) -> DataFrame:
    """Height without pixels that are zero in all bands, nor those in coarse cells within a
    distance of a cell whose gap share reaches the seed share. Adds ``masked_height`` and ``why``."""
    keys = list(keys)
    gap = (F.col("red") == 0) & (F.col("nir") == 0) & (F.col("other") == 0)
    rows = pixels.withColumns({"_gap": gap, "_br": F.floor(F.col("row") / block_px), "_bc": F.floor(F.col("col") / block_px)})
    coarse = rows.groupBy(*keys, F.col("_br").alias("row"), F.col("_bc").alias("col")).agg(F.avg(F.col("_gap").cast("double")).alias("share"))
    near = dilate(coarse.where(F.col("share") >= seed_share), disk(edge_cells_n), keys).select(*keys, F.col("row").alias("_br"), F.col("col").alias("_bc"), F.lit(True).alias("_near"))
    out = rows.join(near, [*keys, "_br", "_bc"], "left")
    why = F.when(F.col("_gap"), "gap").when(F.col("_near"), "edge")
    return out.withColumns({"why": why, "masked_height": F.when(why.isNull(), F.col("height"))}).drop("_gap", "_br", "_bc", "_near")


def mosaic(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One value per pixel from several sources: the first source with a valid value."""
    v = finite("value")
    order = F.when(v.isNotNull(), F.col("source_order"))
    return pixels.groupBy(*keys).agg(F.min_by(v, order).alias("value"), F.min(order).alias("source_order"))


def common_grid(files: DataFrame, pixel_m: float, grain_m: float, origin: tuple[float, float]) -> DataFrame:
    """Whole cells of the common extent of all years: union of files per year, then intersection."""
    year = files.groupBy("unit", "year").agg(F.min("left").alias("l"), F.min("bottom").alias("b"), F.max("right").alias("r"), F.max("top").alias("u"))
    box = year.groupBy("unit").agg(F.max("l").alias("l"), F.max("b").alias("b"), F.min("r").alias("r"), F.min("u").alias("u"))
    block = round(grain_m / pixel_m)
    first_col, stop_col = F.ceil((F.col("l") - origin[0]) / pixel_m - 1e-6), F.floor((F.col("r") - origin[0]) / pixel_m + 1e-6)
    first_row, stop_row = F.ceil((F.lit(origin[1]) - F.col("u")) / pixel_m - 1e-6), F.floor((F.lit(origin[1]) - F.col("b")) / pixel_m + 1e-6)
    rows, cols = F.floor((stop_row - first_row) / block), F.floor((stop_col - first_col) / block)
    return box.select("unit", first_row.alias("first_row"), first_col.alias("first_col"), rows.alias("cell_rows"), cols.alias("cell_cols")).where("cell_rows > 0 AND cell_cols > 0")


def grid_problems(layers: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Which of CRS, pixel size, origin and shape differ among the layers of a unit."""
    fields = {"crs": ["crs"], "pixel": ["pixel_m"], "origin": ["left", "top"], "shape": ["rows", "cols"]}
    n = {name: F.countDistinct(F.struct(*cols)) for name, cols in fields.items()}
    text = F.concat_ws(", ", *[F.when(F.col(f"_{name}") > 1, name) for name in fields])
    agg = layers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_layers"), *[c.alias(f"_{name}") for name, c in n.items()])
    return agg.select(*keys, "n_layers", text.alias("differs"))


def lattice_starts(axis: DataFrame, chip: int, stride: int) -> DataFrame:
    """Chip starts on a global lattice along an axis: first, every stride and a flush last one.

    ``axis`` has ``length`` and ``origin`` (position of the first pixel on the lattice).
    """
    first = F.pmod(-F.col("origin"), F.lit(stride))
    last = F.col("length") - chip
    regular = F.when(first <= last, F.sequence(first, last, F.lit(stride))).otherwise(F.array().cast("array<bigint>"))
    starts = F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), regular, F.array(last.cast("bigint"))))
    return axis.select("*", F.explode(F.when(F.col("length") <= chip, F.array(F.lit(0).cast("bigint"))).otherwise(starts)).alias("start"))


def outward_grid(bounds: DataFrame, pixel_m: float, cell_px: int) -> DataFrame:
    """Cells of a global lattice that cover the bounds of each unit, snapped outward: first
    column and last row in pixels of the lattice (west and north edge), and the numbers of columns and rows.

    ``bounds``: unit, minx, miny, maxx, maxy. Edges are first rounded to whole pixels.
    """
    edge = lambda c: F.rint(F.col(c) / pixel_m)
    down, up = (lambda c: F.floor(edge(c) / cell_px) * cell_px), (lambda c: F.ceil(edge(c) / cell_px) * cell_px)
    left, right, bottom, top = down("minx"), up("maxx"), down("miny"), up("maxy")
    return bounds.select("unit", left.cast("bigint").alias("col0"), top.cast("bigint").alias("row0"), ((right - left) / cell_px).cast("bigint").alias("cols"), ((top - bottom) / cell_px).cast("bigint").alias("rows"))


def grid_blocks(grids: DataFrame, block: int, halo: int) -> DataFrame:
    """Blocks that tile each grid, north to south and west to east: place and size in cells, and
    the size of the block with its halo, which may lie beyond the grid."""
    starts = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1, F.lit(block).cast("bigint")))
    b = grids.where("rows > 0 AND cols > 0").select("*", starts("rows").alias("row")).select("*", starts("cols").alias("col"))
    size = lambda n, at: F.least(F.lit(block), F.col(n) - F.col(at)).cast("bigint")
    out = b.select("unit", "row", "col", size("rows", "row").alias("n_rows"), size("cols", "col").alias("n_cols"))
    return out.withColumns({"halo_rows": F.col("n_rows") + 2 * halo, "halo_cols": F.col("n_cols") + 2 * halo})


def halo_blocks(cells: DataFrame, block: int, halo: int, keys: Sequence[str] = DATE) -> DataFrame:
    """Every cell with all blocks whose halo it lies in; ``core`` marks its own block."""
    own = lambda a: F.floor(F.col(a) / block)
    reach = lambda a: F.explode(F.sequence(F.floor((F.col(a) - halo) / block), F.floor((F.col(a) + halo) / block)))
    out = cells.select("*", reach("row").alias("block_row")).select("*", reach("col").alias("block_col"))
    return out.withColumn("core", (F.col("block_row") == own("row")) & (F.col("block_col") == own("col"))).where("block_row >= 0 AND block_col >= 0")


def cell_ha(cell_m: float = P.GRAIN_M) -> float:
    return cell_m * cell_m / 1e4


def min_cells(area_ha: float, cell_m: float = P.GRAIN_M) -> int:
    return max(ceil(area_ha / cell_ha(cell_m) - 1e-9), 0)


