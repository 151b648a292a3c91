"""Observations of stands: quality gates, yearly metrics, fits and trends."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import finite, reasons
from sylvaflow.operators.ranks import exact_quantiles, several_quantiles

KEY = ["stand_id", "year"]
INDEX_WIDTH = 1 / 256


def gate_causes(quality: dict = P.QUALITY) -> dict[str, str]:
    lo, hi = quality["valid_range"]
    return {
        "null": "index null (every pixel masked)",
        "range": f"index outside {lo} to {hi}",
        "pixels": f"fewer than {quality['min_pixels']} pixels",
        "effective": f"effective pixels below {quality['min_effective_pixels']}",
        "coverage": f"stand coverage below {quality['min_coverage_fraction']:.2f}"
        " (cloud, shadow or SLC gap)",
        "area": f"stand area below {quality['min_area_m2']:.0f} m2 for 30 m metrics",
    }


def drop_cause(index: str = "ndvi", quality: dict = P.QUALITY) -> Column:
    """First failing gate of a row, null when it passes all six."""
    lo, hi = quality["valid_range"]
    cause, value = gate_causes(quality), finite(index)
    zero = lambda c: F.coalesce(finite(c), F.lit(0.0))
    return reasons(
        (value.isNull(), cause["null"]),
        ((value < lo) | (value > hi), cause["range"]),
        (zero("n_pixels") < quality["min_pixels"], cause["pixels"]),
        (zero("pixel_weight_sum") < quality["min_effective_pixels"], cause["effective"]),
        (zero("coverage_fraction") < quality["min_coverage_fraction"], cause["coverage"]),
        (zero("area_m2") < quality["min_area_m2"], cause["area"]),
    )


def filter_observations(obs: DataFrame, index: str = "ndvi", quality: dict = P.QUALITY) -> DataFrame:
    return obs.where(drop_cause(index, quality).isNull())


def gate_counts(obs: DataFrame, index: str = "ndvi", quality: dict = P.QUALITY) -> DataFrame:
    """Rows dropped per stand and gate, each row under its first failing gate."""
    return (
        obs.select("stand_id", drop_cause(index, quality).alias("cause"))
        .where(F.col("cause").isNotNull())
        .groupBy("stand_id", "cause")
        .agg(F.count(F.lit(1)).alias("n_dropped"))
    )


def mask_propagation_errors(obs: DataFrame, index: str = "ndvi") -> DataFrame:
    """Rows without an index value that still claim surviving pixels."""
    bad = finite(index).isNull() & (F.coalesce(finite("n_pixels"), F.lit(0.0)) > 0)
    return obs.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(bad, 1)).alias("n_bad"))


def season_mean(kept: DataFrame, index: str = "ndvi", season: dict = P.SEASON) -> DataFrame:
    """Growing-season mean per stand and year with its observation count, null under the minimum."""
    lo, hi, least = season["doy_min"], season["doy_max"], season["min_obs"]
    rows = kept.where(F.col("doy").between(lo, hi) & finite(index).isNotNull())
    short = F.concat(F.lit("n_obs="), F.col("n"), F.lit(f" in DOY {lo}-{hi} < min_obs={least}"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.avg(finite(index)).alias("m")).select(
        *KEY,
        F.when(F.col("n") >= least, F.col("m")).alias("ndvi_mean"),
        F.col("n").alias("sat_ndvi_mean_n_obs"),
        F.when(F.col("n") < least, short).alias("_why_mean"),
    )


def season_level(kept: DataFrame, index: str = "ndvi", season: dict = P.SEASON) -> DataFrame:
    """``season_mean`` with the median of the season as support."""
    rows = kept.where(F.col("doy").between(season["doy_min"], season["doy_max"]))
    med = exact_quantiles(rows.select(*KEY, finite(index).alias("_v")), KEY, "_v", {"sat_ndvi_mean_median": 0.5}, INDEX_WIDTH)
    return season_mean(kept, index, season).join(med, KEY, "left")


def _condition(a: dict[str, Column]) -> Column:
    """Condition number of the design matrix: roots of the 3x3 cross product matrix."""
    q = (a["n"] + a["cc"] + a["ss"]) / 3.0
    d0, d1, d2 = a["n"] - q, a["cc"] - q, a["ss"] - q
    p2 = d0 * d0 + d1 * d1 + d2 * d2 + 2.0 * (a["c"] * a["c"] + a["s"] * a["s"] + a["cs"] * a["cs"])
    p = F.sqrt(p2 / 6.0)
    det = (
        d0 * (d1 * d2 - a["cs"] * a["cs"])
        - a["c"] * (a["c"] * d2 - a["cs"] * a["s"])
        + a["s"] * (a["c"] * a["cs"] - d1 * a["s"])
    )
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2.0 * p * p * p)))
    phi = F.acos(r) / 3.0
    top = q + 2.0 * p * F.cos(phi)
    low = q + 2.0 * p * F.cos(phi + 2.0 * pi / 3.0)
    return F.when(low > 0, F.sqrt(top / low)).otherwise(F.lit(float("inf")))


def harmonic_fit(kept: DataFrame, index: str = "ndvi", guard: dict = P.HARMONIC) -> DataFrame:
    """One annual harmonic per stand and year by least squares.

    One aggregation gives the sums of the normal equations; the fit and its
    guards (count, span, condition, amplitude, in this order) are expressions.
    """
    y = finite(index)
    year = F.col("year").cast("int")
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    period = F.when(leap, 366.0).otherwise(365.0)
    angle = 2.0 * pi * F.col("doy") / period
    rows = kept.where(y.isNotNull() & F.col("doy").isNotNull()).select(
        *KEY, F.col("doy").cast("int").alias("d"), y.alias("y"), period.alias("period"),
        F.cos(angle).alias("co"), F.sin(angle).alias("si"),
    )
    c, s, v = F.col("co"), F.col("si"), F.col("y")
    sums = {
        "c": c, "s": s, "cc": c * c, "cs": c * s, "ss": s * s,
        "y": v, "yc": v * c, "ys": v * s, "yy": v * v,
    }
    agg = rows.groupBy(*KEY).agg(
        F.count("y").alias("n"), (F.max("d") - F.min("d")).cast("double").alias("span"),
        F.max("period").alias("period"), *[F.sum(e).alias(f"x_{k}") for k, e in sums.items()],
    )
    a = {k: F.col(f"x_{k}") for k in sums} | {"n": F.col("n").cast("double")}
    few, narrow = F.col("n") < guard["min_obs"], F.col("span") < guard["min_doy_span"]
    agg = agg.withColumn("cond", F.when(~few & ~narrow, _condition(a)))
    ill = F.col("cond") > guard["max_condition"]
    # cofactors of the cross product matrix
    k00, k01, k02 = a["cc"] * a["ss"] - a["cs"] * a["cs"], a["cs"] * a["s"] - a["c"] * a["ss"], a["c"] * a["cs"] - a["cc"] * a["s"]
    k11, k12, k22 = a["n"] * a["ss"] - a["s"] * a["s"], a["c"] * a["s"] - a["n"] * a["cs"], a["n"] * a["cc"] - a["c"] * a["c"]
    det = a["n"] * k00 + a["c"] * k01 + a["s"] * k02
    ok = ~few & ~narrow & ~ill
    solve = lambda p, q, r: F.when(ok, F.try_divide(p * a["y"] + q * a["yc"] + r * a["ys"], det))
    agg = agg.select(
        "*", solve(k00, k01, k02).alias("offset"), solve(k01, k11, k12).alias("b_cos"),
        solve(k02, k12, k22).alias("b_sin"),
    )
    b0, b1, b2 = F.col("offset"), F.col("b_cos"), F.col("b_sin")
    left = F.greatest(F.lit(0.0), a["yy"] - b0 * a["y"] - b1 * a["yc"] - b2 * a["ys"])
    total = a["yy"] - a["y"] * a["y"] / a["n"]
    turn = F.atan2(b2, b1) / (2.0 * pi) * F.col("period")
    amplitude = 2.0 * F.hypot(b1, b2)
    agg = agg.select(
        "*", amplitude.alias("amp"), F.when(b0.isNotNull(), F.sqrt(left / a["n"])).alias("rmse"),
        F.when(b0.isNotNull() & (total > P.FLAT_SERIES), 1.0 - left / total).alias("r2"),
        F.when(turn < 0, turn + F.col("period")).otherwise(turn).alias("phase"),
    )
    big = F.col("amp") > guard["max_amplitude"]
    why = reasons(
        (few, F.concat(F.lit("n_obs="), F.col("n"), F.lit(f" < min_obs={guard['min_obs']}"))),
        (narrow, F.format_string(f"observations span %.0f days < min_doy_span={guard['min_doy_span']:.0f}", "span")),
        (ill, F.format_string(f"design matrix ill-conditioned (cond=%.1f > max_condition={guard['max_condition']:.0f})", "cond")),
        (big, F.format_string(f"fitted amplitude %.2f exceeds max_amplitude={guard['max_amplitude']}", "amp")),
    )
    return agg.select(
        *KEY,
        F.when(why.isNull(), F.col("amp")).alias("ndvi_seasonal_amplitude"),
        F.col("n").alias("sat_amplitude_n_obs"), F.col("span").alias("sat_amplitude_doy_span"),
        F.col("cond").alias("sat_amplitude_condition"), F.col("rmse").alias("sat_amplitude_rmse"),
        F.col("r2").alias("sat_amplitude_r2"), F.col("phase").alias("sat_amplitude_phase_doy"),
        F.col("offset").alias("sat_amplitude_offset"), why.alias("_why_amplitude"),
    )


def theil_sen(points: Column) -> Column:
    """Slope and interval of an array of ``struct(x, y)``: ``struct(slope, lo, hi)``.

    Median of the slopes of all pairs with increasing x; the 95% interval takes
    the ranked slopes of Sen (1968) with the tie correction. Null under three
    points or one distinct x. Meant for arrays of bounded size (a window of years).
    """
    pairs = F.flatten(
        F.transform(
            points,
            lambda a: F.transform(
                F.filter(points, lambda b: b["x"] > a["x"]),
                lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]),
            ),
        )
    )
    slopes = F.array_sort(pairs)
    n, nt = F.size(points).cast("double"), F.size(slopes)

    def ties(axis: str) -> Column:
        def term(a: Column) -> Column:
            k = F.size(F.filter(points, lambda b: b[axis] == a[axis])).cast("double")
            return (k - 1.0) * (2.0 * k + 5.0)

        return F.aggregate(F.transform(points, term), F.lit(0.0), lambda acc, x: acc + x)

    variance = (n * (n - 1.0) * (2.0 * n + 5.0) - ties("x") - ties("y")) / 18.0
    reach = F.lit(1.959963984540054) * F.sqrt(variance)
    upper = F.least(F.rint((nt + reach) / 2.0).cast("int"), nt - 1)
    lower = F.greatest(F.rint((nt - reach) / 2.0).cast("int") - 1, F.lit(0))
    half = F.floor(nt / 2).cast("int")
    mid = F.when(nt % 2 == 1, F.get(slopes, half)).otherwise((F.get(slopes, half - 1) + F.get(slopes, half)) / 2.0)
    enough = (n >= 3) & (nt > 0)
    return F.struct(
        F.when(enough, mid).alias("slope"),
        F.when(enough, F.get(slopes, lower)).alias("lo"),
        F.when(enough, F.get(slopes, upper)).alias("hi"),
    )


def index_trend(levels: DataFrame, trend: dict = P.TREND) -> DataFrame:
    """Theil-Sen slope of the yearly level over a trailing window of years.

    ``levels`` has one row per stand and year of the frame, also without a level.
    """
    span, least = trend["window_years"], trend["min_years"]
    window = W.partitionBy("stand_id").orderBy(F.col("year").cast("int")).rangeBetween(-(span - 1), 0)
    point = F.when(F.col("ndvi_mean").isNotNull(), F.struct(F.col("year").cast("double").alias("x"), F.col("ndvi_mean").alias("y")))
    out = levels.select("*", F.collect_list(point).over(window).alias("_points"))
    out = out.withColumn("_n", F.size("_points"))
    out = out.withColumn("_fit", F.when(F.col("_n") >= least, theil_sen(F.col("_points"))))
    short = F.concat(
        F.col("_n"), F.lit(" usable years in "), F.col("year").cast("int") - (span - 1), F.lit("-"),
        F.col("year"), F.lit(f" < min_years={least}"),
    )
    return out.select(
        *levels.columns,
        F.col("_fit.slope").alias("ndvi_trend"),
        F.col("_n").alias("sat_trend_n_years"),
        F.col("_fit.lo").alias("sat_trend_slope_lo"), F.col("_fit.hi").alias("sat_trend_slope_hi"),
        F.when(F.col("_n") < least, short)
        .when(F.col("_fit.slope").isNull(), "slope undetermined").alias("_why_trend"),
    )


def stand_years(obs: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Every stand with every year of the range, with the median stand area."""
    stands = exact_quantiles(
        obs.select("stand_id", finite("area_m2").alias("a")), ["stand_id"], "a", {"area_m2": 0.5}, 100.0
    )
    ids = obs.select("stand_id").distinct().join(stands, "stand_id", "left")
    if years is None:
        first, last = obs.agg(F.min("year").cast("int")).scalar(), obs.agg(F.max("year").cast("int")).scalar()
    else:
        first, last = F.lit(years[0]), F.lit(years[1])
    return ids.select("stand_id", "area_m2", F.explode(F.sequence(first, last)).alias("year"))


def annual_frame(obs: DataFrame, years: tuple[int, int] | None = None, quality: dict = P.QUALITY) -> DataFrame:
    """Yearly metrics of every stand, with a row also for years without observations."""
    obs = obs.withColumn("year", F.col("year").cast("int"))
    lo, hi, least = P.SEASON["doy_min"], P.SEASON["doy_max"], P.SEASON["min_obs"]
    marked = obs.withColumn("_ok", drop_cause(quality=quality).isNull())
    kept = marked.where("_ok")
    in_season = F.col("doy").between(lo, hi)
    ok = F.col("_ok")
    used = lambda c: F.when(ok, F.col(c))
    season = F.when(ok & in_season, finite("ndvi"))
    short = F.concat(F.lit("n_obs="), F.col("sat_ndvi_mean_n_obs"), F.lit(f" in DOY {lo}-{hi} < min_obs={least}"))
    # one pass over the observations for everything that is a plain aggregate
    counted = marked.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("sat_n_observations_raw"), F.count(F.when(ok, 1)).alias("sat_n_observations"),
        F.array_sort(F.collect_set(used("sensor"))).alias("_sensors"), F.min(used("n_pixels")).alias("sat_min_n_pixels"),
        F.avg(F.when(ok, (F.col("sensor") == "L7").cast("double"))).alias("sat_frac_l7"), F.size(F.collect_set(used("wrs_path"))).alias("_paths"),
        F.count(season).alias("sat_ndvi_mean_n_obs"), F.avg(season).alias("_mean"),
    )
    some = F.col("sat_n_observations") > 0
    counted = counted.select(
        *KEY, "sat_n_observations_raw", "sat_n_observations", "sat_min_n_pixels", "sat_frac_l7", "sat_ndvi_mean_n_obs",
        F.array_join("_sensors", ",").alias("sat_sensor_mix"), F.when(some, F.size("_sensors")).alias("sat_n_sensors"), F.when(some, F.col("_paths")).cast("bigint").alias("sat_n_paths"),
        F.when(F.col("sat_ndvi_mean_n_obs") >= least, F.col("_mean")).alias("ndvi_mean"), F.when(F.col("sat_ndvi_mean_n_obs") < least, short).alias("_why_mean"),
    )
    medians = several_quantiles(kept, KEY, {
        "sat_median_coverage_fraction": (finite("coverage_fraction"), 0.5, 1 / 64),
        "sat_median_n_pixels": (finite("n_pixels"), 0.5, 1.0),
        "med": (F.when(in_season, finite("ndvi")), 0.5, INDEX_WIDTH),
    })
    frame = stand_years(obs, years).join(drop_columns(obs), "stand_id", "left")
    for part in (counted, medians, harmonic_fit(kept)):
        frame = frame.join(part, KEY, "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    frame = frame.select(
        *[c for c in frame.columns if c not in ("sat_n_observations", "sat_n_observations_raw", "sat_sensor_mix", "sat_ndvi_mean_n_obs", "_why_mean", "sat_amplitude_n_obs", "_why_amplitude", "med")],
        F.col("med").alias("sat_ndvi_mean_median"),
        none("sat_n_observations").alias("sat_n_observations"), none("sat_n_observations_raw").alias("sat_n_observations_raw"),
        F.coalesce("sat_sensor_mix", F.lit("")).alias("sat_sensor_mix"),
        none("sat_ndvi_mean_n_obs").alias("sat_ndvi_mean_n_obs"), none("sat_amplitude_n_obs").alias("sat_amplitude_n_obs"),
        F.when(F.col("sat_ndvi_mean_n_obs").isNull(), f"n_obs=0 in DOY {lo}-{hi} < min_obs={least}").otherwise(F.col("_why_mean")).alias("_why_mean"),
        F.when(F.col("sat_amplitude_n_obs").isNull(), f"n_obs=0 < min_obs={P.HARMONIC['min_obs']}").otherwise(F.col("_why_amplitude")).alias("_why_amplitude"),
    )
    frame = index_trend(frame)
    named = [("ndvi_mean", "_why_mean"), ("ndvi_seasonal_amplitude", "_why_amplitude"), ("ndvi_trend", "_why_trend")]
    text = F.concat_ws("; ", *[F.concat(F.lit(f"{n}: "), F.col(w)) for n, w in named])
    return frame.withColumn("satellite_unavailable", text).drop(*[w for _, w in named])


def drop_columns(obs: DataFrame) -> DataFrame:
    """Drop counts per stand with one column per gate."""
    causes = gate_causes()
    wide = obs.select("stand_id", drop_cause().alias("cause")).groupBy("stand_id")
    return wide.agg(*[F.count(F.when(F.col("cause") == text, 1)).alias(f"sat_dropped_{k}") for k, text in causes.items()])
