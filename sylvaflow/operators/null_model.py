"""Empirical null of a population of z values, local false discovery rate and decision rules.

Everything a date needs is a histogram: cells are counted into bins (map-side
combine) and the fit, the smoothed mixture and the curve work on the few bins
of a date. The fitted model is one row per date with the curve as an array, so
scoring cells is a single join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import exp, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import holds
from sylvaflow.operators.cells import DATE, LFDR_CLIP, Z_WIDTH, logit, over_dates, smooth_fields
from sylvaflow.operators.ranks import exact_quantiles, join_groups, ordered_counts
from sylvaflow.session import cut_lineage


def solve_quadratic(x: Sequence[Column], y: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Coefficients c0, c1, c2 of the weighted quadratic fit from its moments
    ``x = (sum w, sum w x, ..., sum w x^4)`` and ``y = (sum w y, sum w x y, sum w x^2 y)``."""
    s0, s1, s2, s3, s4 = x
    a, b, c = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
    d, e, f = s0 * s4 - s2 * s2, s1 * s2 - s0 * s3, s0 * s2 - s1 * s1
    det = s0 * a + s1 * b + s2 * c
    line = lambda p, q, r: F.try_divide(p * y[0] + q * y[1] + r * y[2], det)
    return line(a, b, c), line(b, d, e), line(c, e, f)


def fit_null(cells: DataFrame, z: str, where: str | None = None, *, keys: Sequence[str] = DATE, pct0: float = P.DECIDE["pct0"], bin_w: float = P.DECIDE["bin_w"], min_values: int = 100) -> DataFrame:
    """Central matching per date: n, mu0, sigma0, p0 and the method used.

    A quadratic is fitted to the log counts between two quantiles; without five filled
    bins or a downward curve the median and interquartile range are used.
    """
    keys = list(keys)
    use = holds(F.col(z).isNotNull() & (F.col(where) if where else F.lit(True)))
    rows = cells.where(use).select(*keys, F.col(z).cast("double").alias("_z"))
    probs = {"lo": pct0, "hi": 1 - pct0, "q1": 0.25, "med": 0.5, "q3": 0.75}
    stats = exact_quantiles(rows, keys, "_z", probs, Z_WIDTH)
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_z").alias("sd"), F.min("_z").alias("z_min")).where(F.col("n") >= min_values)
    stats = cut_lineage(stats.join(size, keys))
    # edges start at lo with a step of bin_w and reach at least hi; the last bin keeps its right edge
    bins = F.ceil((F.col("hi") + bin_w - F.col("lo")) / bin_w) - 1
    at = (F.col("_z") - F.col("lo")) / bin_w
    index = F.when(at == bins, bins - 1).otherwise(F.floor(at))
    counted = join_groups(rows, stats.select(*keys, "lo", "hi"), keys).where((at >= 0) & (at <= bins)).groupBy(*keys, "lo", index.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    # moments about the first edge keep the numbers small
    x, w, y = (F.col("b") + 0.5) * bin_w, F.col("c").cast("double"), F.ln("c")
    mom = counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bins"), *[F.sum(w * x**k if k else w).alias(f"s{k}") for k in range(5)], *[F.sum(w * y * x**k if k else w * y).alias(f"t{k}") for k in range(3)]
    )
    c0, c1, c2 = solve_quadratic([F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)])
    fit = stats.join(mom, keys, "left").withColumns({"c0": c0, "c1": c1, "c2": c2})
    ok = holds((F.col("bins") >= 5) & (F.col("c2") < 0))
    sigma = F.sqrt(-1.0 / (2.0 * F.col("c2")))
    shift = -F.col("c1") / (2.0 * F.col("c2"))
    log_p0 = F.col("c0") + shift * shift / (2.0 * sigma * sigma) + F.ln((2 * pi) ** 0.5 * sigma / (F.col("n") * bin_w))
    iqr = (F.col("q3") - F.col("q1")) / 1.349
    return fit.select(
        *keys, "n", "z_min", F.when(ok, F.col("lo") + shift).otherwise(F.col("med")).alias("mu0"),
        F.when(ok, sigma).when(iqr > 0, iqr).otherwise(F.col("sd")).alias("sigma0"),
        F.when(ok, F.least(F.lit(1.0), F.exp(log_p0))).otherwise(1.0).alias("p0"), F.when(ok, "central").otherwise("iqr").alias("method"),
    )


def lfdr_curves(cells: DataFrame, z: str, where: str | None, null: DataFrame, *, keys: Sequence[str] = DATE, bin_w: float = P.DECIDE["bin_w"], smooth_bins: float = P.DECIDE["smooth_bins"]) -> DataFrame:
    """The null with its one-sided curve of local fdr per date: ``first`` (centre of bin 0) and ``curve``.

    Counts are smoothed with a Gaussian whose edge bins repeat, divided into the null
    density, limited to one and made monotone away from the null centre.
    """
    keys = list(keys)
    use = holds(F.col(z).isNotNull() & (F.col(where) if where else F.lit(True)))
    lo = F.least(F.col("z_min"), F.col("mu0") - 8 * F.col("sigma0")) - bin_w
    base = null.withColumn("lo", lo).withColumn("bins", (F.ceil((F.col("mu0") + bin_w - F.col("lo")) / bin_w) - 1).cast("int"))
    at = (F.col(z).cast("double") - F.col("lo")) / bin_w
    index = F.when(at == F.col("bins"), F.col("bins") - 1).otherwise(F.floor(at)).cast("int")
    counts = join_groups(cells.where(use).select(*keys, z), base.select(*keys, "lo", "bins"), keys).where((at >= 0) & (at <= F.col("bins"))).groupBy(*keys, index.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    frame = base.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("b")).join(counts, [*keys, "b"], "left")
    frame = frame.withColumn("c", F.coalesce(F.col("c"), F.lit(0)).cast("double"))
    line = W.partitionBy(*keys).orderBy("b")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    radius = int(4.0 * smooth_bins + 0.5)
    raw = [exp(-0.5 * (k / smooth_bins) ** 2) for k in range(radius + 1)]
    norm = raw[0] + 2 * sum(raw[1:])
    f = F.col("c") * (raw[0] / norm)
    for k in range(1, radius + 1):
        left = F.coalesce(F.lag("c", k).over(line), F.first("c").over(whole))
        right = F.coalesce(F.lead("c", k).over(line), F.last("c").over(whole))
        f = f + (raw[k] / norm) * (left + right)
    frame = frame.withColumn("f", f)
    centre = F.col("lo") + (F.col("b") + 0.5) * bin_w
    # a null without spread has no density: its curve stays at one
    u = F.try_divide(centre - F.col("mu0"), F.col("sigma0"))
    f0 = F.try_divide(F.col("n") * bin_w * F.col("p0") * F.exp(-0.5 * u * u), F.col("sigma0") * (2 * pi) ** 0.5)
    raw_lf = F.when((F.col("f") > 0) & f0.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), f0 / F.col("f")))).otherwise(1.0)
    frame = frame.withColumn("lf", raw_lf).withColumn("lf", F.min("lf").over(line.rowsBetween(0, W.unboundedFollowing)))
    curve = F.transform(F.array_sort(F.collect_list(F.struct("b", "lf"))), lambda s: s["lf"])
    named = [F.first(c).alias(c) for c in ("n", "mu0", "sigma0", "p0", "method")]
    return frame.groupBy(*keys).agg(*named, (F.first("lo") + 0.5 * bin_w).alias("first"), curve.alias("curve"))


def interpolate(z: Column, model: Column, bin_w: float) -> Column:
    """Local fdr of a value from a model struct: linear between bin centres, flat outside."""
    curve = model["curve"]
    last = F.size(curve) - 1
    at = F.least(F.greatest((z - model["first"]) / bin_w, F.lit(0.0)), last.cast("double"))
    i = F.least(F.floor(at).cast("int"), F.greatest(last - 1, F.lit(0)))
    a, b = F.get(curve, i), F.get(curve, F.least(i + 1, last))
    return F.when(model.isNull() | z.isNull(), None).when(z >= model["mu0"], 1.0).otherwise(a + (b - a) * (at - i))


def posteriors(df: DataFrame, values: Mapping[str, tuple[str, Column]], bin_w: float) -> DataFrame:
    """Posterior columns ``out -> (field, value)`` from the ``models`` map of the date.

    Model, position and interpolation are separate steps, so that each is generated once.
    """
    df = df.withColumns({f"_m_{o}": F.col("models")[f] for o, (f, _x) in values.items()})
    last = lambda o: F.size(F.col(f"_m_{o}")["curve"]) - 1
    df = df.withColumns({
        f"_at_{o}": F.least(F.greatest((x - F.col(f"_m_{o}")["first"]) / bin_w, F.lit(0.0)), last(o).cast("double")) for o, (_f, x) in values.items()
    })
    df = df.withColumns({f"_i_{o}": F.least(F.floor(f"_at_{o}").cast("int"), F.greatest(last(o) - 1, F.lit(0))) for o in values})
    out = {}
    for o, (_f, x) in values.items():
        m, i = F.col(f"_m_{o}"), F.col(f"_i_{o}")
        a, b = F.get(m["curve"], i), F.get(m["curve"], F.least(i + 1, last(o)))
        out[o] = 1.0 - F.when(m.isNull() | x.isNull(), None).when(x >= m["mu0"], 1.0).otherwise(a + (b - a) * (F.col(f"_at_{o}") - i))
    df = df.withColumns(out)
    return df.drop(*[f"_{k}_{o}" for o in values for k in ("m", "at", "i")])


def prior_of(p0: Column, min_prior: float = 0.0) -> Column:
    return F.least(F.lit(LFDR_CLIP[1]), F.greatest(F.lit(LFDR_CLIP[0]), 1.0 - p0, F.lit(min_prior)))


def with_model(cells: DataFrame, models: DataFrame, keys: Sequence[str] = DATE) -> DataFrame:
    """Cells with the model of their date as one struct column ``_model``."""
    one = models.select(*keys, F.struct("mu0", "sigma0", "p0", "first", "curve").alias("_model"))
    return join_groups(cells, one, keys, "left")


def loss_probability(cells: DataFrame, z: str, models: DataFrame, out: str, *, keys: Sequence[str] = DATE, bin_w: float = P.DECIDE["bin_w"]) -> DataFrame:
    """Posterior of loss, ``1 - lfdr``; null for cells without z or dates without a model."""
    return with_model(cells, models, keys).withColumn(out, 1.0 - interpolate(F.col(z), F.col("_model"), bin_w)).drop("_model")


def likelihood_ratio(cells: DataFrame, z: str, models: DataFrame, out: str = "llr", *, min_prior: float = 0.0, keys: Sequence[str] = DATE, bin_w: float = P.DECIDE["bin_w"]) -> DataFrame:
    """Posterior minus prior log-odds of loss, 0 where unknown."""
    df = with_model(cells, models, keys)
    lf = interpolate(F.col(z), F.col("_model"), bin_w)
    lf = F.when(lf.isNotNull(), F.least(F.lit(LFDR_CLIP[1]), F.greatest(F.lit(LFDR_CLIP[0]), lf)))
    value = logit(1.0 - lf) - logit(prior_of(F.col("_model.p0"), min_prior))
    return df.withColumn(out, F.coalesce(value, F.lit(0.0))).drop("_model")


def date_models(cells: DataFrame, z: str, where: str, *, keys: Sequence[str] = DATE, rule: Mapping = P.DECIDE) -> tuple[DataFrame, DataFrame]:
    """Models of the dates with enough cells, and one fit row for every date (skipped ones too)."""
    keys = list(keys)
    use = F.col(where) & F.col(z).isNotNull()
    size = cut_lineage(cells.groupBy(*keys).agg(F.count(F.when(use, 1)).alias("n_cells")))
    enough = size.where(F.col("n_cells") >= rule["min_fit_cells"])
    rows = join_groups(cells, enough.select(*keys), keys, "left_semi")
    null = cut_lineage(fit_null(rows, z, where, keys=keys, pct0=rule["pct0"], bin_w=rule["bin_w"]))
    models = cut_lineage(lfdr_curves(rows, z, where, null, keys=keys, bin_w=rule["bin_w"], smooth_bins=rule["smooth_bins"]))
    return models, fit_rows(size, null, keys)


def fit_rows(size: DataFrame, null: DataFrame, keys: Sequence[str]) -> DataFrame:
    fits = size.join(null.select(*keys, "mu0", "sigma0", "p0", "method"), list(keys), "left")
    return fits.withColumn("skipped", F.col("method").isNull()).withColumn("method", F.coalesce("method", F.lit("skipped")))


def field_models(cells: DataFrame, fields: Mapping[str, Column], *, pct0: Mapping[str, float] | None = None, rule: Mapping = P.DECIDE) -> tuple[DataFrame, DataFrame]:
    """Null and curve of several fields of every date in one pass.

    ``fields`` maps a name to its value, null where the cell is not in use. Returns the
    nulls (unit, t, field, ...) and one row per date with a map from field to model.
    """
    long = cells.select(*DATE, F.inline(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("x")) for n, v in fields.items()]))).where("x IS NOT NULL")
    keys = [*DATE, "field"]
    null = cut_lineage(fit_null(long, "x", keys=keys, pct0=rule["pct0"], bin_w=rule["bin_w"]))
    curves = lfdr_curves(long, "x", None, null, keys=keys, bin_w=rule["bin_w"], smooth_bins=rule["smooth_bins"])
    entry = F.struct("field", F.struct("mu0", "sigma0", "p0", "first", "curve").alias("model"))
    return null, cut_lineage(curves.groupBy(*DATE).agg(F.map_from_entries(F.collect_list(entry)).alias("models")))


def spatial_probability(cells: DataFrame, z: str, where: str, sigmas: Sequence[float], out: str, *, gain: bool = False, rule: Mapping = P.DECIDE) -> DataFrame:
    """Highest posterior over smoothing scales, 0 where unknown; with ``gain`` of the mirrored field."""
    sign = -1.0 if gain else 1.0
    smooth = {f"_s{i}": (sign * F.col(z), F.col(where), s) for i, s in enumerate(sigmas)}
    df = cut_lineage(smooth_fields(cells, smooth))
    _null, models = field_models(df, {n: F.col(n) for n in smooth}, rule=rule)
    df = posteriors(join_groups(df, models, DATE, "left"), {f"_p{n}": (n, F.col(n)) for n in smooth}, rule["bin_w"])
    probs = [F.coalesce(F.col(f"_p{n}"), F.lit(0.0)) for n in smooth]
    return df.withColumn(out, F.greatest(F.lit(0.0), *probs)).drop("models", *smooth, *[f"_p{n}" for n in smooth])


def bh_reject(cells: DataFrame, z: str, null: DataFrame, *, q: float = 0.05, keys: Sequence[str] = DATE) -> DataFrame:
    """Benjamini-Hochberg on the lower tail: adds ``p_value`` and ``rejected``.

    The normal distribution function is a rational approximation (Abramowitz and Stegun
    26.2.17, absolute error below 7.5e-8).
    """
    keys = list(keys)
    df = join_groups(cells, cut_lineage(null.select(*keys, "mu0", "sigma0")), keys)
    u = F.try_divide(F.col(z) - F.col("mu0"), F.col("sigma0"))
    df = df.withColumn("p_value", normal_cdf(u)).drop("mu0", "sigma0")
    ranked = ordered_counts(df.where(F.col("p_value").isNotNull()), keys, "p_value", None, sums={"n": F.lit(1)})
    rank = F.col("n_below") + F.col("n")
    cut = cut_lineage(ranked.where(F.col("p_value") <= q * rank / F.col("n_total")).groupBy(*keys).agg(F.max("p_value").alias("_cut")))
    return join_groups(df, cut, keys, "left").withColumn("rejected", holds(F.col("p_value") <= F.col("_cut"))).drop("_cut")


def normal_cdf(u: Column) -> Column:
    # fixed values: coefficients of the approximation
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    x = F.abs(u)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-0.5 * x * x) / (2 * pi) ** 0.5 * poly
    return F.when(u < 0, tail).otherwise(1.0 - tail)


# --- decision rules -------------------------------------------------------------------
def sigmas_in_cells(cell_m: float, rule: Mapping = P.DECIDE) -> list[float]:
    return [s / cell_m for s in rule["spatial_sigma_m"]]


def decide_flags(cells: DataFrame, rule_name: str, cell_m: float = P.GRAIN_M, *, z: str = "z", rule: Mapping = P.DECIDE) -> tuple[DataFrame, DataFrame]:
    """Flags and probability of a named rule, and the fit of every date.

    D1 threshold, D2 posterior, D5 spatial support, D6 with the rebound check at the next
    date, D7 with the two-step changes (``back_z``, ``forward_z``); a trailing ``s`` is strict.
    Probability is null where the cell is not monitored or the date was skipped. All smoothed
    fields of a rule are fitted together, so the cells are read a fixed number of times.
    """
    name, strict = rule_name.rstrip("s"), rule_name.endswith("s")
    if name not in ("D1", "D2", "D5", "D6", "D7"):
        raise ValueError(f"Unknown decision rule {rule_name!r}")
    sides = {"D7": ["back_z", "forward_z"]}.get(name, [])
    missing = [c for c in sides if c not in cells.columns]
    if missing:
        raise ValueError(f"Rule {rule_name} needs the two-step changes {missing}")
    least, bin_w, half = rule["min_fit_cells"], rule["bin_w"], rule["p_boundary"]
    df = cells
    if name == "D6":
        df = df.withColumn("_next", F.lead(z).over(over_dates()))
        sides = ["_next"]
    values = [z, *sides]
    # a date takes part in a check when enough monitored cells have the value
    n = {v: F.count(F.when(F.col("monitored") & F.col(v).isNotNull(), 1)) for v in values}
    size = cut_lineage(df.groupBy(*DATE).agg(*[c.alias(f"_n_{v}") for v, c in n.items()]))
    own = size.select(*DATE, F.col(f"_n_{z}").alias("n_cells"))
    df = join_groups(df, size, DATE, "left")
    ok = {v: F.col("monitored") & (F.col(f"_n_{v}") >= least) for v in values}
    if name == "D6":
        ok["_next"] = ok["_next"] & (F.col(f"_n_{z}") >= least)
    smooth, names = {}, {v: [] for v in values}
    if name in ("D5", "D6", "D7"):
        for v in values:
            sign = -1.0 if v == "_next" else 1.0
            for i, s in enumerate(sigmas_in_cells(cell_m, rule)):
                smooth[f"_s{i}_{v}"] = (sign * F.col(v), ok[v], s)
                names[v].append(f"_s{i}_{v}")
        df = cut_lineage(smooth_fields(df, smooth))
    fields = {"own": F.when(ok[z], F.col(z)), **{n: F.col(n) for n in smooth}}
    null, models = field_models(df, fields, rule=rule)
    fits = fit_rows(own, null.where("field = 'own'").drop("field"), DATE)
    df = join_groups(df, models, DATE, "left")
    df = posteriors(df, {"_p_own": ("own", F.col(z)), **{f"_p{n}": (n, F.col(n)) for n in smooth}}, bin_w)
    decided = F.col("monitored") & (F.col(f"_n_{z}") >= least)
    mine = F.col("_p_own")
    drop = ["models", "_p_own", *[f"_p{n}" for n in smooth], *smooth, *[f"_n_{v}" for v in values], *(["_next"] if name == "D6" else [])]
    if name == "D1":
        hit, p = F.col("monitored") & (F.col(z) <= -rule["baseline_z"]), F.lit(None).cast("double")
    elif name == "D2":
        hit, p = decided & (mine > half), F.coalesce(mine, F.lit(0.0))
    else:
        best = lambda v: F.greatest(F.lit(0.0), *[F.coalesce(F.col(f"_p{n}"), F.lit(0.0)) for n in smooth if n in names[v]])
        p = best(z)
        if name == "D6":
            p = p * (1.0 - best("_next"))
        for v in sides if name == "D7" else []:
            p = F.least(p, F.when(ok[v] & F.col(v).isNotNull(), best(v)))
        floor = F.lit(half) if strict else prior_of(F.col("models")["own"]["p0"], rule["min_prior"])
        hit = decided & (mine > floor) & (p > half)
    df = df.withColumns({"flag": holds(hit), "probability": F.when(decided, p)})
    return df.drop(*drop), fits


def standardize(cells: DataFrame, value: str, population: str, method: str, size: int, *, cell_m: float = P.GRAIN_M, rule: Mapping = P.DECIDE) -> DataFrame:
    """z of every date by method: scene, scenemean, local, local_twopass.

    The second local pass leaves out cells of spatially supported loss, so that a large
    event does not set its own baseline.
    """
    from sylvaflow.operators.cells import local_z, scene_z

    if method in ("scene", "scenemean"):
        return scene_z(cells, value, population, robust=method == "scene")
    first = local_z(cells, value, population, size, out="z")
    if method == "local":
        return first
    if method != "local_twopass":
        raise ValueError(f"Unknown method {method!r}")
    use = first.withColumn("_use", holds(F.col(population) & F.col("z").isNotNull()))
    p = spatial_probability(use, "z", "_use", sigmas_in_cells(cell_m, rule), "_p", rule=rule)
    calm = p.withColumn("_calm", F.col(population) & ~(F.col("_p") > rule["p_boundary"])).drop("z", "_p", "_use")
    return local_z(calm, value, "_calm", size, out="z").drop("_calm")
