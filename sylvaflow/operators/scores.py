"""Accuracy: histograms, curves, weighted scores, exact intervals, rank statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import finite, holds, random_key, share
from sylvaflow.functions.scalars import interval_timing, popescu_width, open_grown_width
from sylvaflow.operators.ranks import exact_quantiles, ordered_counts

# --- histogram scores -----------------------------------------------------------------
BINS = 101


def percent_histogram(cells: DataFrame, keys: Sequence[str], percent: str = "percent", target: str = "target") -> DataFrame:
    """Counts of lost and kept cells per percent of every group; partial counts add up."""
    known = F.col(percent).between(0, 100) & F.col(target).isin(0, 1)
    return cells.where(known).groupBy(*keys, F.col(percent).cast("int").alias("p")).agg(
        F.sum((F.col(target) == 1).cast("bigint")).alias("pos"), F.sum((F.col(target) == 0).cast("bigint")).alias("neg")
    )


def score_curve(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and IoU of every threshold from 1 to 100 percent."""
    keys = list(keys)
    frame = hist.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(100))).alias("p"))
    full = frame.join(hist, [*keys, "p"], "left").fillna(0, ["pos", "neg"])
    up = W.partitionBy(*keys).orderBy("p").rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(*keys)
    tp, fp, pos, neg = F.sum("pos").over(up), F.sum("neg").over(up), F.sum("pos").over(whole), F.sum("neg").over(whole)
    c = full.select(*keys, "p", "pos", "neg", tp.alias("tp"), fp.alias("fp"), pos.alias("n_pos"), (pos + neg).alias("n_valid"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp")
    return c.select(
        *keys, "p", (F.col("p") / 100).alias("threshold"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("iou"), "n_pos", "n_valid", "pos", "tp", "fp",
    )


def curve_summary(curve: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Average precision, best F1 with its threshold, and the scores at one half and a given threshold."""
    cut = round(threshold * 100)
    p = F.col("p")
    called = F.col("tp") + F.col("fp")
    step = F.try_divide(F.col("pos"), F.col("n_pos")) * F.when(called > 0, F.col("tp") / called).otherwise(1.0)
    at = lambda c, t: F.max(F.when(p == t, F.col(c)))
    best = F.when(p >= 1, F.struct(F.coalesce("f1", F.lit(-1.0)).alias("f"), (-p).alias("q")))
    out = curve.groupBy(*keys).agg(
        F.max("n_valid").alias("cells"), F.max("n_pos").alias("loss_cells"), F.when(F.max("n_pos") > 0, F.sum(step)).alias("average_precision"), F.max(best).alias("_b"),
        *[at(c, t).alias(f"{c}_{n}") for n, t in (("050", 50), ("val", cut)) for c in ("precision", "recall", "f1", "iou")],
    )
    f = F.col("_b.f")
    return out.withColumns({"best_f1": F.when(f >= 0, f), "best_f1_threshold": -F.col("_b.q") / 100}).drop("_b")


def interval_scores(cells: DataFrame, threshold: float, *, interval: str = "interval") -> DataFrame:
    """Both sources on their common cells, per interval and over all: columns model, di, target."""
    both = cells.where(F.col("model").between(0, 100) & F.col("di").between(0, 100))
    long = both.select(F.inline(F.array(*[F.struct(F.col(interval).alias("interval"), F.lit(s).alias("source"), F.col(s).alias("percent"), F.col("target").alias("target")) for s in ("model", "di")])))
    hist = percent_histogram(long, ["interval", "source"])
    total = hist.groupBy("source", "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select(F.lit("all").alias("interval"), "source", "p", "pos", "neg")
    return curve_summary(score_curve(hist.unionByName(total), ["interval", "source"]), ["interval", "source"], threshold)


def confusion(cells: DataFrame, names: Sequence[str], *, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Confusion counts per label with its recall, accuracy and balanced accuracy."""
    names = list(names)
    use = cells.where(F.col(label).isin(names) & F.col(predicted).isin(names))
    wide = use.groupBy(label).agg(F.count(F.lit(1)).alias("cells"), *[F.count(F.when(F.col(predicted) == n, 1)).alias(f"as_{n}") for n in names])
    own = None
    for n in names:
        own = F.when(F.col(label) == n, F.col(f"as_{n}")) if own is None else own.when(F.col(label) == n, F.col(f"as_{n}"))
    every = W.partitionBy()
    df = wide.withColumn("recall", own / F.col("cells"))
    return df.withColumns({"accuracy": F.sum(own).over(every) / F.sum("cells").over(every), "balanced_accuracy": F.avg("recall").over(every)})


def object_scores(cells: DataFrame, keys: Sequence[str], cut: int) -> DataFrame:
    """Mean model percent and share above a cut inside each object, over decided cells."""
    p = F.when(F.col("percent") <= 100, F.col("percent"))
    return cells.groupBy(*keys).agg(F.count(p).alias("cells"), F.avg(p).alias("model_mean_percent"), F.avg(F.when(p.isNotNull(), (p >= cut).cast("double"))).alias("model_share_above"))


# --- exact intervals -------------------------------------------------------------------------
def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series ten steps up, and back."""
    y = x + 10.0
    series = (y - 0.5) * F.ln(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for i in range(1, 10):
        product = product * (x + float(i))
    return series - F.ln(product)


def incomplete_beta(a: Column, b: Column, x: Column, scale: Column, terms: Column) -> Column:
    """Regularized incomplete beta function by its continued fraction, from the side where it converges.

    ``scale`` is the logarithm of 1 / B(a, b); ``terms`` the number of pairs of terms.
    """
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        d0 = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))

        def pair(s: Column, i: Column) -> Column:
            m = i.cast("double")
            even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            one = F.struct((1.0 / safe(1.0 + even * s["d"])).alias("d"), safe(1.0 + even / s["c"]).alias("c"), s["h"].alias("h"))
            two = lambda t: F.struct((1.0 / safe(1.0 + odd * t["d"])).alias("d"), safe(1.0 + odd / t["c"]).alias("c"), (t["h"] * t["d"] * t["c"]).alias("h"))
            done = lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"), (t["h"] * t["d"] * t["c"]).alias("h"))
            return F.get(F.transform(F.transform(F.array(one), two), done), F.lit(0))

        start = F.struct(d0.alias("d"), F.lit(1.0).alias("c"), d0.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), terms), start, pair, lambda s: s["h"])

    front = F.exp(scale + a * F.ln(x) + b * F.ln(1.0 - x))
    left = x < (a + 1.0) / (a + b + 2.0)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(left, front * fraction(a, b, x) / a).otherwise(1.0 - front * fraction(b, a, 1.0 - x) / b)


def exact_interval(k: Column, n: Column, level: float = 0.95, steps: int = 60) -> Column:
    """Clopper-Pearson interval by bisection of the incomplete beta function: ``struct(low, high)``.

    The number of terms grows with the square root of ``n`` at most, nothing of length ``n`` is built.
    """
    tail = (1.0 - level) / 2.0
    k, n = k.cast("double"), n.cast("double")
    terms = (F.lit(20) + F.ceil(F.sqrt(n) * 2)).cast("int")

    def bisect(a: Column, b: Column, goal: float) -> Column:
        fixed = F.array(F.struct(a.alias("a"), b.alias("b"), (log_gamma(a + b) - log_gamma(a) - log_gamma(b)).alias("scale"), terms.alias("terms")))
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def search(f: Column) -> Column:
            def step(s: Column, _i: Column) -> Column:
                mid = (s["lo"] + s["hi"]) / 2.0
                low = incomplete_beta(f["a"], f["b"], mid, f["scale"], f["terms"]) < goal
                return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

            return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2.0)

        return F.get(F.transform(fixed, search), F.lit(0))

    return F.struct(
        F.when(n == 0, None).when(k == 0, 0.0).otherwise(bisect(k, n - k + 1.0, tail)).alias("low"),
        F.when(n == 0, None).when(k == n, 1.0).otherwise(bisect(k + 1.0, n - k, 1.0 - tail)).alias("high"),
    )


def judged_table(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers with their items: flags for loss, unsure, same interval and same cause, and the weight."""
    t = answers.join(items, "item")
    labelled = F.transform(F.filter(F.split("label_images", ","), lambda x: x != ""), lambda x: x.cast("int"))
    named = F.array_compact(F.concat(F.array("loss_at"), F.coalesce("more_at", F.array().cast("array<int>"))))
    known = (F.coalesce("agent", F.lit("")) != "") & (F.coalesce("type", F.lit("")) != "")
    t = t.withColumns({
        "is_loss": F.col("answer") == "loss", "unsure": F.col("answer") == "unsure",
        "same_interval": F.when(F.size(labelled) > 0, F.arrays_overlap(labelled, named)), "same_type": F.when(known, F.col("type") == F.col("agent")),
    })
    n = t.groupBy("interpreter", "sub").agg(F.count(F.lit(1)).alias("_judged"))
    return t.join(n, ["interpreter", "sub"]).withColumn("weight", 1.0 / (F.col("window_incl_prob") * F.col("_judged") / F.col("n_population"))).drop("_judged")


def rates(judged: DataFrame) -> DataFrame:
    """Rates per interpreter, stratum and measure: counts, exact interval, weighted rate."""
    sure, loss = ~F.col("unsure"), ~F.col("unsure") & F.col("is_loss")
    outline = F.when(F.coalesce("outline", F.lit("")) != "", F.col("outline") == "good") if "outline" in judged.columns else F.lit(None).cast("boolean")
    every = ["accepted", "rejected", "disagree", "background", "model_only"]
    measures = [
        ("loss seen", every, sure, F.col("is_loss")),
        ("loss in labelled interval", ["accepted"], sure, F.col("same_interval")),
        ("cause equals label agent", ["accepted"], loss, F.col("same_type")),
        ("label extent holds", ["accepted"], loss, outline),
        ("loss in model interval", ["model_only"], sure, F.col("same_interval")),
        ("cause equals model agent", ["model_only"], loss, F.col("same_type")),
    ]
    item = lambda name, strata, use, flag: F.struct(F.lit(name).alias("measure"), F.when(F.col("stratum").isin(strata), F.lit(True)).alias("on"), F.when(use, flag).alias("flag"))
    rows = judged.select("interpreter", "stratum", "weight", F.inline(F.array(*[item(*m) for m in measures]))).where("on")
    agg = rows.groupBy("interpreter", "stratum", "measure").agg(
        F.count("flag").alias("n"), F.count(F.when(F.col("flag"), 1)).alias("k"),
        share(F.sum(F.when(F.col("flag"), F.col("weight")).when(F.col("flag").isNotNull(), 0.0)), F.sum(F.when(F.col("flag").isNotNull(), F.col("weight")))).alias("weighted_rate"),
    )
    base = judged.groupBy("interpreter", "stratum").agg(F.count(F.when(F.col("unsure"), 1)).alias("unsure"))
    mid = exact_quantiles(judged, ["interpreter", "stratum"], "seconds", {"median_seconds": 0.5}, 1.0)
    ci = exact_interval(F.col("k"), F.col("n"))
    out = agg.withColumn("_ci", ci).withColumns({"rate": share(F.col("k"), F.col("n")), "low": F.col("_ci.low"), "high": F.col("_ci.high")}).drop("_ci")
    return out.join(base, ["interpreter", "stratum"]).join(mid, ["interpreter", "stratum"], "left")


def agreement(judged: DataFrame, interpreters: Sequence[str]) -> DataFrame:
    """Items judged by several: the answer of each and whether all are the same."""
    agg = judged.groupBy("item", "stratum").agg(
        *[F.max(F.when(F.col("interpreter") == i, F.col("answer"))).alias(i) for i in interpreters], F.count("answer").alias("n"), F.min("answer").alias("_a"), F.max("answer").alias("_b")
    )
    return agg.where("n > 1").withColumn("all_agree", F.col("_a") == F.col("_b")).drop("_a", "_b")


# --- review ---------------------------------------------------------------------------------------
def labelled_sample(sample: DataFrame, labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Reviewed objects with timing, weight, and IoU and area ratio against the redrawn cells.

    ``cells`` lists (sample_id, row, col, detected, redrawn).
    """
    n = lambda c: F.count(F.when(c, 1))
    d, r = F.col("detected"), F.col("redrawn")
    shape = cells.groupBy("sample_id").agg(n(d & r).alias("_i"), n(d | r).alias("_u"), n(d).alias("_d"), n(r).alias("_r")).where("_r > 0")
    df = sample.join(labels, "sample_id").join(shape, "sample_id", "left").withColumn("is_true", F.col("verdict").isin(P.TRUE_VERDICTS))
    return df.withColumns({
        "timing": F.when(F.col("is_true"), interval_timing(F.col("interval"), F.col("ref_interval"))).otherwise(""),
        "weight": 1.0 / F.col("incl_prob"), "iou": share(F.col("_i"), F.col("_u")), "area_ratio": share(F.col("_d"), F.col("_r")),
    }).drop("_i", "_u", "_d", "_r")


FITS = ["about_right", "too_large", "too_small", "wrong_shape"]


def review_scores(labelled: DataFrame) -> DataFrame:
    """Scores per unit, pooled with weights, and the plain mean (sum of counts) over units."""
    rows = labelled.withColumn("_lv", F.explode(F.array(F.col("unit"), F.lit("pooled")))).withColumn("_w", F.when(F.col("_lv") == "pooled", F.col("weight")).otherwise(1.0))
    w, true = F.col("_w"), F.col("is_true")

    def mean(flag: Column, among: Column, weight: Column = w) -> Column:
        ok = among & flag.isNotNull() & weight.isNotNull()
        return share(F.sum(F.when(ok, weight * flag.cast("double"))), F.sum(F.when(ok, weight)))

    decided, every = F.col("verdict") != "uncertain", F.lit(True)
    n = lambda c: F.count(F.when(c, 1))
    agg = rows.groupBy(F.col("_lv").alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), n(true).alias("n_true"), n(F.col("verdict") == "rejected").alias("n_rejected"), n(F.col("verdict") == "uncertain").alias("n_uncertain"),
        mean(F.col("verdict") == "uncertain", every).alias("uncertain_share"), mean(true, decided).alias("precision"), mean(true, decided, w * F.col("assessed_ha")).alias("area_precision"),
        mean(F.col("timing") == "match", true & (F.col("timing") != "unsure")).alias("timing_match"), n(true & (F.col("timing") == "detected_late")).alias("n_late"),
        n(true & (F.col("timing") == "detected_early")).alias("n_early"), mean(F.col("outline") == "about_right", true & holds(F.col("outline").isin(FITS))).alias("outline_ok"), F.count("iou").alias("n_redrawn"),
    )
    mids = {"iou": 1 / 256, "area_ratio": 1 / 64, "seconds_spent": 1.0}
    for c, width in mids.items():
        agg = agg.join(exact_quantiles(rows.withColumn("unit", F.col("_lv")), ["unit"], c, {f"{c}_median": 0.5}, width), "unit", "left")
    counts = ["n", "n_true", "n_rejected", "n_uncertain", "n_late", "n_early", "n_redrawn"]
    rates_ = [c for c in agg.columns if c not in (*counts, "unit")]
    mean_row = agg.where("unit <> 'pooled'").agg(*[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(c) for c in rates_]).withColumn("unit", F.lit("site_mean"))
    return agg.unionByName(mean_row)


def change_type_counts(labelled: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("change_type"), F.lit("")), F.lit("(none)"))
    return labelled.groupBy("verdict", kind.alias("change_type")).agg(F.count(F.lit(1)).alias("n"))


# --- rank statistics ------------------------------------------------------------------------------
def separation(values: DataFrame, keys: Sequence[str], value: str, phase: str, width: float, *, least: int = 3) -> DataFrame:
    """Rank AUC (ties share their average rank) and standardized difference of post against pre."""
    keys = list(keys)
    post, pre = F.when(F.col(phase) == "post", 1).otherwise(0), F.when(F.col(phase) == "pre", 1).otherwise(0)
    use = values.select(*keys, finite(value).alias("_v"), phase).where(F.col(phase).isin("pre", "post") & F.col("_v").isNotNull())
    ranked = ordered_counts(use, keys, "_v", width, sums={"post": post, "pre": pre})
    # every post value scores the pre values below it and half of those it ties with
    wins = ranked.groupBy(*keys).agg(F.sum(F.col("post") * (F.col("pre_below") + F.col("pre") / 2.0)).alias("_u"))
    m = use.groupBy(*keys).agg(
        *[f(F.when(F.col(phase) == p, F.col("_v"))).alias(f"{n}_{p}") for p in ("pre", "post") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    a, b = F.col("n_pre"), F.col("n_post")
    enough = (a >= least) & (b >= least)
    pooled = F.sqrt(F.try_divide((a - 1) * F.col("var_pre") + (b - 1) * F.col("var_post"), (a + b - 2)))
    auc = F.when(enough, F.try_divide(F.col("_u"), a * b))
    return m.join(wins, keys, "left").select(
        *keys, "n_pre", "n_post", F.col("mean_pre").alias("pre_mean"), F.col("mean_post").alias("post_mean"), auc.alias("auc"),
        F.when(enough & (pooled > 0), (F.col("mean_post") - F.col("mean_pre")) / pooled).alias("cohens_d"), (F.abs(auc - 0.5) * 2).alias("separation"),
    )


def event_phase(year: Column, last_pre: Column, first_post: Column) -> Column:
    return F.when(last_pre.isNull() | first_post.isNull(), "unknown").when(year <= last_pre, "pre").when(year >= first_post, "post").otherwise("during")


def separation_table(frame: DataFrame, metrics: Mapping[str, float], group: str = "dist_group") -> DataFrame:
    """Separation of every metric per disturbance group and over all groups; metric -> bucket width."""
    phase = event_phase(F.col("year"), F.col("last_pre"), F.col("first_post"))
    wide = frame.withColumn("phase", phase).where(F.col("phase").isin("pre", "post"))
    item = [F.struct(F.lit(m).alias("metric"), (finite(m) / w).alias("value"), F.lit(float(w)).alias("_w")) for m, w in metrics.items()]
    level = wide.select("*", F.explode(F.array(F.lit("all"), F.col(group))).alias("group")).where(F.col("group").isNotNull())
    long = level.select("group", "phase", F.inline(F.array(*item)))
    scale = long.select("metric", "_w").distinct()
    out = separation(long, ["group", "metric"], "value", "phase", 1.0).join(scale, "metric")
    return out.withColumns({c: F.col(c) * F.col("_w") for c in ("pre_mean", "post_mean")}).drop("_w")


def spearman(pairs: DataFrame, x: str, y: str, width_x: float | None = None, width_y: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation over complete pairs, ties with their average rank, and the number of pairs."""
    keys = list(keys)
    use = pairs.select(*keys, finite(x).alias("_x"), finite(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    rank = lambda c, w: ordered_counts(use, keys, c, w).select(*keys, c, (F.col("n_below") + (F.col("n") + 1) / 2.0).alias(f"_r{c}"))
    both = use.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_n")).join(rank("_x", width_x), [*keys, "_x"]).join(rank("_y", width_y), [*keys, "_y"])
    n, a, b = F.col("_n"), F.col("_r_x"), F.col("_r_y")
    s = lambda e: F.sum(n * e)
    N = F.sum(n)
    rho = F.try_divide(N * s(a * b) - s(a) * s(b), F.sqrt((N * s(a * a) - s(a) ** 2) * (N * s(b * b) - s(b) ** 2)))
    return both.groupBy(*keys).agg(N.alias("n"), F.when(N >= 3, rho).alias("rho"))


# --- crown study --------------------------------------------------------------------------------------
def tile_crowns(crowns: DataFrame, keys: Sequence[str], *, inset_m: float = 15.0) -> DataFrame:
    """Crown statistics per tile without crowns at its edge, with the fit to the allometry.

    ``crowns`` carries the tile box and canopy area. The fit uses crowns that the radius
    ceiling did not shape and needs ten of them.
    """
    keys = list(keys)
    inner = F.col("x").between(F.col("minx") + inset_m, F.col("maxx") - inset_m) & F.col("y").between(F.col("miny") + inset_m, F.col("maxy") - inset_m)
    area = F.greatest((F.col("maxx") - F.col("minx") - 2 * inset_m) * (F.col("maxy") - F.col("miny") - 2 * inset_m) / 1e4, F.lit(1e-9))
    df = crowns.withColumns({"_in": inner, "_d": F.when(inner, F.col("crown_diam_m").cast("double")), "_h": F.when(inner, F.col("apex_h_m").cast("double"))})
    pred = popescu_width(F.col("_h"))
    free = F.col("_in") & (F.col("capped_frac") <= 0.05)
    d, resid = F.col("_d"), F.when(free, F.col("_d") - pred)
    x, y = F.when(free, pred), F.when(free, F.col("_d"))
    agg = df.groupBy(*keys).agg(
        F.count("_d").alias("n_crowns"), (F.count("_d") / F.first(area)).alias("density_per_ha"), F.avg(d).alias("diam_mean"), share(F.stddev_pop(d), F.avg(d)).alias("diam_cv"), F.avg("_h").alias("apex_mean"),
        F.avg(F.when(F.col("_in"), (F.col("capped_frac") > 0.05).cast("double"))).alias("capped_fraction"), share(F.sum("area_m2"), F.first("canopy_m2")).alias("assigned_fraction"),
        F.count(resid).alias("_free"), F.regr_slope(y, x).alias("allo_slope"), F.regr_intercept(y, x).alias("allo_intercept"), F.sqrt(F.avg(resid * resid)).alias("allo_rmse"),
        F.avg(resid).alias("allo_bias"), F.stddev_pop(resid).alias("allo_scatter"), F.avg(F.when(F.col("_in"), (d > open_grown_width(F.col("_h"))).cast("double"))).alias("over_open_grown"),
    )
    q = exact_quantiles(df, keys, "_d", {"diam_median": 0.5, "diam_p90": 0.9}, 0.25)
    allo = [c for c in agg.columns if c.startswith("allo_")]
    few = F.col("n_crowns") < 3
    out = agg.join(q, keys, "left").withColumns({c: F.when(F.col("_free") >= 10, F.col(c)) for c in allo}).drop("_free")
    return out.withColumns({c: F.when(~few, F.col(c)) for c in out.columns if c not in (*keys, "n_crowns")})


def sweep_means(tiles: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean over tiles per parameter set; a missing parameter is a value of its own."""
    return tiles.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_tiles"))


def bootstrap_support(pool: DataFrame, value: str, sizes: Sequence[int], replicates: int, seed: int, band: float) -> DataFrame:
    """Spread of the coefficient of variation over resamples of each size against a band width.

    Draws pick rows of the pool, in the order of the values, by a stable key. Every distinct
    value holds a range of numbers, and the draws, sizes x replicates x n rows, find theirs.
    """
    from sylvaflow.session import cut_lineage

    rows = pool.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(value))
    ranges = cut_lineage(ordered_counts(rows, [], value, None))
    size = F.coalesce(ranges.agg(F.max("n_total")).scalar(), F.lit(0))
    spark = pool.sparkSession
    frame = spark.createDataFrame([(int(n),) for n in sizes], "n int").where(F.col("n") <= size)
    draws = frame.select("n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b")).select("n", "b", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j"))
    pick = F.floor(random_key(seed, F.concat_ws(":", "n", "b", "j")) * size).cast("bigint")
    drawn = _in_range(draws.withColumn("i", pick), ranges, value)
    cv = drawn.groupBy("n", "b").agg(F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv"))
    q = exact_quantiles(cv, ["n"], "cv", {"ci90_low": 0.05, "ci90_high": 0.95}, 1 / 256)
    m = cv.groupBy("n").agg(F.avg("cv").alias("cv_mean"), F.stddev_pop("cv").alias("cv_std"))
    width = F.col("ci90_high") - F.col("ci90_low")
    se = F.col("cv_mean") * F.sqrt((1.0 + 2.0 * F.col("cv_mean") ** 2) / (2.0 * F.col("n")))
    return m.join(q, "n").withColumns({"ci90_width": width, "analytic_se": se, "fits_in_band": width <= band})


def _in_range(draws: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """Draws with the value whose range ``n_below`` to ``n_below + n`` holds their number ``i``.

    The numbers are cut into as many chunks as there are values, so a frequent value lies in
    many chunks and a chunk holds few values: the join is an equality on the chunk.
    """
    chunk = ranges.agg(F.greatest(F.floor(F.max("n_total") / F.count(F.lit(1))), F.lit(1))).scalar()
    spans = F.sequence(F.floor(F.col("n_below") / chunk), F.floor((F.col("n_below") + F.col("n") - 1) / chunk))
    placed = ranges.select(value, F.col("n_below").alias("_first"), (F.col("n_below") + F.col("n")).alias("_stop"), F.explode(spans).alias("_chunk"))
    both = draws.withColumn("_chunk", F.floor(F.col("i") / chunk)).join(placed, "_chunk")
    return both.where("i >= _first AND i < _stop").drop("_chunk", "_first", "_stop")


def narrowest_band(envelopes: Mapping = P.ENVELOPES["type_00"], metric: str = "crown_cv") -> float:
    bands = [e[metric] for e in envelopes.values() if metric in e]
    widths = [hi - lo for lo, hi in bands if lo is not None and hi is not None and hi > lo]
    return min(widths) if widths else 0.10
