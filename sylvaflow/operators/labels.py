"""Training labels: reasons of every pixel, label chips, chip index and diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import holds, lookup
from sylvaflow.functions.scalars import change_label, reason_group
from sylvaflow.operators.cells import distances

PIXEL_M = 0.6
PIXEL = ["window_id", "k", "row", "col"]
LAYER = "struct<p:int,s:bigint,reason:int,agent:int>"

# Reasons in the order in which a later one overwrites an earlier one.
PRIORITY = {
    "base": 0, "under_min": 1, "margin": 2, "judged_intact": 3, "verdict": 4, "trimmed": 5,
    "extension_ignored": 6, "loss": 7, "boundary_outside": 8, "boundary_inside": 9, "no_data": 10,
}
_VERDICT = {
    "disagree": "disagree", "date_disputed": "date_disputed", "rejected_flagged": "rejected_flagged", "rejected_weak": "rejected_weak",
    "failed": "verdict_failed", "unjudged": "unjudged", "flagged_unconfirmed": "flagged_unconfirmed", "loss_repeated": "loss_repeated", "stressed": "canopy_stressed",
}
_QUIET = {"intact": "judged_intact", "open": "post_event_open", "stressed_recovered": "stressed_recovered"}
_LOSS = {
    "loss_full": ("accepted_full", "extension_full"), "loss_partial": ("accepted_partial", "extension_partial"),
    "loss_disputed": ("accepted_severity_disputed", "extension_partial"),
}


def _px(metres: float) -> int:
    return int(round(metres / PIXEL_M))


def base_reason(rule: Mapping = P.RULES) -> Column:
    """Reason of a pixel without any candidate, from its forest state before and after."""
    before, after = F.col("forest_before"), F.col("forest_after")
    if_green = lambda c: c & ~holds(F.col("never_green"))
    before, after = if_green(before), if_green(after)
    woody = if_green(holds(F.col("cover_before") >= rule["sparse_cover"]) | holds(F.col("height_before") >= rule["sparse_height_m"]))
    code = P.REASONS
    return (
        F.when(before & holds(F.col("prob") >= rule["raised_prob"]), code["raised_prob"])
        .when(before & ~after, code["forest_lost_unjudged"])
        .when(before & after, F.when(F.col("unstable"), code["unstable_forest"]).otherwise(code["stable_forest"]))
        .when(woody, code["sparse_woody"])
        .otherwise(code["nonforest"])
    )


def interval_reasons(pixels: DataFrame, parts: DataFrame, rule: Mapping = P.RULES) -> DataFrame:
    """Reason, agent and change label of every pixel and interval of a window.

    ``pixels``: PIXEL, forest_before, forest_after, cover_before, height_before, prob,
    unstable, never_green, no_data. ``parts``: PIXEL, cand_id, seq (order of candidates),
    outcome, part (core, extension, trimmed, or mask for candidates without a loss), crisp,
    precise, wide_margin, oversize, agent.

    Every layer gives ``(priority, order, reason)`` and the highest one of a pixel counts. The
    candidates of a pixel are folded to one row before they meet it, so that a pixel is one row
    from then on. Rings and bands come from one distance field per mask, all in one pass over the
    pixels, so a wide margin costs no more than a narrow one. ``pixels`` holds every pixel of a window.
    """
    code = P.REASONS
    loss = F.col("outcome").isin(P.LOSS_OUTCOMES)
    part = F.col("part")
    live = parts.where(F.coalesce("outcome", F.lit("")) != "")
    loose = F.col("oversize") & loss
    inside = part.isin("mask", "core", "trimmed")

    def layer(level: str, reason: Column, seq: Column | None = None, agent: Column | None = None) -> Column:
        s = seq if seq is not None else F.lit(0)
        a = agent if agent is not None else F.lit(P.IGNORE)
        return F.struct(F.lit(PRIORITY[level]).alias("p"), s.cast("bigint").alias("s"), reason.cast("int").alias("reason"), a.cast("int").alias("agent"))

    own = lambda level, reason, agent=None: layer(level, reason, F.col("seq"), agent)
    core = lookup("outcome", {o: code[r[0]] for o, r in _LOSS.items()})
    more = lookup("outcome", {o: code[r[1]] for o, r in _LOSS.items()})
    is_lost = loss & ((part == "core") | ((part == "extension") & F.col("crisp")))
    layers = [
        (inside & (F.col("outcome") == "under_min"), own("under_min", F.lit(code["under_min"]))),
        (inside & F.col("outcome").isin(list(_QUIET)), own("judged_intact", lookup("outcome", {o: code[r] for o, r in _QUIET.items()}))),
        (inside & F.col("outcome").isin(list(_VERDICT)), own("verdict", lookup("outcome", {o: code[r] for o, r in _VERDICT.items()}))),
        (loss & (part == "trimmed"), own("trimmed", F.lit(code["outline_trimmed"]))),
        (is_lost, own("loss", F.when(part == "core", core).otherwise(more), F.coalesce("agent", F.lit(P.IGNORE)))),
    ]
    dim = loss & (part == "extension") & ~F.col("crisp")
    ignored = own("extension_ignored", F.lit(code["extension_ignored"]))
    # ring around candidates whose interior is loss or unlabelled, and bands on both sides of labelled loss
    ring = ~F.col("outcome").isin([*P.BACKGROUND_OUTCOMES, "under_min"]) & (inside | ((part == "extension") & ~loose))
    width = F.when(F.col("wide_margin"), _px(rule["margin_wide_m"])).when(F.col("precise") & loss, _px(rule["margin_precise_m"])).otherwise(_px(rule["margin_m"]))
    widths = sorted({_px(rule["margin_m"]), _px(rule["margin_wide_m"]), _px(rule["margin_precise_m"])})
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    masks = live.groupBy(*PIXEL).agg(
        *[some(ring & (width == w)).alias(f"_ring{w}") for w in widths], some(loss & part.isin("core", "extension")).alias("_foot"),
        some(is_lost & F.col("precise")).alias("_precise"), some(is_lost).alias("_lost"),
        F.max(F.greatest(F.lit(None).cast(LAYER), *[F.when(hit, x) for hit, x in layers])).alias("_own"),
        F.max(F.when(dim, F.when(F.col("oversize") == F.lit(False), ignored))).alias("_dim"), F.max(F.when(dim, ignored)).alias("_dim_any"),
    )
    reason = base_reason(rule)
    ground = pixels.groupBy(*PIXEL).agg(
        F.max(reason).alias("_base"), F.bool_or(F.col("no_data") | F.col("cover_before").isNull()).alias("_gone"),
        F.bool_or(~holds(reason.isin(code["nonforest"]))).alias("_wooded"),
    )
    flags = [c for c in masks.columns if c not in [*PIXEL, "_own", "_dim", "_dim_any"]]
    seen = masks.select(*[F.col(c).alias(f"_at_{c}") for c in PIXEL], *[c for c in masks.columns if c not in PIXEL])
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in PIXEL]
    field = ground.join(seen, same, "left").drop(*[f"_at_{c}" for c in PIXEL]).fillna(False, flags)
    # an extension of an outline that is too large is left out where no forest was
    extension = F.when(F.col("_wooded"), F.col("_dim_any")).otherwise(F.col("_dim"))
    found = F.greatest(layer("base", F.col("_base")), F.when(F.col("_gone"), layer("no_data", F.lit(code["no_data"]))), F.col("_own"), extension)
    field = field.withColumns({"_top": found, "_envelope": F.col("_lost") & ~F.col("_precise")}).drop("_base", "_gone", "_wooded", "_own", "_dim", "_dim_any")
    bands = {name: (_px(rule[f"band_{name}_m"]), _px(rule[f"band_inside_{name}_m"])) for name in ("precise", "envelope")}
    seeds = {f"_to_ring{w}": F.col(f"_ring{w}") for w in widths} | {f"_to_{name}": F.col(f"_{name}") for name in bands} | {"_to_outside": ~F.col("_foot")}
    field = distances(field, seeds, max([*widths, *[w for pair in bands.values() for w in pair]]), PIXEL[:2])
    near = F.lit(False)
    for w in widths:
        near = near | holds(F.col(f"_to_ring{w}") <= w)
    hits = [(near, "margin", "margin")]
    for name, (outer, inner) in bands.items():
        if outer > 0:
            hits.append((holds(F.col(f"_to_{name}") <= outer) & ~F.col("_foot"), "boundary_outside", "boundary_outside"))
        if inner > 0:  # depth counts to pixels of the window only
            hits.append((F.col(f"_{name}") & holds(F.col("_to_outside") <= inner), "boundary_inside", "boundary_inside"))
    top = field.select(*PIXEL, F.greatest("_top", *[F.when(hit, layer(level, F.lit(code[r]))) for hit, level, r in hits]).alias("top"))
    return top.select(*PIXEL, F.col("top.reason").alias("reason"), F.col("top.agent").alias("agent"), change_label(F.col("top.reason")).alias("change"))


# --- chips ------------------------------------------------------------------------------------
def chip_table(pixels: DataFrame, keys: Sequence[str], n_intervals: int) -> DataFrame:
    """One row per chip with JSON lists of background, partial and full pixels per interval.

    ``pixels`` has the keys, k and change. Counts come first, the lists hold one number
    per interval.
    """
    keys = list(keys)
    n = pixels.groupBy(*keys, "k").agg(
        *[F.count(F.when(F.col("change") == v, 1)).alias(name) for v, name in ((0, "background"), (1, "partial"), (2, "full"), (P.IGNORE, "_ignored"))], F.count(F.lit(1)).alias("_n")
    )
    at = lambda c: F.to_json(F.array(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0)) for k in range(n_intervals)]))
    return n.groupBy(*keys).agg(*[at(c).alias(c) for c in ("background", "partial", "full")], (F.sum("_ignored") / F.sum("_n")).alias("ignore_share"), F.max("_n").alias("pixels"))


def chip_index(chips: DataFrame, *, min_valid: float = 0.05) -> DataFrame:
    """Chip rows with JSON lists to one row per chip and interval, with loss and valid share.

    Intervals under the labelled share are left out; a chip listed twice is refused.
    """
    ints, texts = "array<bigint>", "array<string>"
    n = chips.groupBy("chip_id").agg(F.count(F.lit(1)).alias("_times"))
    df = chips.join(n, "chip_id").where(F.when(F.col("_times") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("chip listed twice: "), "chip_id")).cast("boolean")))
    parts = F.arrays_zip(*[F.from_json(c, ints).alias(c) for c in ("background", "partial", "full")])
    df = df.withColumns({"_dates": F.from_json("dates", texts), "_native": F.from_json("native_m", "array<double>"), "_z": parts})
    df = df.select("*", F.posexplode("_z").alias("k", "_v")).where(F.col("k") < F.size("_dates") - 1)
    lost = F.col("_v.partial") + F.col("_v.full")
    keep = [c for c in chips.columns if c not in ("background", "partial", "full", "dates", "native_m")]
    at = lambda c, i: F.get(c, F.col("k") + i)
    out = df.select(
        *keep, "k", F.size("_dates").alias("n_dates"), at("_dates", 0).alias("date_a"), at("_dates", 1).alias("date_b"), at("_native", 0).alias("native_a"), at("_native", 1).alias("native_b"), at("_native", 2).alias("native_c"),
        (lost / F.col("pixels")).alias("loss_share"), ((F.col("_v.background") + lost) / F.col("pixels")).alias("valid_share"),
    )
    return out.where(F.col("valid_share") >= min_valid)


def merge_chips(runs: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Chips of several runs, the first run wins on a chip; window IDs carry the run. Also the counts."""
    if any(":" in name for name in runs):
        raise ValueError("A run name cannot hold a colon")
    every = None
    for i, (name, df) in enumerate(runs.items()):
        one = df.withColumns({"run": F.lit(name), "_order": F.lit(i), "window_id": F.concat(F.lit(f"{name}:"), "window_id")})
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("chip_id").agg(F.min("_order").alias("_first"))
    both = every.join(first, "chip_id")
    won = F.col("_order") == F.col("_first")
    counts = both.groupBy("run").agg(F.count(F.when(won, 1)).alias("kept"), F.count(F.when(~won, 1)).alias("dropped"))
    return both.where(won).drop("_order", "_first"), counts


def band_stats(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Mean and deviation of every band over seen pixels."""
    seen = F.lit(False)
    for b in bands:
        seen = seen | (F.col(b) != 0)
    use = {b: F.when(seen, F.col(b) / 255.0) for b in bands}
    agg = pixels.agg(*[f(c).alias(f"{n}_{b}") for b, c in use.items() for n, f in (("m", F.avg), ("q", lambda x: F.avg(x * x)))])
    sd = lambda b: F.sqrt(F.greatest(F.col(f"q_{b}") - F.col(f"m_{b}") ** 2, F.lit(1e-6)))
    return agg.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"m_{b}").alias("mean"), sd(b).alias("std")) for b in bands])))


def agent_cells(pixels: DataFrame, cell_px: int) -> DataFrame:
    """Loss cells per agent and chip."""
    n = lambda c: (F.count(F.when(F.col("agent") == c, 1)) / float(cell_px * cell_px))
    return pixels.groupBy("chip_id").agg(*[n(c).alias(a) for a, c in P.AGENT_CODES.items()])


# --- diagnostics ------------------------------------------------------------------------------
def group_shares(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of every reason group and class per window and interval."""
    g = reason_group(F.col("reason"))
    f = lambda c: F.avg(c.cast("double"))
    groups = [f(holds(g == name)).alias(name) for name in P.REASON_GROUPS]
    classes = [f(F.col("change") == v).alias(f"class_{n}") for v, n in ((0, "background"), (1, "loss"), (P.IGNORE, "ignore"))]
    return labels.groupBy(*keys).agg(*groups, *classes)


def majority_group(labels: DataFrame, block: int, keys: Sequence[str], pure: float = 0.9) -> DataFrame:
    """Most common reason group of a cell: background groups only where at least ``pure`` of the
    cell is background, otherwise the other groups; ties go to the first group."""
    names = list(P.REASON_GROUPS)
    cell = [*keys, "row", "col"]
    rows = labels.select(*keys, F.floor(F.col("row") / block).cast("int").alias("row"), F.floor(F.col("col") / block).cast("int").alias("col"), reason_group(F.col("reason")).alias("g"))
    agg = rows.groupBy(*cell).agg(*[F.count(F.when(F.col("g") == n, 1)).alias(n) for n in names])
    calm = sum((F.col(n) for n in names if n.startswith("background")), F.lit(0)) >= pure * block * block
    score = lambda n, i: F.struct(F.when(calm == F.lit(n.startswith("background")), F.col(n)).otherwise(-1).alias("n"), F.lit(-i).alias("i"), F.lit(n).alias("name"))
    return agg.select(*cell, F.array_max(F.array(*[score(n, i) for i, n in enumerate(names)]))["name"].alias("majority"))


def strong_cells(z: DataFrame, majority: DataFrame, keys: Sequence[str], strong: float = -3.0) -> DataFrame:
    """Cells of strong greenness loss per interval and majority group."""
    both = z.where(F.col("z") <= strong).join(majority, [*keys, "row", "col"])
    return both.groupBy(*keys, "majority").agg(F.count(F.lit(1)).alias("strong_cells"))


def suspect_clusters(z: DataFrame, majority: DataFrame, keys: Sequence[str], *, strong: float = -3.0, least: int = 4) -> DataFrame:
    """Clusters of strong cells on forest background: size, mean z and box."""
    from sylvaflow.operators.components import drop_small

    cell = [*keys, "row", "col"]
    hit = z.where(F.col("z") <= strong).join(majority.where(F.col("majority") == "background_forest"), cell, "left_semi")
    lab = drop_small(hit, least, keys).join(hit.select(*cell, "z"), cell)
    return lab.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("cells"), F.avg("z").alias("mean_z"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def event_survival(labels: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("window_id", "k")) -> DataFrame:
    """What is left of each accepted event in the labels: area, loss share and inside band share."""
    cell = [*keys, "row", "col"]
    both = candidates.where(F.col("outcome").isin(P.LOSS_OUTCOMES)).select(*cell, "cand_id").distinct().join(labels, cell)
    return both.groupBy(*keys, "cand_id").agg(
        (F.count(F.lit(1)) * PIXEL_M**2 / 1e4).alias("candidate_ha"), F.avg(F.col("change").isin(1, 2).cast("double")).alias("loss_share"),
        F.avg((F.col("reason") == P.REASONS["boundary_inside"]).cast("double")).alias("band_share"),
    )




# --- candidates --------------------------------------------------------------------------------
def window_candidates(cells: DataFrame, visible: DataFrame, cell_ha: float, min_ha: float = P.CANDIDATES["min_ha"]) -> DataFrame:
    """Candidates reaching into a window: visible area, clipped and judged flags.

    ``cells`` are all cells of the candidates, ``visible`` those inside a window_id.
    """
    whole = cells.groupBy("cand_id").agg((F.count(F.lit(1)) * cell_ha).alias("area_ha"))
    seen = visible.groupBy("window_id", "cand_id").agg((F.count(F.lit(1)) * cell_ha).alias("visible_ha"))
    return seen.join(whole, "cand_id").withColumns({
        "clipped": F.col("visible_ha") < 0.98 * F.col("area_ha"), "judged": (F.col("area_ha") >= min_ha) & (F.col("visible_ha") >= min_ha),
    })


def unit_candidates(objects: DataFrame, others: DataFrame, years: DataFrame, refined: DataFrame | None = None) -> DataFrame:
    """Detected, weak and height-loss candidates with one schema.

    ``objects`` as from the detection, ``others`` (unit, t, label, source, n_cells, area_ha, mean_prob).
    """
    from pyspark.sql import Window as W

    from sylvaflow.functions.scalars import interval_label

    fine = refined if refined is not None else objects.select("unit", "object_id", F.lit(None).cast("double").alias("fine_ha")).where("false")
    di = objects.join(fine, ["unit", "object_id"], "left").select(
        F.concat_ws("-", "unit", F.lit("di"), "onset_year", "object_id").alias("cand_id"), "unit", F.lit("di").alias("source"), "interval", F.coalesce("fine_ha", "area_ha").alias("area_ha"),
        F.col("object_id").cast("bigint").alias("object_id"), F.when(F.col("fine_ha").isNotNull(), "refined").otherwise("cells").alias("geom_src"), "mean_prob",
    )
    named = years.withColumn("before", F.lag("year").over(W.partitionBy("unit").orderBy("t")))
    n = F.row_number().over(W.partitionBy("unit", "t").orderBy("label"))
    rest = others.join(named, ["unit", "t"]).select(
        F.concat_ws("-", "unit", "source", "year", n).alias("cand_id"), "unit", "source", interval_label(F.col("before"), F.col("year")).alias("interval"), "area_ha",
        F.lit(-1).cast("bigint").alias("object_id"), F.lit("cells").alias("geom_src"), "mean_prob",
    )
    return di.unionByName(rest)


def eligible_windows(windows: DataFrame, excluded: DataFrame, strata: Sequence[str] = ("di", "other", "quiet")) -> DataFrame:
    """Seeded windows with a known probability that are not excluded."""
    keep = windows.where(F.col("stratum").isin(list(strata)) & F.col("incl_prob").isNotNull())
    return keep.join(excluded.select("window_id"), "window_id", "left_anti")


def absent_files(chips: DataFrame, files: DataFrame, parts: Sequence[str] = ("naip", "change", "aux", "agent")) -> DataFrame:
    """Expected chip files that are not in the listing."""
    want = chips.select(F.explode(F.array(*[F.concat(F.col("chip_id"), F.lit(f"_{p}.tif")) for p in parts])).alias("file"))
    return want.join(files.select("file"), "file", "left_anti")


def window_pixels(cells: DataFrame, window: DataFrame, unstable: DataFrame, imagery: DataFrame, cell_px: int) -> DataFrame:
    """Pixels of a window with the coarse cell layers spread to them, one row per interval.

    ``cells``: unit, t, row, col, forest (dips filled), chm_cover, chm_height, probability;
    ``window``: window_id, unit, row, col (fine pixels); ``imagery``: window_id, t, row, col of
    seen pixels; ``unstable``: unit, k, unstable. The probability is that of the later date,
    and a pixel without imagery on either date is no data.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("unit", "row", "col").orderBy("t")
    lead = lambda c: F.lead(c).over(w)
    step = cells.select("unit", F.col("t").alias("k"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("forest").alias("forest_before"), lead("forest").alias("forest_after"), F.col("chm_cover").alias("cover_before"), F.col("chm_height").alias("height_before"), lead("probability").alias("prob"))
    step = step.where("forest_after IS NOT NULL").join(unstable.select("unit", "k", "unstable"), ["unit", "k"], "left")
    px = window.withColumns({"_r": F.floor(F.col("row") / cell_px).cast("int"), "_c": F.floor(F.col("col") / cell_px).cast("int")}).join(step, ["unit", "_r", "_c"])
    seen = lambda shift, name: imagery.select("window_id", (F.col("t") - shift).alias("k"), "row", "col", F.lit(True).alias(name))
    keys = ["window_id", "k", "row", "col"]
    px = px.join(seen(0, "_a"), keys, "left").join(seen(1, "_b"), keys, "left")
    missing = F.col("_a").isNull() | F.col("_b").isNull()
    return px.withColumns({"no_data": missing, "unstable": holds(F.col("unstable")), "never_green": F.lit(False)}).drop("_r", "_c", "_a", "_b")


def window_labels(pixels: DataFrame, parts: DataFrame, rule: Mapping = P.RULES) -> DataFrame:
    """Reason, agent, change and probability in percent of every pixel and interval of a window."""
    from sylvaflow.functions.scalars import to_percent

    out = interval_reasons(pixels, parts, rule)
    return out.join(pixels.select(*PIXEL, F.coalesce(to_percent(F.col("prob")), F.lit(P.IGNORE)).alias("percent")), PIXEL, "left")
