"""Verdicts of two independent judges: parsing, pairing, routing and outlines.

Sequences over dates are short arrays, so routing is a chain of higher-order
functions on one row per candidate and needs no shuffle beyond the pairing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import holds, lookup
from sylvaflow.session import cut_lineage

ANSWER = "states array<string>, affected_share string, change_type string, outline_fit string, confidence string, reason string"


def parse_verdict(answer: Column, n_dates: Column) -> Column:
    """JSON answer to a typed verdict; usable only with one known state per date."""
    a = F.from_json(answer, ANSWER)
    states = F.coalesce(a["states"], F.expr("CAST(array() AS array<string>)"))
    valid = holds((F.size(states) == n_dates) & F.forall(states, lambda s: holds(s.isin(P.STATES))))
    return F.struct(
        F.when(valid, states).otherwise(F.expr("CAST(array() AS array<string>)")).alias("states"),
        a["affected_share"].alias("affected_share"), F.nullif(a["change_type"], F.lit("")).alias("change_type"), a["outline_fit"].alias("outline_fit"),
        a["confidence"].try_cast("int").alias("confidence"), F.coalesce(a["reason"], F.lit("")).alias("reason"), valid.alias("valid"),
    )


def latest_by(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last record of every key; one aggregation with map-side combine."""
    rest = [c for c in records.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return records.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def answers_in_force(answers: DataFrame, order: Sequence[str] = ("saved",)) -> DataFrame:
    """Last line per interpreter and item, unless it voids the item."""
    return latest_by(answers, ["interpreter", "item"], order).where(~holds(F.col("void")))


def latest_calls(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last record of a call: window, candidate, kind, model and prompt variant."""
    return latest_by(records, ["window_id", "cand_id", "kind", "model", "variant"], order)


def pair_verdicts(verdicts: DataFrame, models: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    """The two judges' verdicts of a candidate side by side as ``a`` and ``b``."""
    one = lambda m: F.max_by("verdict", F.when(F.col("model") == m, F.lit(1)))
    return verdicts.groupBy(*keys).agg(one(models[0]).alias("a"), one(models[1]).alias("b"))


def _loss_dates(v: Column) -> Column:
    index = F.transform(v["states"], lambda s, i: F.when((i > 0) & s.isin(P.LOSS_STATES), i))
    return F.array_compact(index)


def _severity(x: Column, y: Column) -> Column:
    return F.when((x == "full_loss") & (y == "full_loss"), "loss_full").when((x == "partial_loss") & (y == "partial_loss"), "loss_partial").otherwise("loss_disputed")


def route(pairs: DataFrame, rule: Mapping = P.ROUTING, flagged: str = "flagged") -> DataFrame:
    """Outcome of every interval from two verdicts, with status, severity, type and agent.

    ``pairs`` has structs ``a``, ``b`` and the flagged interval (or null).
    """
    a, b = F.col("a"), F.col("b")
    sa, sb = a["states"], b["states"]
    ok = holds(a["valid"] & b["valid"] & (F.size(sa) == F.size(sb)))
    n = F.least(F.size(sa), F.size(sb)) - 1
    df = pairs.withColumns({
        "_ok": ok, "_n": n, "_la": _loss_dates(a), "_lb": _loss_dates(b),
        "_conf": F.least(a["confidence"], b["confidence"]),
        "_both": a["confidence"].isNotNull() & b["confidence"].isNotNull(),
        "_k": F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("CAST(array() AS array<int>)")),
    })
    df = df.withColumns({
        "_fa": F.array_min("_la"), "_fb": F.array_min("_lb"),
        "_lo": F.least(F.array_min("_la"), F.array_min("_lb")), "_hi": F.greatest(F.array_min("_la"), F.array_min("_lb")),
    })

    def quiet(k: Column) -> Column:
        x, y = F.get(sa, k + 1), F.get(sb, k + 1)
        stressed = (x == "stressed") | (y == "stressed")
        back = (F.get(sa, k + 2) == "forest") & (F.get(sb, k + 2) == "forest")
        text = F.when((x == "forest") & (y == "forest"), "intact").otherwise("open")
        out = F.when(stressed, "stressed")
        if rule["stressed_recovered"] == "background":
            out = F.when(holds((x == "stressed") & (y == "stressed") & back), "stressed_recovered").when(stressed, "stressed")
        return out.otherwise(text)

    la, lb, lo, hi = (F.col(c) for c in ("_la", "_lb", "_lo", "_hi"))
    none = (F.size(la) == 0) & (F.size(lb) == 0)
    single = ~none & ((F.size(la) == 0) | (F.size(lb) == 0))
    strong = F.col("_both") & (F.col("_conf") >= rule["reject_confidence"])
    in_a, in_b = (lambda k: F.array_contains(la, k + 1)), (lambda k: F.array_contains(lb, k + 1))

    def both_lost(k: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        if rule["disputed_date"] == "later":
            out = F.when((lo != hi) & (k + 1 == hi), _severity(F.get(sa, F.col("_fa")), F.get(sb, F.col("_fb"))))
        return (
            out.when((lo != hi) & (k + 1 >= lo) & (k + 1 <= hi), "date_disputed")
            .when(in_a(k) & in_b(k), _severity(F.get(sa, k + 1), F.get(sb, k + 1)))
            .when(in_a(k) | in_b(k), "disagree")
            .otherwise(quiet(k))
        )

    is_flag = lambda k: holds(k == F.col(flagged))
    base = F.transform("_k", lambda k: (
        F.when(~F.col("_ok"), "failed")
        .when(none & is_flag(k), F.when(strong, "rejected_flagged").otherwise("rejected_weak"))
        .when(none, quiet(k))
        .when(single & (in_a(k) | in_b(k)), "disagree")
        .when(single, quiet(k))
        .otherwise(both_lost(k))
    ))
    df = df.withColumn("_base", base)
    is_loss = lambda o: o.isin(P.LOSS_OUTCOMES)
    if rule["consecutive_loss"] == "ignore":
        again = lambda o, i: F.when((i > 0) & is_loss(o) & holds(is_loss(F.get("_base", i - 1))), "loss_repeated").otherwise(o)
        df = df.withColumn("_base", F.transform("_base", again))
    if rule["guard_flagged_interval"]:
        guard = lambda o, i: F.when(F.col("_ok") & ~none & is_flag(i) & o.isin(P.BACKGROUND_OUTCOMES), "flagged_unconfirmed").otherwise(o)
        df = df.withColumn("_base", F.transform("_base", guard))
    first = F.when(F.col("_ok") & ~none & ~single, F.array_min(F.array_compact(F.transform("_base", lambda o, i: F.when(is_loss(o), i)))))
    status = (
        F.when(~F.col("_ok"), "failed").when(none, F.when(strong, "rejected").otherwise("rejected_weak"))
        .when(single, "disagree").when(lo == hi, "accepted").otherwise("date_disputed")
    )
    df = df.withColumns({"first_loss": first, "status": status})
    agent = lambda v: lookup(v["change_type"], P.AGENT_OF)
    double = F.col("_ok") & ~none & ~single
    keep = [c for c in pairs.columns if c not in ("a", "b")]
    return df.select(
        *keep, "status", F.col("_base").alias("outcomes"), "first_loss",
        F.when(F.col("first_loss").isNotNull(), F.when(F.get("_base", F.col("first_loss")) == "loss_full", "stand_replacing").otherwise("partial")).alias("severity"),
        F.when(double & (a["change_type"] == b["change_type"]), a["change_type"]).alias("change_type"),
        F.when(double & (agent(a) == agent(b)), agent(a)).alias("agent"),
        F.when(F.col("_ok"), F.col("_conf")).alias("confidence"),
        F.when(F.col("_ok"), F.array(a["outline_fit"], b["outline_fit"])).alias("outline_fit"),
        F.when(F.col("_ok"), F.array(a["affected_share"], b["affected_share"])).alias("affected_share"),
        F.when(F.col("_ok"), F.array(a["change_type"], b["change_type"])).alias("change_types"),
    )


def route_candidates(candidates: DataFrame, verdicts: DataFrame, models: tuple[str, str], n_intervals: int, *, rule: Mapping = P.ROUTING, min_ha: float = P.CANDIDATES["min_ha"]) -> DataFrame:
    """Routed outcome of every candidate; those without both verdicts are unjudged.

    ``candidates``: window_id, cand_id, flagged, area_ha, judged; ``verdicts``: window_id,
    cand_id, model, verdict.
    """
    keys = ["window_id", "cand_id"]
    both = candidates.join(pair_verdicts(verdicts, models, keys), keys, "left")
    ready = holds(F.col("judged")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    routed = route(both, rule)
    mark = F.when(F.col("area_ha") < min_ha, "under_min").otherwise("unjudged")
    blank = F.transform(F.sequence(F.lit(0), F.lit(n_intervals - 1)), lambda k: F.when(holds(k == F.col("flagged")), mark).otherwise(""))
    # the flag for a complete pair is carried through routing as a column
    routed = route(both.withColumn("_ready", ready), rule)
    skip = ~F.col("_ready")
    out = routed.withColumn("outcomes", F.when(skip, blank).otherwise(F.col("outcomes")))
    out = out.withColumn("status", F.when(skip, "unjudged").otherwise(F.col("status")))
    empty = ["first_loss", "severity", "change_type", "agent", "confidence", "outline_fit", "affected_share", "change_types"]
    return out.withColumns({c: F.when(~skip, F.col(c)) for c in empty}).drop("_ready")


def plan_literal(a: Column, b: Column, rule: Mapping = P.ROUTING) -> Column:
    """First wording of the rule: accept only the same first date, reject only when both are sure."""
    la, lb = _loss_dates(a), _loss_dates(b)
    sure = F.least(F.coalesce(a["confidence"], F.lit(0)), F.coalesce(b["confidence"], F.lit(0))) >= rule["reject_confidence"]
    return (
        F.when(~holds(a["valid"] & b["valid"]), "ignore")
        .when((F.size(la) > 0) & (F.size(lb) > 0), F.when(F.array_min(la) == F.array_min(lb), "accepted").otherwise("ignore"))
        .when((F.size(la) == 0) & (F.size(lb) == 0), F.when(sure, "rejected").otherwise("ignore"))
        .otherwise("ignore")
    )


# --- outlines -----------------------------------------------------------------------------
def needs_polygon(fits: Column, affected: Column) -> Column:
    """A judge finds the outline wrong, or under a quarter affected."""
    return holds(F.exists(fits, lambda f: ~holds(f == "about_right")) | F.exists(affected, lambda s: holds(s == "under_25")))


def is_crisp(change_type: Column, outcomes: Column, first_loss: Column, rule: Mapping = P.OUTLINES) -> Column:
    sharp = change_type.isin(rule["crisp_types"])
    fire = (change_type == "fire") & F.lit(rule["crisp_fire_full"]) & (F.get(outcomes, first_loss) == "loss_full")
    return holds(sharp) | holds(fire)


def polygon_usable(polygon_ha: Column, candidate_ha: Column, covered: Column, rule: Mapping = P.OUTLINES, *, limit: bool = True) -> Column:
    """A judge's outline is large enough, not far larger than the candidate, and covers enough of it."""
    ok = (candidate_ha > 0) & (polygon_ha >= rule["polygon_min_ha"]) & (covered >= rule["polygon_min_cover"])
    return holds(ok & (polygon_ha <= rule["polygon_max_ratio"] * candidate_ha)) if limit else holds(ok)


def choose_outline(candidates: DataFrame, cells: DataFrame, cell_ha: float, rule: Mapping = P.OUTLINES) -> tuple[DataFrame, DataFrame]:
    """Core, extension and trimmed cells of every candidate with a loss.

    ``candidates`` are routed rows with source and geom_src; ``cells`` lists (cand_id, row,
    col, in_candidate, in_polygon). Returns the event table and the cells with their part.
    """
    inside, poly = F.col("in_candidate"), F.col("in_polygon")
    n = lambda c: F.count(F.when(c, 1))
    size = cells.groupBy("cand_id").agg((n(inside) * cell_ha).alias("cand_ha"), (n(poly) * cell_ha).alias("poly_ha"), (n(inside & poly) / F.greatest(n(inside), F.lit(1))).alias("covered"))
    df = cut_lineage(candidates).where(F.col("first_loss").isNotNull()).join(size, "cand_id", "left")
    fits, shares = F.col("outline_fit"), F.col("affected_share")
    doubt = holds(F.exists(fits, lambda f: holds(f.isin("too_large", "wrong_shape")))) | holds(F.array_contains(shares, "under_25"))
    use = polygon_usable(F.col("poly_ha"), F.col("cand_ha"), F.col("covered"), rule)
    over = ~use & (F.col("poly_ha") > 0) & polygon_usable(F.col("poly_ha"), F.col("cand_ha"), F.col("covered"), rule, limit=False)
    crisp = is_crisp(F.col("change_type"), F.col("outcomes"), F.col("first_loss"), rule)
    df = df.withColumns({"_needs": needs_polygon(fits, shares), "doubtful": doubt, "_use": use, "oversize": over, "crisp": crisp})
    drawn = F.col("_needs") & (F.col("_use") | F.col("oversize"))
    name = F.concat_ws("_", "source", "geom_src")
    precise = ~F.col("_needs") & (F.col("geom_src") == "refined") & F.col("crisp") & F.forall(shares, lambda s: holds(s == "over_75"))
    events = df.withColumns({
        "drawn": drawn,
        "outline": F.when(drawn, F.concat(name, F.when(F.col("oversize"), "+wide_polygon").otherwise("+polygon"))).otherwise(name),
        "quality": F.when(holds(precise), "precise").otherwise("envelope"),
        "wide_margin": F.col("_needs") & ~drawn & ~F.col("doubtful"),
        "oversize": F.col("_needs") & F.col("oversize"),
        "withdrawn": F.col("_needs") & ~drawn & F.col("doubtful"),
    }).drop("_use", "_needs")
    c = cells.join(events.select("cand_id", "drawn", "doubtful", "withdrawn"), "cand_id")
    trimmed = inside & (F.col("withdrawn") | (F.col("drawn") & F.col("doubtful") & ~poly))
    part = F.when(trimmed, "trimmed").when(inside, "core").when(F.col("drawn") & poly, "extension")
    return events, c.select("cand_id", "row", "col", part.alias("part")).where("part IS NOT NULL")


def settle_agent(routed: DataFrame, cells: DataFrame, burned: DataFrame, dates: DataFrame, *, min_share: float = 0.5) -> DataFrame:
    """Fire as agent where one judge said fire, the agents differ and enough of the object
    burned in the interval of its first loss.

    ``cells`` (cand_id, row, col), ``burned`` (unit, row, col, burned_on), ``dates`` (unit, k, start, end).
    """
    routed = cut_lineage(routed)
    fire = F.exists("change_types", lambda t: holds(t == "fire"))
    asked = routed.where(F.col("first_loss").isNotNull() & F.col("agent").isNull() & holds(fire))
    asked = asked.join(dates, (asked["unit"] == dates["unit"]) & (asked["first_loss"] == dates["k"])).select("cand_id", dates["unit"], "start", "end")
    own = cells.join(asked, "cand_id")
    total = own.groupBy("cand_id").agg(F.countDistinct("row", "col").alias("n"))
    hit = own.join(burned, ["unit", "row", "col"]).where("burned_on > start AND burned_on <= end").groupBy("cand_id").agg(F.countDistinct("row", "col").alias("b"))
    settled = total.join(hit, "cand_id").where(F.col("b") / F.col("n") >= min_share).select("cand_id", F.lit("fire").alias("_fire"))
    out = routed.join(settled, "cand_id", "left")
    return out.withColumns({"agent": F.coalesce("agent", "_fire"), "agent_source": F.when(F.col("_fire").isNotNull(), "fire_perimeter")}).drop("_fire")


def label_images(outcomes: Column) -> Column:
    """Image numbers (later date, counted from 1) of the intervals labelled as loss."""
    index = F.array_compact(F.transform(outcomes, lambda o, k: F.when(o.isin(P.LOSS_OUTCOMES), k + 2)))
    return F.array_join(F.transform(index, lambda k: k.cast("string")), ",")


# --- label layers ---------------------------------------------------------------------------
def candidate_layer(routed: DataFrame) -> DataFrame:
    text = lambda c, sep: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("None"))), sep)
    return routed.withColumns({
        "outcomes": F.array_join("outcomes", "|"), "types": text("change_types", "/"), "fit": text("outline_fit", "/"), "affected": text("affected_share", "/"),
        "agent_source": F.coalesce("agent_source", F.when(F.col("agent").isNotNull(), "models")),
    }).drop("change_types", "outline_fit", "affected_share")


def event_layer(routed: DataFrame, intervals: Column) -> DataFrame:
    """One row per agreed loss: dates around it, all loss intervals, whether the flag was right."""
    at = F.get(intervals, F.col("first_loss"))
    losses = F.array_compact(F.transform("outcomes", lambda o, k: F.when(o.isin(P.LOSS_OUTCOMES), F.get(intervals, k))))
    return routed.where(F.col("first_loss").isNotNull()).select(
        F.concat_ws(":", "window_id", "cand_id").alias("event_id"), "window_id", "cand_id", F.split(at, "_")[0].alias("last_pre_acq"), F.split(at, "_")[1].alias("first_post_acq"),
        F.array_join(losses, ",").alias("loss_intervals"), "severity", "change_type", "agent", F.col("change_type").isNotNull().alias("type_agree"),
        holds(F.col("flagged") == F.col("first_loss")).alias("interval_matches"), "confidence",
    )


def reviewed_layer(routed: DataFrame, intervals: Column) -> DataFrame:
    """Completeness of every window and interval: partial while a judged candidate is open."""
    open_ = F.col("judged") & F.col("status").isin("unjudged", "failed")
    agg = routed.groupBy("window_id").agg(F.bool_or(open_).alias("_o"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("basis"))
    return agg.select("window_id", F.explode(intervals).alias("interval"), F.when(F.col("_o"), "partial").otherwise("complete").alias("finding"), "basis")


ACQUISITION = "struct<date:string,source:string,native_m:double,item_ids:array<string>>"


def acquisition_layer(windows: DataFrame) -> DataFrame:
    """Imagery of every window: one row per year, from the JSON text written when it was rendered.

    ``windows``: unit, window_id, meta (``{"years": {"2014": {"date", "source", "native_m", "item_ids"}}}``);
    windows without the text, or without years, have no rows.
    """
    years = F.from_json("meta", f"struct<years:map<string,{ACQUISITION}>>")["years"]
    rows = windows.select("unit", "window_id", F.explode(years).alias("year", "info"))
    return rows.select(
        "unit", "window_id", F.col("year").cast("int").alias("year"), F.col("info.date").alias("acquisition_date"), F.col("info.source").alias("naip_source"),
        F.col("info.native_m").alias("native_m"), F.coalesce(F.array_join("info.item_ids", ","), F.lit("")).alias("item_ids"),
    )
