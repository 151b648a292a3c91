"""Developmental stages, site types and multi-date trajectories from rule tables.

The rule tables are small and fixed, so they are compiled to column expressions:
classifying adds no shuffle, and sequences need one aggregation per stand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import finite, holds, lookup

COMPARE = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def inside(value: Column, bounds: tuple) -> Column:
    lo, hi = bounds
    test = value.isNotNull()
    if lo is not None:
        test = test & (value >= lo)
    if hi is not None:
        test = test & (value <= hi)
    return test


def stage_match(available: Mapping[str, Column], envelope: Mapping[str, tuple]) -> tuple[Column, Column, Column]:
    """Evaluable and matched metrics of one envelope, and the names that failed."""
    n_eval, n_match, failed = F.lit(0), F.lit(0), []
    for name, bounds in envelope.items():
        if name not in available:
            continue
        value = available[name]
        ok = inside(value, bounds)
        n_eval = n_eval + value.isNotNull().cast("int")
        n_match = n_match + ok.cast("int")
        failed.append(F.when(value.isNotNull() & ~ok, F.lit(name)))
    return n_eval, n_match, F.concat_ws(",", *failed) if failed else F.lit("")


def classify_stages(
    frame: DataFrame, *, site_type: str | None = None, min_score: float = P.MIN_STAGE_SCORE,
    envelopes: Mapping[str, Mapping] = P.ENVELOPES, order: Sequence[str] = P.STAGE_ORDER,
) -> DataFrame:
    """Best envelope per row; ties go to the earlier stage.

    Without ``site_type`` rows use the unstratified envelopes; with it, code 0
    stays unclassified. Adds stage, stage_code, score, n_evaluated, failed, ranked, stage_reason.
    """
    known = {n for kind in envelopes.values() for env in kind.values() for n in env} & set(frame.columns)
    values = {n: finite(n) for n in sorted(known)}

    def candidates(kind: str) -> Column:
        items = []
        for position, stage in enumerate(order):
            env = envelopes.get(kind, {}).get(stage)
            if not env:
                continue
            n_eval, n_match, failed = stage_match(values, env)
            items.append(F.struct(
                (-n_match / F.greatest(n_eval, F.lit(1))).alias("neg"), F.lit(position).alias("pos"), F.lit(stage).alias("stage"),
                n_eval.alias("n"), failed.alias("failed"),
            ))
        if not items:
            return F.expr("CAST(array() AS array<struct<neg:double,pos:int,stage:string,n:int,failed:string>>)")
        return F.filter(F.array(*items), lambda s: s["n"] > 0)

    if site_type is None:
        ranked = candidates("type_00")
        no_envelope = F.lit(any(not envelopes.get("type_00", {}).get(s) for s in order))
        kind_text = F.lit("type_00")
    else:
        code = F.col(site_type)
        ranked, no_envelope = candidates("-"), F.lit(True)
        for kind in envelopes:
            number = int(kind.split("_")[1])
            if number == 0:
                continue
            missing = any(not envelopes[kind].get(s) for s in order)
            ranked = F.when(code == number, candidates(kind)).otherwise(ranked)
            no_envelope = F.when(code == number, F.lit(missing)).otherwise(no_envelope)
        kind_text = F.format_string("type_%02d", code)
    out = frame.withColumn("_ranked", F.array_sort(ranked))
    best = F.get("_ranked", F.lit(0))
    score = F.lit(0.0) - best["neg"]
    none = F.size("_ranked") == 0
    low = ~none & (score < min_score)
    reason = (
        F.when(none & no_envelope, F.concat(F.lit("no stage has an envelope for '"), kind_text, F.lit("'")))
        .when(none, F.lit("no envelope metric was evaluable"))
        .when(low, F.format_string(f"best score %.2f < min_score {min_score:.2f}", score))
    )
    taken = ~none & ~low
    text = F.array_join(F.transform("_ranked", lambda s: F.concat(s["stage"], F.lit("="), F.format_string("%.3f", F.lit(0.0) - s["neg"]))), ",")
    return out.select(
        *frame.columns,
        F.when(taken, best["stage"]).alias("stage"),
        F.when(taken, lookup(best["stage"], P.STAGE_CODES)).otherwise(0).alias("stage_code"),
        F.coalesce(score, F.lit(0.0)).alias("stage_score"), F.coalesce(best["n"], F.lit(0)).alias("n_evaluated"),
        F.coalesce(best["failed"], F.lit("")).alias("failed_metrics"), text.alias("ranked"), reason.alias("stage_reason"),
    )


# Configured predicates of the site types; those without a threshold are not listed.
SITE_RULES = {
    1: [("parmat_kind", "==", 4)],
    4: [("parmat_kind", "==", 3), ("texture_class", "==", 1)],
    12: [("bedrock_kind", "==", 1)],
    13: [("bedrock_kind", "==", 3)],
}


def assign_site_types(frame: DataFrame, rules: Mapping[int, Sequence[tuple]] = SITE_RULES) -> DataFrame:
    """First matching site type in order, with the share of its configured predicates that were evaluated.

    A predicate without a threshold is skipped, a rule with none configured never matches.
    """
    site, score = None, None
    for code, predicates in rules.items():
        configured = [p for p in predicates if p[2] is not None]
        if not configured:
            continue
        test = F.lit(True)
        for var, op, value in configured:
            test = test & (holds(COMPARE[op](finite(var), F.lit(value))) if var in frame.columns else F.lit(False))
        site = F.when(test, code) if site is None else site.when(test, code)
        score = F.when(test, 1.0) if score is None else score.when(test, 1.0)
    return frame.withColumns({"site_type": site.otherwise(0), "match_score": score})


# --- trajectories ----------------------------------------------------------------
NO_THRESHOLD, NOT_AVAILABLE, NO_MATCH = "threshold not set", "metric not available", "evaluated, conditions not met"


def _stage_values(value) -> list[int]:
    return [P.STAGE_CODES[v] for v in (value if isinstance(value, list) else [value])]


def _predicate(pred: tuple, columns: set[str], site_type: str | None) -> Column:
    """Aggregate expression of one predicate over the dates of a stand."""
    dim, var, reducer, op, value, *rest = pred
    if value is None:
        return F.lit(False)
    year = F.col("year")
    if dim in ("stage", "stage_delta"):
        x = F.col("stage_code") if dim == "stage" else F.col("_stage_step")
        if op == "in":
            test = x.isin(_stage_values(value) if dim == "stage" else [int(v) for v in value])
        else:
            test = COMPARE[op](x, F.lit(_stage_values(value)[0] if dim == "stage" else float(value)))
        at = F.when(x.isNotNull(), year)
        forms = {
            "all": F.coalesce(F.bool_and(test), F.lit(False)), "any": F.coalesce(F.bool_or(test), F.lit(False)),
            "latest": F.max_by(test, at), "earliest": F.min_by(test, at),
        }
        return holds(forms[reducer])
    if dim == "site_type":
        x = F.max(site_type) if site_type else F.lit(0)
        return x.isin([int(v) for v in value]) if op == "in" else holds(COMPARE[op](x, F.lit(int(value))))
    if var not in columns:
        return F.lit(False)
    x, compare = finite(var), COMPARE[op]
    if dim == "persistence":
        return F.avg(holds(compare(x, F.lit(float(rest[0])))).cast("double")) >= value
    if reducer in ("all", "any"):
        test = holds(compare(x, F.lit(float(value))))
        return F.bool_and(test) if reducer == "all" else F.bool_or(test)
    forms = {"mean": F.avg(x), "min": F.min(x), "max": F.max(x), "latest": F.max_by(x, year), "earliest": F.min_by(x, year)}
    if reducer not in forms:
        return F.lit(False)
    return holds(compare(forms[reducer], F.lit(float(value))))


def classify_trajectories(
    frame: DataFrame, *, rules: Mapping[str, Sequence[tuple]] = P.TRAJECTORIES, order: Sequence[str] = P.TRAJECTORY_ORDER,
    codes: Mapping[str, int] = P.TRAJECTORY_CODES, site_type: str | None = None, key: str = "stand_id",
) -> DataFrame:
    """First class of the precedence order whose predicates all hold over the dates of a stand.

    ``frame`` has stage_code (0 unclassified) and the metrics per stand and year.
    Stands with one date are left out. ``available`` lists the metrics with a value.
    """
    if any(p[0] == "stage_delta" for r in rules.values() for p in r):
        step = F.col("stage_code") - F.lag("stage_code").over(W.partitionBy(key).orderBy("year"))
        frame = frame.withColumn("_stage_step", step)
    columns = set(frame.columns)
    needed = sorted({p[1] for r in rules.values() for p in r if p[0] in ("metric", "persistence") and p[1]})
    named = {}
    for name in order:
        for i, pred in enumerate(rules[name]):
            named[f"_{name}_{i}"] = _predicate(pred, columns, site_type)
    have = [F.when(F.count(finite(n)) > 0, F.lit(n)) for n in needed if n in columns]
    agg = frame.groupBy(key).agg(
        F.count(F.lit(1)).alias("_dates"), F.sum((F.col("stage_code") != 0).cast("int")).alias("n_dates"),
        F.array_compact(F.array(*have)).alias("available"),
        *[c.alias(n) for n, c in named.items()],
    )
    chain = None
    for name in order:
        test = F.lit(bool(rules[name]))
        for i in range(len(rules[name])):
            test = test & F.col(f"_{name}_{i}")
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    out = agg.where(F.col("_dates") >= 2).withColumn("trajectory", chain)
    n_preds = {name: len(rules[name]) for name in order}
    return out.select(
        key, "trajectory", F.coalesce(lookup("trajectory", dict(codes)), F.lit(0)).alias("trajectory_code"),
        F.coalesce(lookup("trajectory", n_preds), F.lit(0)).alias("n_predicates"), "n_dates", "available",
    )


def blocking_report(classified: DataFrame, *, rules: Mapping[str, Sequence[tuple]] = P.TRAJECTORIES, order: Sequence[str] = P.TRAJECTORY_ORDER, key: str = "stand_id") -> DataFrame:
    """Why a class could not be assigned to a stand: one row per stand and class with the reasons.

    Threshold reasons are known from the rules, availability from the stand. A class
    without such a reason is listed only for stands that got no class at all.
    """
    have = F.col("available")
    items = []
    for name in order:
        texts, seen = [], set()
        for dim, var, _r, _o, value, *_ in rules[name]:
            if value is None and ("t", var or dim) not in seen:
                seen.add(("t", var or dim))
                texts.append(F.lit(f"{NO_THRESHOLD}: {var or dim}"))
            if var is not None and ("m", var) not in seen:
                seen.add(("m", var))
                texts.append(F.when(~F.array_contains(have, var), F.lit(f"{NOT_AVAILABLE}: {var}")))
        text = F.concat_ws("; ", *texts) if texts else F.lit("rule has no predicates" if not rules[name] else "")
        items.append(F.struct(F.lit(name).alias("class"), text.alias("reason")))
    rows = classified.select(key, "trajectory", F.explode(F.array(*items)).alias("_i")).select(
        key, "trajectory", F.col("_i.class").alias("class"), F.col("_i.reason").alias("reason")
    )
    rows = rows.withColumn("reason", F.when((F.col("reason") == "") & F.col("trajectory").isNull(), NO_MATCH).otherwise(F.col("reason")))
    return rows.where(F.col("reason") != "").select(key, "class", "reason")
