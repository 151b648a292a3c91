"""Queries on verdicts: parsing, latest records, routing, outlines, label layers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaflow.operators import verdicts as V
from sylvaflow.plans.catalog import query
from sylvaflow.plans.stand_ins import table

STATE_OF = ["forest", "forest", "forest", "full_loss", "forest", "stressed", "partial_loss", "open", "forest", "full_loss", "stressed"]
TYPE_OF = ["clearcut", "wind", "fire", "thinning", "mining"]
FIT_OF = ["about_right", "too_large", "wrong_shape", "about_right"]
SHARE_OF = ["over_75", "under_25", "over_75", "25_to_75"]
MODELS = ("m0", "m1")


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values, index):
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({index} % {len(values)} + 1 AS INTEGER)]"


CALL = 1_000_003


def events_by_call(spark, sf):
    """All events with candidates for users: every five events of a user and judge are one call, and a candidate is a user's call."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 2).alias("j"))
    n = F.row_number().over(W.partitionBy("user_id", "j").orderBy("ts", "event_id"))
    return e.withColumn("user_id", F.col("user_id") * CALL + F.floor((n - 1) / 5))


def answers(spark, sf):
    """JSON answers of two judges per candidate; a last short call gives an invalid verdict."""
    first = events_by_call(spark, sf).withColumn("n", F.row_number().over(W.partitionBy("user_id", "j").orderBy("ts", "event_id")))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda s: pick(STATE_OF, s["event_id"]))
    per = first.groupBy("user_id", "j").agg(seq.alias("states"), F.max("event_id").alias("m"))
    body = F.struct(
        F.when(F.col("user_id") % 29 == 3, F.array(F.lit("cloud"))).otherwise(F.col("states")).alias("states"),
        pick(TYPE_OF, F.col("user_id") + F.when(F.col("user_id") % 3 == 0, F.col("j")).otherwise(0)).alias("change_type"), pick(FIT_OF, F.col("user_id") + F.col("j")).alias("outline_fit"),
        pick(SHARE_OF, F.col("user_id") + F.col("j")).alias("affected_share"), (F.col("m") % 5).cast("string").alias("confidence"),
    )
    return per.select("user_id", "j", F.to_json(body).alias("answer"))


ANSWERS = f"""calls AS (SELECT user_id * {CALL} + (row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1) // 5 AS user_id, event_id, ts FROM events),
firsts AS (SELECT user_id, event_id % 2 AS j, event_id, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS n FROM calls),
ans AS (SELECT user_id, j, list({sql_pick(STATE_OF, 'event_id')} ORDER BY n) AS states, max(event_id) % 5 AS conf FROM firsts GROUP BY ALL),
verd AS (SELECT user_id, j, len(states) = 5 AND user_id % 29 <> 3 AS valid, CASE WHEN len(states) = 5 AND user_id % 29 <> 3 THEN states ELSE [] END AS states, conf,
  {sql_pick(TYPE_OF, '(user_id + CASE WHEN user_id % 3 = 0 THEN j ELSE 0 END)')} AS ctype, {sql_pick(FIT_OF, '(user_id + j)')} AS fit, {sql_pick(SHARE_OF, '(user_id + j)')} AS share FROM ans)"""


def verdicts(spark, sf):
    a = answers(spark, sf)
    return a.select(
        F.concat(F.lit("W"), F.col("user_id") % 20).alias("window_id"), F.col("user_id").alias("cand_id"), F.concat(F.lit("m"), F.col("j")).alias("model"),
        V.parse_verdict(F.col("answer"), F.lit(5)).alias("verdict"),
    )


@query(
    "parse_verdicts",
    f"WITH {ANSWERS} SELECT user_id AS cand_id, 'm' || j AS model, valid, array_to_string(states, '|') AS states, ctype AS change_type, CAST(conf AS INTEGER) AS confidence FROM verd",
)
def parse_verdicts(spark, sf):
    v = verdicts(spark, sf)
    return v.select("cand_id", "model", "verdict.valid", F.array_join("verdict.states", "|").alias("states"), "verdict.change_type", "verdict.confidence")


@query(
    "latest_answers",
    """WITH a AS (SELECT user_id % 7 AS interpreter, user_id % 50 AS item, event_type AS answer, event_id % 6 = 0 AS void, ts, event_id FROM events)
SELECT interpreter, item, answer FROM (SELECT *, row_number() OVER (PARTITION BY interpreter, item ORDER BY ts DESC, event_id DESC) AS n FROM a) q WHERE n = 1 AND NOT void""",
)
def latest_answers(spark, sf):
    e = table(spark, sf, "events")
    a = e.select((F.col("user_id") % 7).alias("interpreter"), (F.col("user_id") % 50).alias("item"), F.col("event_type").alias("answer"), (F.col("event_id") % 6 == 0).alias("void"), "ts", "event_id")
    return V.answers_in_force(a, ["ts", "event_id"]).select("interpreter", "item", "answer")


@query(
    "latest_calls",
    """WITH a AS (SELECT user_id % 9 AS window_id, user_id AS cand_id, event_type AS kind, event_id % 2 AS model, event_id % 3 AS variant, value, ts, event_id FROM events)
SELECT window_id, cand_id, kind, model, variant, value FROM (SELECT *, row_number() OVER (PARTITION BY window_id, cand_id, kind, model, variant ORDER BY ts DESC, event_id DESC) AS n FROM a) q WHERE n = 1""",
)
def latest_calls(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    a = e.select((F.col("user_id") % 9).alias("window_id"), F.col("user_id").alias("cand_id"), F.col("event_type").alias("kind"), (i % 2).alias("model"), (i % 3).alias("variant"), "value", "ts", "event_id")
    return V.latest_calls(a, ["ts", "event_id"]).drop("ts", "event_id")


def candidates(spark, sf):
    u = events_by_call(spark, sf).select("user_id").distinct()
    c = F.col("user_id")
    return u.select(
        F.concat(F.lit("W"), c % 20).alias("window_id"), c.alias("cand_id"), (c % 4).cast("int").alias("flagged"), ((c % 10) / 10.0).alias("area_ha"), (c % 13 != 5).alias("judged"),
        pick(["di", "weak", "chm"], c).alias("source"), pick(["refined", "cells"], c).alias("geom_src"), F.concat(F.lit("U"), c % 6).alias("unit"),
    )


# The oracle works on one row per candidate and interval instead of on arrays.
ROUTE = f"""{ANSWERS}, cands AS (SELECT DISTINCT user_id FROM calls),
pairs AS (SELECT c.user_id AS u, c.user_id % 4 AS flagged, (c.user_id % 10) / 10.0 AS area_ha, c.user_id % 13 <> 5 AS judged, a.states AS sa, b.states AS sb, a.valid AND b.valid AND len(a.states) = len(b.states) AS ok, a.conf AS ca, b.conf AS cb, a.ctype AS ta, b.ctype AS tb,
  a.fit AS fa_, b.fit AS fb_, a.share AS sha, b.share AS shb, c.user_id % 13 <> 5 AND a.user_id IS NOT NULL AND b.user_id IS NOT NULL AS ready
  FROM cands c LEFT JOIN verd a ON a.user_id = c.user_id AND a.j = 0 LEFT JOIN verd b ON b.user_id = c.user_id AND b.j = 1),
steps AS (SELECT p.*, k, sa[k + 2] AS x, sb[k + 2] AS y, sa[k + 3] AS x2, sb[k + 3] AS y2 FROM pairs p, (SELECT unnest([0, 1, 2, 3]) AS k) q WHERE ready),
firsts2 AS (SELECT u, min(k + 1) FILTER (x IN ('partial_loss', 'full_loss')) AS fa, min(k + 1) FILTER (y IN ('partial_loss', 'full_loss')) AS fb FROM steps GROUP BY u),
st AS (SELECT s.*, fa, fb, least(fa, fb) AS lo, greatest(fa, fb) AS hi, x IN ('partial_loss', 'full_loss') AS ia, y IN ('partial_loss', 'full_loss') AS ib FROM steps s JOIN firsts2 USING (u)),
q0 AS (SELECT *, CASE WHEN x = 'stressed' OR y = 'stressed' THEN 'stressed' WHEN x = 'forest' AND y = 'forest' THEN 'intact' ELSE 'open' END AS quiet,
  CASE WHEN x = 'full_loss' AND y = 'full_loss' THEN 'loss_full' WHEN x = 'partial_loss' AND y = 'partial_loss' THEN 'loss_partial' ELSE 'loss_disputed' END AS sev,
  CASE WHEN sa[fa + 1] = 'full_loss' AND sb[fb + 1] = 'full_loss' THEN 'loss_full' WHEN sa[fa + 1] = 'partial_loss' AND sb[fb + 1] = 'partial_loss' THEN 'loss_partial' ELSE 'loss_disputed' END AS fsev FROM st),
o1 AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN fa IS NULL AND fb IS NULL THEN CASE WHEN k = flagged THEN CASE WHEN least(ca, cb) >= 3 THEN 'rejected_flagged' ELSE 'rejected_weak' END ELSE quiet END
  WHEN fa IS NULL OR fb IS NULL THEN CASE WHEN ia OR ib THEN 'disagree' ELSE quiet END
  WHEN lo <> hi AND k + 1 = hi THEN fsev WHEN lo <> hi AND k + 1 BETWEEN lo AND hi THEN 'date_disputed' WHEN ia AND ib THEN sev WHEN ia OR ib THEN 'disagree' ELSE quiet END AS o FROM q0),
o2 AS (SELECT *, CASE WHEN o LIKE 'loss_%' AND fa IS NOT NULL AND fb IS NOT NULL AND coalesce(lag(o) OVER (PARTITION BY u ORDER BY k) LIKE 'loss_%', FALSE) THEN 'loss_repeated' ELSE o END AS p FROM o1),
o3 AS (SELECT *, CASE WHEN ok AND (fa IS NOT NULL OR fb IS NOT NULL) AND k = flagged AND p IN ('intact', 'open', 'stressed_recovered') THEN 'flagged_unconfirmed' ELSE p END AS f FROM o2),
agg AS (SELECT u, string_agg(f, '|' ORDER BY k) AS outcomes, min(k) FILTER (ok AND fa IS NOT NULL AND fb IS NOT NULL AND f IN ('loss_full', 'loss_partial', 'loss_disputed')) AS first_loss,
  arg_min(f, k) FILTER (f IN ('loss_full', 'loss_partial', 'loss_disputed')) AS first_o, any_value(fa) AS fa, any_value(fb) AS fb FROM o3 GROUP BY u),
routed AS (SELECT p.u AS cand_id, p.flagged, p.judged, CASE WHEN NOT ready THEN 'unjudged' WHEN NOT ok THEN 'failed' WHEN fa IS NULL AND fb IS NULL THEN CASE WHEN least(ca, cb) >= 3 THEN 'rejected' ELSE 'rejected_weak' END WHEN fa IS NULL OR fb IS NULL THEN 'disagree' WHEN fa = fb THEN 'accepted' ELSE 'date_disputed' END AS status,
  CASE WHEN ready AND NOT ok THEN '' WHEN ready THEN outcomes ELSE array_to_string(list_transform([0, 1, 2, 3], lambda i: CASE WHEN i = p.flagged THEN CASE WHEN area_ha < 0.3 THEN 'under_min' ELSE 'unjudged' END ELSE '' END), '|') END AS outcomes,
  first_loss, CASE WHEN first_loss IS NOT NULL THEN CASE WHEN first_o = 'loss_full' THEN 'stand_replacing' ELSE 'partial' END END AS severity,
  CASE WHEN ready AND ok AND fa IS NOT NULL AND fb IS NOT NULL AND ta = tb THEN ta END AS change_type,
  CASE WHEN ready AND ok AND fa IS NOT NULL AND fb IS NOT NULL AND (CASE ta WHEN 'clearcut' THEN 'harvest' WHEN 'thinning' THEN 'harvest' WHEN 'mining' THEN 'conversion' ELSE ta END) = (CASE tb WHEN 'clearcut' THEN 'harvest' WHEN 'thinning' THEN 'harvest' WHEN 'mining' THEN 'conversion' ELSE tb END)
    THEN CASE ta WHEN 'clearcut' THEN 'harvest' WHEN 'thinning' THEN 'harvest' WHEN 'mining' THEN 'conversion' ELSE ta END END AS agent,
  CASE WHEN ready AND ok THEN CAST(least(ca, cb) AS INTEGER) END AS confidence, ready, ok, ta, tb, fa_, fb_, sha, shb
  FROM pairs p LEFT JOIN agg USING (u))"""


def routed(spark, sf):
    return V.route_candidates(candidates(spark, sf), verdicts(spark, sf), MODELS, 4)


@query(
    "route_verdicts",
    f"WITH {ROUTE} SELECT cand_id, status, outcomes, CAST(first_loss AS INTEGER) AS first_loss, severity, change_type, agent, confidence FROM routed",
)
def route_verdicts(spark, sf):
    return routed(spark, sf).select("cand_id", "status", F.array_join("outcomes", "|").alias("outcomes"), "first_loss", "severity", "change_type", "agent", "confidence")


@query(
    "plan_literal",
    f"""WITH {ROUTE} SELECT u AS cand_id, CASE WHEN NOT coalesce(ok, FALSE) THEN 'ignore' WHEN fa IS NOT NULL AND fb IS NOT NULL THEN CASE WHEN fa = fb THEN 'accepted' ELSE 'ignore' END
  WHEN fa IS NULL AND fb IS NULL THEN CASE WHEN least(ca, cb) >= 3 THEN 'rejected' ELSE 'ignore' END ELSE 'ignore' END AS plan
FROM (SELECT p.*, (SELECT min(i) FROM unnest([2, 3, 4, 5]) t(i) WHERE sa[i] IN ('partial_loss', 'full_loss')) AS fa, (SELECT min(i) FROM unnest([2, 3, 4, 5]) t(i) WHERE sb[i] IN ('partial_loss', 'full_loss')) AS fb FROM pairs p WHERE sa IS NOT NULL AND sb IS NOT NULL) z""",
)
def plan_literal(spark, sf):
    p = V.pair_verdicts(verdicts(spark, sf), MODELS, ["cand_id"]).where("a IS NOT NULL AND b IS NOT NULL")
    return p.select("cand_id", V.plan_literal(F.col("a"), F.col("b")).alias("plan"))


INTERVALS = ["2012_2014", "2014_2016", "2016_2018", "2018_2020"]


def intervals():
    return F.array(*[F.lit(i) for i in INTERVALS])


@query(
    "label_layers",
    f"""WITH {ROUTE} SELECT 'W' || (cand_id % 20) || ':' || cand_id AS event_id, split_part((['2012_2014', '2014_2016', '2016_2018', '2018_2020'])[first_loss + 1], '_', 1) AS last_pre_acq,
  split_part((['2012_2014', '2014_2016', '2016_2018', '2018_2020'])[first_loss + 1], '_', 2) AS first_post_acq,
  array_to_string(list_transform(list_filter([1, 2, 3, 4], lambda i: string_split(outcomes, '|')[i] IN ('loss_full', 'loss_partial', 'loss_disputed')), lambda i: (['2012_2014', '2014_2016', '2016_2018', '2018_2020'])[i]), ',') AS loss_intervals,
  severity, change_type, change_type IS NOT NULL AS type_agree, flagged = first_loss AS interval_matches, array_to_string(list_transform(list_filter([1, 2, 3, 4], lambda i: string_split(outcomes, '|')[i] IN ('loss_full', 'loss_partial', 'loss_disputed')), lambda i: i + 1), ',') AS images
FROM routed WHERE first_loss IS NOT NULL""",
)
def label_layers(spark, sf):
    r = routed(spark, sf)
    e = V.event_layer(r, intervals())
    images = r.select(F.col("cand_id"), V.label_images(F.col("outcomes")).alias("images"))
    return e.join(images, "cand_id").select("event_id", "last_pre_acq", "first_post_acq", "loss_intervals", "severity", "change_type", "type_agree", "interval_matches", "images")


@query(
    "reviewed_areas",
    f"""WITH {ROUTE}, w AS (SELECT 'W' || (cand_id % 20) AS window_id, bool_or(judged AND status IN ('unjudged', 'failed')) AS o, string_agg(DISTINCT (['di', 'weak', 'chm'])[CAST(cand_id % 3 + 1 AS INTEGER)], ',' ORDER BY (['di', 'weak', 'chm'])[CAST(cand_id % 3 + 1 AS INTEGER)]) AS basis FROM routed GROUP BY 1)
SELECT window_id, i AS interval, CASE WHEN o THEN 'partial' ELSE 'complete' END AS finding, basis FROM w, (SELECT unnest(['2012_2014', '2014_2016', '2016_2018', '2018_2020']) AS i) q""",
)
def reviewed_areas(spark, sf):
    return V.reviewed_layer(routed(spark, sf), intervals())


@query(
    "candidate_layer",
    f"""WITH {ROUTE} SELECT cand_id, outcomes, CASE WHEN ready AND ok THEN ta || '/' || tb END AS types, CASE WHEN ready AND ok THEN fa_ || '/' || fb_ END AS fit, CASE WHEN ready AND ok THEN sha || '/' || shb END AS affected, CASE WHEN agent IS NOT NULL THEN 'models' END AS agent_source FROM routed""",
)
def candidate_layer(spark, sf):
    r = routed(spark, sf).withColumn("agent_source", F.lit(None).cast("string"))
    return V.candidate_layer(r).select("cand_id", "outcomes", "types", "fit", "affected", "agent_source")


def outline_cells(spark, sf):
    """Cells of a candidate and of its outline: boxes derived from the events of the user."""
    e = events_by_call(spark, sf).select(F.col("user_id").alias("cand_id"), (F.col("event_id") % 40).alias("row"), (F.col("event_id") % 25).alias("col")).distinct()
    c = F.col("cand_id")
    poly = F.when(c % 4 == 0, F.col("row") < 2).when(c % 4 == 1, F.col("col") >= 8).otherwise(F.col("row") < 26)
    return e.select("cand_id", "row", "col", (F.col("row") < 20).alias("in_candidate"), poly.alias("in_polygon"))


@query(
    "choose_outline",
    f"""WITH {ROUTE}, oc AS (SELECT DISTINCT user_id AS c, event_id % 40 AS r, event_id % 25 AS k FROM calls), of AS (SELECT c, r, k, r < 20 AS i, CASE WHEN c % 4 = 0 THEN r < 2 WHEN c % 4 = 1 THEN k >= 8 ELSE r < 26 END AS p FROM oc),
sz AS (SELECT c, count(*) FILTER (i) * 0.01 AS ch, count(*) FILTER (p) * 0.01 AS ph, count(*) FILTER (i AND p) / greatest(count(*) FILTER (i), 1)::DOUBLE AS cov FROM of GROUP BY c),
ev AS (SELECT r.*, z.*, fa_ <> 'about_right' OR fb_ <> 'about_right' OR sha = 'under_25' OR shb = 'under_25' AS needs, fa_ IN ('too_large', 'wrong_shape') OR fb_ IN ('too_large', 'wrong_shape') OR sha = 'under_25' OR shb = 'under_25' AS doubt,
  ch > 0 AND ph >= 0.1 AND cov >= 0.5 AS base, ph <= 10 * ch AS lim FROM routed r JOIN sz z ON z.c = r.cand_id WHERE first_loss IS NOT NULL),
fl AS (SELECT *, needs AND base AS drawn, needs AND NOT base AND doubt AS withdrawn, (['di', 'weak', 'chm'])[CAST(cand_id % 3 + 1 AS INTEGER)] || '_' || (['refined', 'cells'])[CAST(cand_id % 2 + 1 AS INTEGER)] AS nm FROM ev),
pt AS (SELECT f.cand_id, CASE WHEN i AND (withdrawn OR (drawn AND doubt AND NOT p)) THEN 'trimmed' WHEN i THEN 'core' WHEN drawn AND p THEN 'extension' END AS part FROM fl f JOIN of o ON o.c = f.cand_id)
SELECT f.cand_id, CASE WHEN drawn THEN nm || CASE WHEN lim THEN '+polygon' ELSE '+wide_polygon' END ELSE nm END AS outline, needs AND NOT drawn AND NOT doubt AS wide_margin,
  count(*) FILTER (part = 'core') AS n_core, count(*) FILTER (part = 'extension') AS n_extension, count(*) FILTER (part = 'trimmed') AS n_trimmed FROM fl f LEFT JOIN pt USING (cand_id) GROUP BY ALL""",
)
def choose_outline(spark, sf):
    events, parts = V.choose_outline(routed(spark, sf), outline_cells(spark, sf), 0.01)
    n = lambda p: F.count(F.when(F.col("part") == p, 1)).alias(f"n_{p}")
    return events.select("cand_id", "outline", "wide_margin").join(parts, "cand_id", "left").groupBy("cand_id", "outline", "wide_margin").agg(n("core"), n("extension"), n("trimmed"))


@query(
    "fire_agents",
    f"""WITH {ROUTE}, oc AS (SELECT DISTINCT user_id AS c, event_id % 40 AS r, event_id % 25 AS k FROM calls WHERE event_id % 40 < 20), bu AS (SELECT DISTINCT o_orderkey % 40 AS r, o_orderkey % 25 AS k, year(o_orderdate) - (o_orderkey % 25) AS y FROM orders),
ak AS (SELECT cand_id, first_loss FROM routed WHERE first_loss IS NOT NULL AND agent IS NULL AND (ta = 'fire' OR tb = 'fire')),
sh AS (SELECT a.cand_id, count(DISTINCT (o.r, o.k)) FILTER (b.r IS NOT NULL) / count(DISTINCT (o.r, o.k))::DOUBLE AS s FROM ak a JOIN oc o ON o.c = a.cand_id LEFT JOIN bu b ON b.r = o.r AND b.k = o.k AND b.y > 1980 + first_loss * 4 AND b.y <= 1984 + first_loss * 4 GROUP BY a.cand_id)
SELECT r.cand_id, CASE WHEN s >= 0.2 THEN 'fire' ELSE agent END AS agent, CASE WHEN s >= 0.2 THEN 'fire_perimeter' END AS agent_source FROM routed r LEFT JOIN sh ON sh.cand_id = r.cand_id""",
)
def fire_agents(spark, sf):
    k = F.col("o_orderkey")
    units = F.explode(F.array(*[F.lit(f"U{i}") for i in range(6)])).alias("unit")
    burned = table(spark, sf, "orders").select(units, (k % 40).alias("row"), (k % 25).alias("col"), (F.year("o_orderdate") - k % 25).alias("burned_on"))
    cells = outline_cells(spark, sf).where("in_candidate").select("cand_id", "row", "col")
    k4 = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    dates = candidates(spark, sf).select("unit").distinct().select("unit", k4)
    dates = dates.select("unit", "k", (1980 + F.col("k") * 4).alias("start"), (1984 + F.col("k") * 4).alias("end"))
    return V.settle_agent(routed(spark, sf), cells, burned, dates, min_share=0.2).select("cand_id", "agent", "agent_source")


