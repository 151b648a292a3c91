"""Queries on accuracy, review, audit, rank statistics and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow.functions.columns import r6
from sylvaflow.operators import compare as X
from sylvaflow.operators import components as G
from sylvaflow.operators import scores as S
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.cell_queries import YGRID, years_grid
from sylvaflow.plans.change_queries import comp_sql
from sylvaflow.plans.stand_ins import table
from sylvaflow.plans.stand_queries import crowns
from sylvaflow.plans.verdict_queries import pick, sql_pick
from sylvaflow.session import cut_lineage


def predictions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source").join(table(spark, sf, "labels"), "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    model = F.when(i % 17 == 0, 255).otherwise((n + F.col("quality") * 30) % 101)
    return d.select("doc_id", F.col("lang").alias("interval"), model.alias("model"), ((n * 7 + F.col("quality") * 20) % 101).alias("di"), F.when(i % 13 == 0, 255).otherwise(F.col("quality")).alias("target"))


PRED = """pr AS (SELECT doc_id, lang AS interval, CASE WHEN doc_id % 17 = 0 THEN 255 ELSE (n_chars + quality * 30) % 101 END AS model, (n_chars * 7 + quality * 20) % 101 AS di, CASE WHEN doc_id % 13 = 0 THEN 255 ELSE quality END AS target FROM documents JOIN labels USING (doc_id))"""


@query(
    "score_curve",
    f"""WITH {PRED}, t AS (SELECT unnest(generate_series(0, 100)) AS p), g AS (SELECT DISTINCT interval FROM pr WHERE model <= 100 AND target < 2),
c AS (SELECT g.interval, p, count(*) FILTER (target = 1 AND model >= p) AS tp, count(*) FILTER (target = 0 AND model >= p) AS fp, count(*) FILTER (target = 1) AS np, count(*) AS nv FROM g, t JOIN pr ON pr.interval = g.interval AND model <= 100 AND target < 2 GROUP BY ALL)
SELECT interval, p, {s6('tp / nullif(tp + fp, 0)::DOUBLE', 'precision')}, {s6('tp / nullif(np, 0)::DOUBLE', 'recall')}, {s6('2 * tp / nullif(tp + fp + np, 0)::DOUBLE', 'f1')}, {s6('tp / nullif(fp + np, 0)::DOUBLE', 'iou')}, np AS n_pos, nv AS n_valid FROM c""",
)
def score_curve(spark, sf):
    h = S.percent_histogram(predictions(spark, sf), ["interval"], "model")
    return S.score_curve(h, ["interval"]).select("interval", "p", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "iou")], "n_pos", "n_valid")


@query(
    "interval_scores",
    f"""WITH {PRED}, l AS (SELECT interval, 'model' AS source, model AS pct, target FROM pr WHERE model <= 100 AND target < 2 UNION ALL SELECT interval, 'di', di, target FROM pr WHERE model <= 100 AND target < 2), a AS (SELECT * FROM l UNION ALL SELECT 'all', source, pct, target FROM l),
t AS (SELECT unnest(generate_series(0, 100)) AS p), k AS (SELECT interval, source, p, count(*) FILTER (target = 1 AND pct >= p) AS tp, count(*) FILTER (target = 0 AND pct >= p) AS fp, count(*) FILTER (target = 1 AND pct = p) AS pos, count(*) FILTER (target = 1) AS np, count(*) AS nv FROM a, t GROUP BY ALL),
f AS (SELECT *, 2 * tp / nullif(tp + fp + np, 0)::DOUBLE AS f1, tp / nullif(tp + fp, 0)::DOUBLE AS pre FROM k)
SELECT interval, source, any_value(nv) AS cells, any_value(np) AS loss_cells, {s6('CASE WHEN any_value(np) > 0 THEN sum(pos / np::DOUBLE * coalesce(pre, 1)) END', 'average_precision')}, {s6('max(f1) FILTER (p >= 1)', 'best_f1')},
  {s6('arg_max(p, (coalesce(f1, -1), -p)) FILTER (p >= 1) / 100.0', 'best_f1_threshold')}, {s6('max(pre) FILTER (p = 50)', 'precision_050')}, {s6('max(tp / nullif(np, 0)::DOUBLE) FILTER (p = 30)', 'recall_val')} FROM f GROUP BY interval, source""",
)
def interval_scores(spark, sf):
    s = S.interval_scores(predictions(spark, sf), 0.3)
    return s.select("interval", "source", "cells", "loss_cells", *[r6(c).alias(c) for c in ("average_precision", "best_f1", "best_f1_threshold", "precision_050", "recall_val")])


@query(
    "confusion",
    f"""WITH c AS (SELECT lang AS label, CASE WHEN n_chars % 5 = 0 THEN (['de', 'en', 'fr', 'es'])[CAST(doc_id % 4 + 1 AS INTEGER)] ELSE lang END AS predicted FROM documents), u AS (SELECT * FROM c WHERE label IN ('de', 'en', 'es', 'fr') AND predicted IN ('de', 'en', 'es', 'fr')),
w AS (SELECT label, count(*) AS cells, count(*) FILTER (predicted = 'de') AS as_de, count(*) FILTER (predicted = 'en') AS as_en, count(*) FILTER (predicted = 'es') AS as_es, count(*) FILTER (predicted = 'fr') AS as_fr, avg((label = predicted)::INT) AS recall FROM u GROUP BY label)
SELECT *REPLACE ({s6('recall')} AS recall), {s6('(SELECT avg((label = predicted)::INT) FROM u)', 'accuracy')}, {s6('avg(recall) OVER ()', 'balanced_accuracy')} FROM w""",
)
def confusion(spark, sf):
    d = table(spark, sf, "documents")
    c = d.select(F.col("lang").alias("label"), F.when(F.col("n_chars") % 5 == 0, pick(["de", "en", "fr", "es"], F.col("doc_id"))).otherwise(F.col("lang")).alias("predicted"))
    out = S.confusion(c, ["de", "en", "es", "fr"])
    return out.select("label", "cells", "as_de", "as_en", "as_es", "as_fr", r6("recall").alias("recall"), r6("accuracy").alias("accuracy"), r6("balanced_accuracy").alias("balanced_accuracy"))


@query(
    "object_scores",
    f"""WITH o AS (SELECT l_partkey % 97 AS object_id, CASE WHEN l_suppkey % 8 = 0 THEN 255 ELSE l_orderkey % 101 END AS pct FROM lineitem)
SELECT object_id, count(*) FILTER (pct <= 100) AS cells, {s6('avg(pct) FILTER (pct <= 100)', 'mean_percent')}, {s6('avg((pct >= 60)::INT) FILTER (pct <= 100)', 'share_above')} FROM o GROUP BY object_id""",
)
def object_scores(spark, sf):
    o = table(spark, sf, "lineitem").select((F.col("l_partkey") % 97).alias("object_id"), F.when(F.col("l_suppkey") % 8 == 0, 255).otherwise(F.col("l_orderkey") % 101).alias("percent"))
    s = S.object_scores(o, ["object_id"], 60)
    return s.select("object_id", "cells", r6("model_mean_percent").alias("mean_percent"), r6("model_share_above").alias("share_above"))


# --- audit -----------------------------------------------------------------------------
STRATA = ["accepted", "rejected", "disagree", "background", "model_only"]


def audit(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    item = i % 400
    items = e.select(item.alias("item")).distinct().select(
        "item", pick(STRATA, F.col("item")).alias("stratum"), F.concat(F.lit("s"), F.col("item") % 10).alias("sub"), F.when(F.col("item") % 3 == 0, "2,4").when(F.col("item") % 3 == 1, "3").otherwise("").alias("label_images"),
        pick(["harvest", "wind", ""], F.floor(F.col("item") / 5)).alias("agent"), (1.0 / (F.col("item") % 7 + 1)).alias("window_incl_prob"), (F.col("item") % 90 + 10).alias("n_population"),
    )
    ans = e.groupBy(item.alias("item"), (F.col("user_id") % 4).alias("u")).agg(F.max("event_id").alias("m"))
    m = F.col("m")
    answers = ans.select("item", F.concat(F.lit("i"), "u").alias("interpreter"), pick(["loss", "unsure", "other", "loss"], m).alias("answer"), pick(["harvest", "wind", "fire"], F.floor(m / 3)).alias("type"),
                         (m % 5).cast("int").alias("loss_at"), F.when(m % 2 == 0, F.array((m % 3 + 2).cast("int"))).alias("more_at"), pick(["good", "bad", ""], F.floor(m / 7)).alias("outline"), (m % 61).cast("double").alias("seconds"))
    return S.judged_table(items, answers)


JUDGED = f"""it AS (SELECT DISTINCT event_id % 400 AS item FROM events),
im AS (SELECT item, {sql_pick(STRATA, 'item')} AS stratum, 's' || (item % 10) AS sub, CASE item % 3 WHEN 0 THEN [2, 4] WHEN 1 THEN [3] ELSE [] END AS imgs, {sql_pick(['harvest', 'wind', ''], '(item // 5)')} AS agent, 1.0 / (item % 7 + 1) AS ip, item % 90 + 10 AS npop FROM it),
am AS (SELECT event_id % 400 AS item, user_id % 4 AS u, max(event_id) AS m FROM events GROUP BY ALL),
aa AS (SELECT item, 'i' || u AS interpreter, {sql_pick(['loss', 'unsure', 'other', 'loss'], 'm')} AS answer, {sql_pick(['harvest', 'wind', 'fire'], '(m // 3)')} AS type, CASE WHEN m % 2 = 0 THEN [CAST(m % 5 AS INTEGER), CAST(m % 3 + 2 AS INTEGER)] ELSE [CAST(m % 5 AS INTEGER)] END AS named, {sql_pick(['good', 'bad', ''], '(m // 7)')} AS outline, m % 61 AS seconds FROM am),
jd AS (SELECT *, answer = 'loss' AS is_loss, answer = 'unsure' AS unsure, CASE WHEN len(imgs) > 0 THEN list_has_any(imgs, named) END AS same_interval, CASE WHEN agent <> '' THEN type = agent END AS same_type, 1 / (ip * count(*) OVER (PARTITION BY interpreter, sub) / npop) AS weight FROM aa JOIN im USING (item))"""


@query(
    "judged_table",
    f"WITH {JUDGED} SELECT item, interpreter, is_loss, unsure, same_interval, same_type, {s6('weight', 'weight')} FROM jd",
)
def judged_table(spark, sf):
    return audit(spark, sf).select("item", "interpreter", "is_loss", "unsure", "same_interval", "same_type", r6("weight").alias("weight"))


@query(
    "audit_rates",
    f"""WITH {JUDGED}, m AS (SELECT interpreter, stratum, weight, 'loss seen' AS measure, CASE WHEN NOT unsure THEN is_loss END AS f FROM jd
  UNION ALL SELECT interpreter, stratum, weight, CASE stratum WHEN 'accepted' THEN 'loss in labelled interval' ELSE 'loss in model interval' END, CASE WHEN NOT unsure THEN same_interval END FROM jd WHERE stratum IN ('accepted', 'model_only')
  UNION ALL SELECT interpreter, stratum, weight, CASE stratum WHEN 'accepted' THEN 'cause equals label agent' ELSE 'cause equals model agent' END, CASE WHEN is_loss THEN same_type END FROM jd WHERE stratum IN ('accepted', 'model_only')
  UNION ALL SELECT interpreter, stratum, weight, 'label extent holds', CASE WHEN is_loss AND outline <> '' THEN outline = 'good' END FROM jd WHERE stratum = 'accepted'),
b AS (SELECT interpreter, stratum, count(*) FILTER (unsure) AS unsure, median(seconds) AS ms FROM jd GROUP BY ALL)
SELECT interpreter, stratum, measure, count(f) AS n, count(*) FILTER (f) AS k, {s6('avg(f::INT)', 'rate')}, {s6('sum(weight * f::INT) / sum(weight) FILTER (f IS NOT NULL)', 'weighted_rate')}, any_value(unsure) AS unsure, {s6('any_value(ms)', 'median_seconds')} FROM m JOIN b USING (interpreter, stratum) GROUP BY interpreter, stratum, measure""",
)
def audit_rates(spark, sf):
    r = S.rates(audit(spark, sf))
    return r.select("interpreter", "stratum", "measure", "n", "k", r6("rate").alias("rate"), r6("weighted_rate").alias("weighted_rate"), "unsure", r6("median_seconds").alias("median_seconds"))


# The bounds are checked by putting them back into the binomial tail: both tails hold 2.5%.
@query(
    "exact_intervals",
    """WITH c AS (SELECT p_size AS g, count(*) AS n, count(*) FILTER (p_retailprice % 3 < 1) AS k FROM part GROUP BY p_size) SELECT g, n, k, CASE WHEN k > 0 THEN 0.025::DOUBLE ELSE 1.0 END AS low_tail, CASE WHEN k < n THEN 0.025::DOUBLE ELSE 1.0 END AS high_tail FROM c""",
)
def exact_intervals(spark, sf):
    c = table(spark, sf, "part").groupBy(F.col("p_size").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p_retailprice") % 3 < 1, 1)).alias("k"))
    c = cut_lineage(c.withColumn("ci", S.exact_interval(F.col("k"), F.col("n"))))  # one row per size
    n, k, i, p = F.col("n"), F.col("k"), F.col("i"), F.col("p")
    # every term of both tails is a row, so a tail of any length is summed where its terms are
    tail = lambda name, a, b, p: c.select("g", "n", F.lit(name).alias("tail"), p.alias("p"), F.explode(F.sequence(a, b)).alias("i"))
    terms = tail("low", k, n, F.col("ci.low")).where("p > 0").unionByName(tail("high", F.lit(0).cast("bigint"), k, F.col("ci.high")).where("p < 1"))
    lf = lambda x: S.log_gamma(x + 1.0)
    term = F.exp(lf(n) - lf(i) - lf(n - i) + i * F.ln(p) + (n - i) * F.ln(1.0 - p))
    half = lambda name: F.sum(F.when(F.col("tail") == name, term)).alias(f"{name}_tail")
    sums = terms.groupBy(F.col("g").alias("_g")).agg(half("low"), half("high"))
    whole = c.join(sums, F.col("g").eqNullSafe(F.col("_g")), "left")
    low, high = F.when(k > 0, F.col("low_tail")).otherwise(1.0), F.when(k < n, F.col("high_tail")).otherwise(1.0)
    return whole.select("g", "n", "k", r6(low).alias("low_tail"), r6(high).alias("high_tail"))


@query(
    "audit_agreement",
    f"""WITH {JUDGED} SELECT item, stratum, max(answer) FILTER (interpreter = 'i0') AS i0, max(answer) FILTER (interpreter = 'i1') AS i1, max(answer) FILTER (interpreter = 'i2') AS i2, max(answer) FILTER (interpreter = 'i3') AS i3, count(*) AS n, count(DISTINCT answer) = 1 AS all_agree FROM jd GROUP BY item, stratum HAVING count(*) > 1""",
)
def audit_agreement(spark, sf):
    return S.agreement(audit(spark, sf), ["i0", "i1", "i2", "i3"])


# --- review ------------------------------------------------------------------------------
VERDICTS = ["confirmed", "likely", "rejected", "uncertain"]


def reviewed(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    y = F.year("o_orderdate")
    s = o.select(k.alias("sample_id"), F.concat(F.lit("u"), F.col("o_custkey") % 9).alias("unit"), F.concat_ws("-", y - 1, y).alias("interval"), (1.0 / (k % 5 + 2)).alias("incl_prob"), (F.col("o_totalprice") % 13).alias("assessed_ha"))
    labels = o.select(k.alias("sample_id"), pick(VERDICTS, F.floor(k / 12)).alias("verdict"), F.when(k % 7 == 0, "unsure").otherwise(F.concat_ws("-", F.lit(1996), 1996 + k % 5)).alias("ref_interval"),
                                        pick(["about_right", "too_large", "", "wrong_shape"], F.floor(k / 5)).alias("outline"), pick(["clearcut", "", "wind"], F.floor(k / 12)).alias("change_type"), (k % 47).cast("double").alias("seconds_spent"))
    line = table(spark, sf, "lineitem")
    cells = line.select(F.col("l_orderkey").alias("sample_id"), (F.col("l_partkey") % 9).alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_quantity") > 15).alias("detected"), (F.col("l_quantity") < 40).alias("redrawn")).distinct()
    return S.labelled_sample(s, labels, cells)


REVIEW = f"""sm AS (SELECT o_orderkey AS id, 'u' || (o_custkey % 9) AS unit, year(o_orderdate) AS det, 1.0 / (o_orderkey % 5 + 2) AS ip, o_totalprice % 13 AS ha, {sql_pick(VERDICTS, '(o_orderkey // 12)')} AS verdict, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1996 + o_orderkey % 5 END AS ref,
  {sql_pick(['about_right', 'too_large', '', 'wrong_shape'], '(o_orderkey // 5)')} AS outline, {sql_pick(['clearcut', '', 'wind'], '(o_orderkey // 12)')} AS ctype, o_orderkey % 47 AS sec FROM orders),
cl AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 9 AS r, l_linenumber AS c, l_quantity > 15 AS d, l_quantity < 40 AS e FROM lineitem),
sp AS (SELECT id, count(*) FILTER (d AND e) AS i, count(*) FILTER (d OR e) AS u, count(*) FILTER (d) AS nd, count(*) FILTER (e) AS ne FROM cl GROUP BY id HAVING count(*) FILTER (e) > 0),
lb AS (SELECT sm.*, verdict IN ('confirmed', 'likely') AS tr, CASE WHEN verdict NOT IN ('confirmed', 'likely') THEN '' WHEN ref IS NULL THEN 'unsure' WHEN det = ref THEN 'match' WHEN det > ref THEN 'detected_late' ELSE 'detected_early' END AS timing, 1 / ip AS weight, i / u::DOUBLE AS iou, nd / ne::DOUBLE AS ratio FROM sm LEFT JOIN sp USING (id))"""


@query("labelled_sample", f"WITH {REVIEW} SELECT id AS sample_id, tr AS is_true, timing, {s6('weight', 'weight')}, {s6('iou', 'iou')}, {s6('ratio', 'area_ratio')} FROM lb")
def labelled_sample(spark, sf):
    return reviewed(spark, sf).select("sample_id", "is_true", "timing", *[r6(c).alias(c) for c in ("weight", "iou", "area_ratio")])


@query(
    "weighted_scores",
    f"""WITH {REVIEW}, lv AS (SELECT unit AS lv, 1.0 AS w, * FROM lb UNION ALL SELECT 'pooled', weight, * FROM lb),
g AS (SELECT lv, count(*) AS n, count(*) FILTER (tr) AS n_true, sum(w * tr::INT) FILTER (verdict <> 'uncertain') / sum(w) FILTER (verdict <> 'uncertain') AS precision, sum(w * ha * tr::INT) FILTER (verdict <> 'uncertain') / sum(w * ha) FILTER (verdict <> 'uncertain') AS area_precision,
  sum(w * (timing = 'match')::INT) FILTER (tr AND timing <> 'unsure') / sum(w) FILTER (tr AND timing <> 'unsure') AS timing_match, count(*) FILTER (timing = 'detected_late') AS n_late, sum(w * (outline = 'about_right')::INT) FILTER (tr AND outline <> '') / sum(w) FILTER (tr AND outline <> '') AS outline_ok, median(iou) AS iou, median(sec) AS sec FROM lv GROUP BY lv),
al AS (SELECT * FROM g UNION ALL SELECT 'site_mean', sum(n), sum(n_true), avg(precision), avg(area_precision), avg(timing_match), sum(n_late), avg(outline_ok), avg(iou), avg(sec) FROM g WHERE lv <> 'pooled')
SELECT lv AS unit, CAST(n AS BIGINT) AS n, CAST(n_true AS BIGINT) AS n_true, {s6('precision', 'precision')}, {s6('area_precision', 'area_precision')}, {s6('timing_match', 'timing_match')}, CAST(n_late AS BIGINT) AS n_late, {s6('outline_ok', 'outline_ok')}, {s6('iou', 'iou_median')}, {s6('sec', 'seconds_median')} FROM al""",
)
def weighted_scores(spark, sf):
    s = S.review_scores(reviewed(spark, sf)).withColumnRenamed("seconds_spent_median", "seconds_median")
    return s.select("unit", "n", "n_true", *[r6(c).alias(c) for c in ("precision", "area_precision", "timing_match")], "n_late", *[r6(c).alias(c) for c in ("outline_ok", "iou_median", "seconds_median")])


@query("change_types", f"WITH {REVIEW} SELECT verdict, coalesce(nullif(ctype, ''), '(none)') AS change_type, count(*) AS n FROM lb GROUP BY ALL")
def change_types(spark, sf):
    return S.change_type_counts(reviewed(spark, sf))


# --- rank statistics ----------------------------------------------------------------------
@query(
    "rank_auc",
    f"""WITH v AS (SELECT d.lang AS g, CASE quality WHEN 1 THEN 'post' ELSE 'pre' END AS ph, n_chars::DOUBLE AS v FROM documents d JOIN labels USING (doc_id)),
u AS (SELECT a.g, sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS u FROM v a JOIN v b ON a.g = b.g AND a.ph = 'post' AND b.ph = 'pre' GROUP BY a.g),
m AS (SELECT g, count(*) FILTER (ph = 'pre') AS n0, count(*) FILTER (ph = 'post') AS n1, avg(v) FILTER (ph = 'pre') AS m0, avg(v) FILTER (ph = 'post') AS m1, var_samp(v) FILTER (ph = 'pre') AS v0, var_samp(v) FILTER (ph = 'post') AS v1 FROM v GROUP BY g)
SELECT m.g AS lang, n0 AS n_pre, n1 AS n_post, {s6('CASE WHEN n0 >= 3 AND n1 >= 3 THEN u / (n0 * n1) END', 'auc')}, {s6('CASE WHEN n0 >= 3 AND n1 >= 3 THEN (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) END', 'cohens_d')} FROM m LEFT JOIN u ON u.g = m.g""",
)
def rank_auc(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    v = d.select("lang", F.col("n_chars").cast("double").alias("v"), F.when(F.col("quality") == 1, "post").otherwise("pre").alias("phase"))
    return S.separation(v, ["lang"], "v", "phase", 64.0).select("lang", "n_pre", "n_post", r6("auc").alias("auc"), r6("cohens_d").alias("cohens_d"))


def phases(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(F.year("o_orderdate").alias("year"), F.when(k % 31 != 0, 1996 + F.col("o_custkey") % 3).alias("last_pre"), (1998 + F.col("o_custkey") % 2).alias("first_post"), F.when(k % 19 != 0, F.substring("o_orderpriority", 1, 1)).alias("dist_group"),
                    F.col("o_totalprice").alias("price"), (F.floor(F.col("o_totalprice") / 9000) + F.year("o_orderdate") % 3).cast("double").alias("crown"))


@query(
    "phase_separation",
    f"""WITH p AS (SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' WHEN year(o_orderdate) <= 1996 + o_custkey % 3 THEN 'pre' WHEN year(o_orderdate) >= 1998 + o_custkey % 2 THEN 'post' ELSE 'during' END AS ph, CASE WHEN o_orderkey % 19 <> 0 THEN left(o_orderpriority, 1) END AS g, floor(o_totalprice / 9000) + year(o_orderdate) % 3 AS v FROM orders),
l AS (SELECT ph, v, unnest(['all', g]) AS g FROM p WHERE ph IN ('pre', 'post')), r AS (SELECT g, ph, v, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM l WHERE g IS NOT NULL),
m AS (SELECT g, count(*) FILTER (ph = 'pre') AS n0, count(*) FILTER (ph = 'post') AS n1, sum(r) FILTER (ph = 'post') AS s, avg(v) FILTER (ph = 'pre') AS m0, avg(v) FILTER (ph = 'post') AS m1, var_samp(v) FILTER (ph = 'pre') AS v0, var_samp(v) FILTER (ph = 'post') AS v1 FROM r GROUP BY g)
SELECT g AS "group", n0 AS n_pre, n1 AS n_post, {s6('m0', 'pre_mean')}, {s6('m1', 'post_mean')}, {s6('(s - n1 * (n1 + 1) / 2) / (n0 * n1)', 'auc')}, {s6('(m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))', 'cohens_d')} FROM m""",
)
def phase_separation(spark, sf):
    t = S.separation_table(phases(spark, sf), {"crown": 1.0})
    return t.select("group", "n_pre", "n_post", *[r6(c).alias(c) for c in ("pre_mean", "post_mean", "auc", "cohens_d")])


@query(
    "spearman",
    f"""WITH v AS (SELECT floor(o_totalprice / 500) AS x, floor((o_totalprice + o_orderkey * 31) % 4000 / 10) AS y FROM orders WHERE o_orderkey % 29 <> 0), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v)
SELECT count(*) AS n, {s6('corr(rx, ry)', 'rho')} FROM r""",
)
def spearman(spark, sf):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    v = table(spark, sf, "orders").select(F.when(k % 29 != 0, F.floor(p / 500)).alias("x"), F.floor((p + k * 31) % 4000 / 10).alias("y"))
    return S.spearman(v, "x", "y").select("n", r6("rho").alias("rho"))


# --- crown study ---------------------------------------------------------------------------
def tiled(spark, sf):
    c = crowns(spark, sf)
    tx, ty = F.floor(F.col("x") / 250), F.floor(F.col("y") / 250)
    return c.select(tx.alias("tx"), ty.alias("ty"), "x", "y", "crown_diam_m", "apex_h_m", ((F.col("x") * 7 + F.col("y") * 3) % 20 / 100).alias("capped_frac"), (F.col("crown_diam_m") * 2).alias("area_m2"), F.lit(62500.0).alias("canopy_m2"),
                    (tx * 250).alias("minx"), (tx * 250 + 250).alias("maxx"), (ty * 250).alias("miny"), (ty * 250 + 250).alias("maxy"))


@query(
    "tile_crowns",
    f"""WITH c AS (SELECT CAST(l_orderkey % 1000 // 250 AS BIGINT) AS tx, CAST(l_partkey % 1000 // 250 AS BIGINT) AS ty, l_orderkey % 1000 AS x, l_partkey % 1000 AS y, 1.0 + l_extendedprice % 9 AS d, l_quantity AS h, ((l_orderkey % 1000) * 7 + (l_partkey % 1000) * 3) % 20 / 100.0 AS cap FROM lineitem),
i AS (SELECT *, x % 250 BETWEEN 15 AND 235 AND y % 250 BETWEEN 15 AND 235 AS inn, 3.09632 + 0.00895 * h * h AS p FROM c)
SELECT tx, ty, count(*) FILTER (inn) AS n_crowns, {s6('count(*) FILTER (inn) / 4.84', 'density_per_ha')}, {s6('stddev_pop(d) FILTER (inn) / avg(d) FILTER (inn)', 'diam_cv')}, {s6('quantile_cont(d, 0.9) FILTER (inn)', 'diam_p90')}, {s6('avg((cap > 0.05)::INT) FILTER (inn)', 'capped_fraction')},
  {s6('sum(d * 2) / 62500', 'assigned_fraction')}, {s6('regr_slope(d, p) FILTER (inn AND cap <= 0.05)', 'allo_slope')}, {s6('regr_intercept(d, p) FILTER (inn AND cap <= 0.05)', 'allo_intercept')}, {s6('sqrt(avg((d - p) * (d - p)) FILTER (inn AND cap <= 0.05))', 'allo_rmse')},
  {s6('avg(d - p) FILTER (inn AND cap <= 0.05)', 'allo_bias')}, {s6('avg((d > 2 * p)::INT) FILTER (inn)', 'over_open_grown')} FROM i GROUP BY tx, ty""",
)
def tile_crowns(spark, sf):
    t = S.tile_crowns(tiled(spark, sf), ["tx", "ty"])
    return t.select("tx", "ty", "n_crowns", *[r6(c).alias(c) for c in ("density_per_ha", "diam_cv", "diam_p90", "capped_fraction", "assigned_fraction", "allo_slope", "allo_intercept", "allo_rmse", "allo_bias", "over_open_grown")])


@query(
    "sweep_means",
    f"""SELECT l_returnflag AS key, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 END AS radius, {s6('avg(l_quantity)', 'diam')}, {s6('avg(l_tax)', 'rmse')}, count(*) AS n_tiles FROM lineitem GROUP BY ALL""",
)
def sweep_means(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 3).alias("radius"), F.col("l_quantity").alias("diam"), F.col("l_tax").alias("rmse"))
    m = S.sweep_means(line, ["key", "radius"], ["diam", "rmse"])
    return m.select("key", "radius", r6("diam").alias("diam"), r6("rmse").alias("rmse"), "n_tiles")


KEY12 = "CAST(('0x' || substr(sha256('{seed}:' || {name}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query(
    "bootstrap_support",
    f"""WITH p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT 1.0 + l_extendedprice % 9 AS v FROM lineitem) q), s AS (SELECT unnest([10, 40]) AS n), d AS (SELECT n, b, unnest(generate_series(1, n)) AS j FROM s, (SELECT unnest(generate_series(1, 100)) AS b) r),
x AS (SELECT n, b, v FROM d JOIN p ON p.i = CAST(floor({KEY12.format(seed=1, name="n || ':' || b || ':' || j")} * (SELECT count(*) FROM p)) AS BIGINT)), c AS (SELECT n, b, stddev_pop(v) / avg(v) AS cv FROM x GROUP BY ALL)
SELECT n, {s6('avg(cv)', 'cv_mean')}, {s6('quantile_cont(cv, 0.95) - quantile_cont(cv, 0.05)', 'ci90_width')}, {s6('avg(cv) * sqrt((1 + 2 * avg(cv) * avg(cv)) / (2 * n))', 'analytic_se')}, quantile_cont(cv, 0.95) - quantile_cont(cv, 0.05) <= 0.1 AS fits_in_band FROM c GROUP BY n""",
)
def bootstrap_support(spark, sf):
    b = S.bootstrap_support(crowns(spark, sf).select("crown_diam_m"), "crown_diam_m", [10, 40], 100, 1, S.narrowest_band())
    return b.select("n", r6("cv_mean").alias("cv_mean"), r6("ci90_width").alias("ci90_width"), r6("analytic_se").alias("analytic_se"), "fits_in_band")


# --- runs ---------------------------------------------------------------------------------------
RUN_NAMES = ["base", "low", "late"]


def run_cells(spark, sf):
    """Three runs on one grid: a threshold, a lower threshold, and a shifted reading of the field."""
    g = years_grid(spark, sf).where("t > 0")
    z = F.col("z")
    hits = {"base": z > 1.4, "low": (z > 1.2) & (F.col("col") < 50), "late": ((z > 1.5) | (z < -1.9)) & (F.col("row") % 5 != 0)}
    runs = F.array_compact(F.array(*[F.when(c, n) for n, c in hits.items()]))
    return g.select("unit", "t", "row", "col", F.explode(runs).alias("run"))


RUNS = f"""{YGRID}, rn AS (SELECT t, row, col, 'base' AS run FROM yg WHERE t > 0 AND z > 1.4 UNION ALL SELECT t, row, col, 'low' FROM yg WHERE t > 0 AND z > 1.2 AND col < 50 UNION ALL SELECT t, row, col, 'late' FROM yg WHERE t > 0 AND (z > 1.5 OR z < -1.9) AND row % 5 <> 0)"""


def _overlap_sql(dates: bool) -> str:
    cell = "t, row, col" if dates else "row, col"
    return f"""WITH {RUNS}, e AS (SELECT DISTINCT run, {cell} FROM rn), p AS (SELECT a.run AS run, b.run AS other, count(*) AS n FROM e a JOIN e b USING ({cell}) GROUP BY ALL), n AS (SELECT run, count(*) AS n FROM e GROUP BY run)
SELECT n.run, {', '.join(s6(f"100.0 * max(p.n) FILTER (other = '{r}') / any_value(n.n)", r) for r in RUN_NAMES)} FROM n JOIN p ON p.run = n.run GROUP BY n.run"""


@query("run_overlap", _overlap_sql(True))
def run_overlap(spark, sf):
    return X.overlap(run_cells(spark, sf), RUN_NAMES, same_interval=True).select("run", *[r6(r).alias(r) for r in RUN_NAMES])


@query("run_overlap_any", _overlap_sql(False))
def run_overlap_any(spark, sf):
    return X.overlap(run_cells(spark, sf), RUN_NAMES, same_interval=False).select("run", *[r6(r).alias(r) for r in RUN_NAMES])


@query(
    "agreement_area",
    f"""WITH {RUNS}, c AS (SELECT row, col, count(DISTINCT run) AS v FROM rn GROUP BY ALL), f AS (SELECT unnest([1, 2, 3]) AS v)
SELECT CAST(f.v AS BIGINT) AS variants, {s6('count(c.v) * 0.036864', 'area_ha')}, {s6('100.0 * count(c.v) / (SELECT count(*) FROM c)', 'share_of_union_pct')} FROM f LEFT JOIN c ON c.v = f.v GROUP BY f.v""",
)
def agreement_area(spark, sf):
    return X.agreement_area(run_cells(spark, sf), 3, 0.036864).select("variants", r6("area_ha").alias("area_ha"), r6("share_of_union_pct").alias("share_of_union_pct"))


@query(
    "objects_kept",
    f"""WITH RECURSIVE {RUNS}, ba AS (SELECT t, row, col FROM rn WHERE run = 'base'), {comp_sql('ba')}
SELECT c.t, CAST(c.label AS BIGINT) AS label, bool_or(o.run IS NOT NULL) AS kept FROM comp c LEFT JOIN rn o ON o.run = 'late' AND o.t = c.t AND o.row = c.row AND o.col = c.col GROUP BY c.t, c.label""",
)
def objects_kept(spark, sf):
    r = run_cells(spark, sf)
    return X.objects_kept(G.label_components(r.where("run = 'base'")), r.where("run = 'late'")).select("t", "label", "kept")


@query(
    "run_summary",
    f"""WITH RECURSIVE {RUNS}, rt AS (SELECT run || t AS t, row, col FROM rn), {comp_sql('rt')}, ob AS (SELECT left(t, length(t) - 1) AS run, t, label, count(*) * 0.036864 AS ha FROM comp GROUP BY ALL),
ev AS (SELECT DISTINCT run, row, col FROM rn), b0 AS (SELECT row, col FROM ev WHERE run = 'base'), j AS (SELECT e.run, count(*) AS n, count(b0.row) AS b FROM ev e LEFT JOIN b0 USING (row, col) GROUP BY e.run)
SELECT o.run, count(*) AS objects, {s6('any_value(j.n) * 0.036864', 'detected_ha')}, {s6('sum(ha)', 'detections_ha')}, {s6('median(ha)', 'event_ha_median')}, {s6('quantile_cont(ha, 0.9)', 'event_ha_p90')}, {s6('100.0 * any_value(j.b) / (SELECT count(*) FROM b0)', 'baseline_area_kept_pct')},
  {s6('any_value(j.b) / (any_value(j.n) + (SELECT count(*) FROM b0) - any_value(j.b))::DOUBLE', 'jaccard_vs_baseline')} FROM ob o JOIN j ON j.run = o.run GROUP BY o.run""",
)
def run_summary(spark, sf):
    s = X.run_summary(run_cells(spark, sf), RUN_NAMES, 0.036864)
    return s.select("run", "objects", *[r6(c).alias(c) for c in ("detected_ha", "detections_ha", "event_ha_median", "event_ha_p90", "baseline_area_kept_pct", "jaccard_vs_baseline")])


PLACES = f"""{RUNS}, un AS (SELECT DISTINCT t, row, col FROM rn), {comp_sql('un')}, sz AS (SELECT t, label, count(*) * 0.036864 AS area_ha FROM comp GROUP BY ALL), ht AS (SELECT c.t, c.label, r.run, r.t AS t1, count(*) AS n FROM comp c JOIN rn r ON r.row = c.row AND r.col = c.col GROUP BY ALL),
an AS (SELECT c.t, c.label, r.run, count(DISTINCT (c.row, c.col)) AS n FROM comp c JOIN rn r ON r.row = c.row AND r.col = c.col GROUP BY ALL),
pl AS (SELECT s.t, s.label, area_ha, count(*) AS n_variants, CASE WHEN count(*) = 3 THEN 'all' WHEN NOT bool_or(a.run = 'base') THEN 'not_baseline' WHEN count(*) = 1 THEN 'baseline_only' ELSE 'some' END AS stratum, coalesce(max(a.n) FILTER (a.run = 'base'), 0) * 0.036864 AS ha_base FROM sz s JOIN an a ON a.t = s.t AND a.label = s.label GROUP BY s.t, s.label, area_ha),
sa AS (SELECT t, label, max(n) FILTER (t1 = t AND run = 'base') * 0.036864 AS same_base, arg_max(t1, (n, -t1)) FILTER (run = 'late') AS main_late FROM ht GROUP BY t, label)"""


@query(
    "union_places",
    f"""WITH RECURSIVE {PLACES} SELECT printf('L%04d', row_number() OVER (ORDER BY pl.t, area_ha DESC, pl.label)) AS loc_id, CASE pl.t WHEN 1 THEN '2015-2018' ELSE '2018-2021' END AS interval, {s6('area_ha', 'area_ha')}, n_variants, stratum, {s6('ha_base', 'ha_base')}, {s6('coalesce(same_base, 0)', 'same_ha_base')}, main_late FROM pl JOIN sa ON sa.t = pl.t AND sa.label = pl.label""",
)
def union_places(spark, sf):
    years = years_grid(spark, sf).select("unit", "t", "year").distinct()
    p = X.union_places(run_cells(spark, sf), RUN_NAMES, years, 0.036864)
    return p.select("loc_id", "interval", r6("area_ha").alias("area_ha"), "n_variants", "stratum", r6("ha_base").alias("ha_base"), r6("same_ha_base").alias("same_ha_base"), "main_late")


@query(
    "stratum_table",
    f"""WITH RECURSIVE {PLACES} SELECT stratum, count(*) AS places, {s6('sum(area_ha)', 'union_ha')}, count(*) FILTER (ha_base > coalesce(same_base, 0) + 1e-9) AS baseline_other_interval FROM pl JOIN sa ON sa.t = pl.t AND sa.label = pl.label GROUP BY stratum""",
)
def stratum_table(spark, sf):
    years = years_grid(spark, sf).select("unit", "t", "year").distinct()
    t = X.stratum_table(X.union_places(run_cells(spark, sf), RUN_NAMES, years, 0.036864), "base")
    return t.select("stratum", "places", r6("union_ha").alias("union_ha"), "baseline_other_interval")


