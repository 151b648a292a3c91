"""Queries on labels, chips, spatial joins, reports, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import r6
from sylvaflow.operators import cells as K
from sylvaflow.operators import components as G
from sylvaflow.operators import labels as L
from sylvaflow.operators import reports as R
from sylvaflow.operators import spatial as A
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.cell_queries import YGRID, ZGRID, years_grid, z_grid
from sylvaflow.plans.change_queries import FLAGS, KEPT, OBJ, OTHERS, comp_sql, flag_cells
from sylvaflow.plans.observation_queries import ANNUAL, HARMONIC, LEVEL, TREND
from sylvaflow.plans.stand_ins import OBS, observation_rows, table
from sylvaflow.plans.stand_queries import CROWNS, crowns
from sylvaflow.plans.verdict_queries import pick, sql_pick
from sylvaflow.session import cut_lineage, shared_folder
from sylvaflow.sources import observations as SO
from sylvaflow.sources import tables as ST
from sylvaflow.streaming import jobs as J

# --- reasons -------------------------------------------------------------------------------
OUTCOMES = ["loss_full", "loss_partial", "intact", "disagree", "under_min", "open", "loss_disputed", "rejected_weak", "stressed"]


def label_pixels(spark, sf):
    g = years_grid(spark, sf)
    f = F.col("forest")
    return g.select(
        F.lit("w").alias("window_id"), F.col("t").alias("k"), "row", "col", f.alias("forest_before"), (f & (F.col("z") < 1.8)).alias("forest_after"), F.when(F.col("row") % 31 != 0, F.col("chm_cover")).alias("cover_before"), F.col("chm_height").alias("height_before"),
        (F.col("z") / 8).alias("prob"), F.lit(False).alias("unstable"), F.lit(False).alias("never_green"), (F.col("col") == 63).alias("no_data"),
    )


def label_parts(spark, sf):
    """A candidate of 4 x 4 pixels in every block of 6 x 6."""
    g = years_grid(spark, sf)
    b = F.floor(F.col("row") / 6) * 11 + F.floor(F.col("col") / 6)
    out = pick(OUTCOMES, b)
    loss = out.isin(P.LOSS_OUTCOMES)
    part = F.when(~loss, "mask").when(F.col("row") % 6 < 2, "core").when(F.col("row") % 6 == 2, "trimmed").otherwise("extension")
    return g.where((F.col("row") % 6 < 4) & (F.col("col") % 6 < 4)).select(
        F.lit("w").alias("window_id"), F.col("t").alias("k"), "row", "col", b.alias("cand_id"), b.alias("seq"), out.alias("outcome"), part.alias("part"), (b % 2 == 0).alias("crisp"), (b % 5 == 0).alias("precise"),
        (b % 7 == 0).alias("wide_margin"), F.lit(False).alias("oversize"), (b % 6 + 1).alias("agent"),
    )


SMALL_RULE = {**P.RULES, "margin_m": 1.2, "margin_wide_m": 1.8, "band_envelope_m": 0.6, "band_precise_m": 0.6, "band_inside_precise_m": 0.6}


def _near(src: str, r2: int) -> str:
    return f"(SELECT DISTINCT {src}.k, {src}.r + dr AS r, {src}.c + dc AS c FROM {src}, o WHERE dr * dr + dc * dc <= {r2})"


# The oracle joins one flag per rule to every pixel and takes the last rule that applies.
REASON = f"""{YGRID}, px AS (SELECT t AS k, row AS r, col AS c, forest AS fb, forest AND z < 1.8 AS fa, CASE WHEN row % 31 <> 0 THEN chm_cover END AS cov, chm_height AS h, z / 8 AS prob FROM yg),
o AS (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest(generate_series(-3, 3)) AS i) a, (SELECT unnest(generate_series(-3, 3)) AS i) b),
pb AS (SELECT k, r, c, r // 6 * 11 + c // 6 AS b FROM px WHERE r % 6 < 4 AND c % 6 < 4), pa AS (SELECT *, {sql_pick(OUTCOMES, 'b')} AS oc FROM pb),
pt AS (SELECT *, oc LIKE 'loss%' AS loss, CASE WHEN oc NOT LIKE 'loss%' THEN 'mask' WHEN r % 6 < 2 THEN 'core' WHEN r % 6 = 2 THEN 'trimmed' ELSE 'extension' END AS part, b % 2 = 0 AS crisp, b % 5 = 0 AS pre, b % 7 = 0 AS wide FROM pa),
ring AS (SELECT * FROM pt WHERE oc NOT IN ('intact', 'open', 'stressed_recovered', 'under_min')), rw AS (SELECT * FROM ring WHERE wide), rp AS (SELECT * FROM ring WHERE NOT wide AND pre AND loss), rn AS (SELECT * FROM ring WHERE NOT wide AND NOT (pre AND loss)),
mg AS (SELECT * FROM {_near('rw', 9)} UNION SELECT * FROM {_near('rn', 4)} UNION SELECT k, r, c FROM rp),
lo AS (SELECT * FROM pt WHERE loss AND (part = 'core' OR (part = 'extension' AND crisp))), fp AS (SELECT DISTINCT k, r, c FROM pt WHERE loss AND part IN ('core', 'extension')), lp AS (SELECT * FROM lo WHERE pre), 
bo AS (SELECT * FROM {_near('lo', 1)} EXCEPT SELECT * FROM fp), nf AS (SELECT k, r, c FROM px EXCEPT SELECT * FROM fp), bi AS (SELECT DISTINCT l.k, l.r, l.c FROM lp l JOIN {_near('nf', 1)} n USING (k, r, c)),
fin AS (SELECT x.*, p.oc, p.loss, p.part, p.crisp, p.b, m.k IS NOT NULL AS mg, bo.k IS NOT NULL AS bo, bi.k IS NOT NULL AS bi FROM px x LEFT JOIN pt p USING (k, r, c) LEFT JOIN mg m USING (k, r, c) LEFT JOIN bo USING (k, r, c) LEFT JOIN bi USING (k, r, c)),
res AS (SELECT k, r, c, b, part, bi, cov, CASE WHEN c = 63 OR cov IS NULL THEN 1 WHEN bi THEN 20 WHEN bo THEN 21 WHEN loss AND part = 'core' THEN CASE oc WHEN 'loss_full' THEN 10 WHEN 'loss_partial' THEN 11 ELSE 12 END WHEN loss AND part = 'extension' AND crisp THEN CASE oc WHEN 'loss_full' THEN 13 ELSE 14 END
  WHEN loss AND part = 'extension' THEN 22 WHEN loss AND part = 'trimmed' THEN 23 WHEN oc = 'disagree' THEN 24 WHEN oc = 'rejected_weak' THEN 27 WHEN oc = 'stressed' THEN 38 WHEN oc = 'intact' THEN 40 WHEN oc = 'open' THEN 41 WHEN mg THEN 30 WHEN oc = 'under_min' THEN 31
  WHEN fb AND prob >= 0.2 THEN 32 WHEN fb AND NOT fa THEN 33 WHEN fb AND fa THEN 43 WHEN cov >= 0.05 OR h >= 2 THEN 34 ELSE 42 END AS reason FROM fin)"""


@query(
    "interval_reasons",
    f"WITH {REASON} SELECT k, r AS row, c AS col, reason, CASE WHEN reason IN (10, 11, 12, 13, 14) THEN b % 6 + 1 ELSE 255 END AS agent, CASE WHEN reason BETWEEN 10 AND 14 THEN 1 WHEN reason IN (39, 40, 41, 42, 43) THEN 0 ELSE 255 END AS change FROM res",
)
def interval_reasons(spark, sf):
    return L.interval_reasons(label_pixels(spark, sf), label_parts(spark, sf), SMALL_RULE).select("k", "row", "col", "reason", "agent", "change")


@query(
    "group_shares",
    f"WITH {REASON} SELECT k, {s6('avg((reason IN (10, 13))::INT)', 'loss_full')}, {s6('avg((reason IN (20, 21, 22, 23))::INT)', 'ignore_outline')}, {s6('avg((reason = 43)::INT)', 'background_forest')}, {s6('avg((reason BETWEEN 10 AND 14)::INT)', 'class_loss')} FROM res GROUP BY k",
)
def group_shares(spark, sf):
    lab = L.interval_reasons(label_pixels(spark, sf), label_parts(spark, sf), SMALL_RULE)
    g = L.group_shares(lab, ["window_id", "k"])
    return g.select("k", *[r6(c).alias(c) for c in ("loss_full", "ignore_outline", "background_forest", "class_loss")])


def reason_frame(spark, sf):
    """A cheap reason field: codes by the value of the grid."""
    z = F.col("z")
    code = F.when(z > 1.5, 10).when(z > 0.8, 30).when(z > 0.2, 43).when(z > -1.0, 42).otherwise(24)
    return years_grid(spark, sf).select(F.lit("w").alias("window_id"), F.col("t").alias("k"), "row", "col", code.alias("reason"), "z")


RF = f"""{YGRID}, rf AS (SELECT t AS k, row, col, z, CASE WHEN z > 1.5 THEN 10 WHEN z > 0.8 THEN 30 WHEN z > 0.2 THEN 43 WHEN z > -1 THEN 42 ELSE 24 END AS reason FROM yg)"""
MAJ = """mj AS (SELECT k, row // 2 AS row, col // 2 AS col, count(*) FILTER (reason = 10) AS a, count(*) FILTER (reason = 24) AS b, count(*) FILTER (reason = 30) AS c, count(*) FILTER (reason = 42) AS d, count(*) FILTER (reason = 43) AS e FROM rf GROUP BY ALL),
mm AS (SELECT k, row, col, CASE WHEN d + e >= 3.6 THEN CASE WHEN greatest(0, d, e) = 0 THEN 'background_verified' WHEN d >= e THEN 'background_nonforest' ELSE 'background_forest' END ELSE CASE WHEN greatest(a, b, c) = 0 THEN 'loss_full' WHEN a >= b AND a >= c THEN 'loss_full' WHEN b >= c THEN 'ignore_verdict' ELSE 'ignore_guard' END END AS majority FROM mj)"""


@query("majority_group", f"WITH {RF}, {MAJ} SELECT k, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, majority FROM mm")
def majority_group(spark, sf):
    return L.majority_group(reason_frame(spark, sf), 2, ["window_id", "k"]).select("k", "row", "col", "majority")


@query(
    "strong_cells",
    f"WITH {RF}, {MAJ}, zz AS (SELECT k, row // 2 AS row, col // 2 AS col, avg(z) - 1 AS z FROM rf GROUP BY ALL) SELECT k, majority, count(*) AS strong_cells FROM zz JOIN mm USING (k, row, col) WHERE z <= -1.5 GROUP BY ALL",
)
def strong_cells(spark, sf):
    z = mean_z(spark, sf)
    return L.strong_cells(z, L.majority_group(reason_frame(spark, sf), 2, ["window_id", "k"]), ["window_id", "k"], -1.5).select("k", "majority", "strong_cells")


def mean_z(spark, sf):
    half = lambda a: F.floor(F.col(a) / 2).cast("int").alias(a)
    return reason_frame(spark, sf).groupBy("window_id", "k", half("row"), half("col")).agg((F.avg("z") - 1).alias("z"))


@query(
    "suspect_clusters",
    f"""WITH RECURSIVE {RF}, {MAJ}, zz AS (SELECT k, row // 2 AS row, col // 2 AS col, avg(z) - 1 AS z FROM rf GROUP BY ALL), hit AS (SELECT k, row, col FROM zz JOIN mm USING (k, row, col) WHERE z <= -0.5 AND majority = 'background_forest'), {comp_sql('hit', 'comp', 'k')}
SELECT k, CAST(label AS BIGINT) AS label, count(*) AS cells, {s6('avg(z)', 'mean_z')}, CAST(min(row) AS INTEGER) AS row0, CAST(max(row) AS INTEGER) AS row1, CAST(min(col) AS INTEGER) AS col0, CAST(max(col) AS INTEGER) AS col1 FROM comp JOIN zz USING (k, row, col) GROUP BY k, label HAVING count(*) >= 2""",
)
def suspect_clusters(spark, sf):
    maj = L.majority_group(reason_frame(spark, sf), 2, ["window_id", "k"])
    s = L.suspect_clusters(mean_z(spark, sf), maj, ["window_id", "k"], strong=-0.5, least=2)
    return s.select("k", "label", "cells", r6("mean_z").alias("mean_z"), "row0", "row1", "col0", "col1")


@query(
    "event_survival",
    f"""WITH {RF}, cd AS (SELECT *, row // 8 * 8 + col // 8 AS cand FROM rf)
SELECT k, cand AS cand_id, {s6('count(*) * 0.36 / 10000', 'candidate_ha')}, {s6('avg((reason = 10)::INT)', 'loss_share')}, {s6('avg((reason = 30)::INT)', 'margin_share')} FROM cd GROUP BY k, cand""",
)
def event_survival(spark, sf):
    rf = reason_frame(spark, sf)
    lab = rf.select("window_id", "k", "row", "col", F.when(F.col("reason") == 30, 20).otherwise(F.col("reason")).alias("reason"), F.when(F.col("reason") == 10, 1).otherwise(0).alias("change"))
    br, bc = F.floor(F.col("row") / 8), F.floor(F.col("col") / 8)
    cand = rf.select("window_id", "k", "row", "col", (br * 8 + bc).alias("cand_id"), F.lit("loss_full").alias("outcome"))
    return L.event_survival(lab, cand).select("k", "cand_id", r6("candidate_ha").alias("candidate_ha"), r6("loss_share").alias("loss_share"), r6("band_share").alias("margin_share"))


# --- chips -----------------------------------------------------------------------------------
def chip_pixels(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_partkey") % 60).alias("chip_id"), F.concat(F.lit("u"), F.col("l_partkey") % 5).alias("unit"), F.concat(F.lit("w"), F.col("l_partkey") % 12).alias("window_id"), (F.col("l_linenumber") % 4).alias("k"),
        F.when(q <= 10, 255).when(q <= 30, 0).when(q <= 41, 1).otherwise(2).alias("change"), F.when(q > 30, F.col("l_suppkey") % 6 + 1).otherwise(255).alias("agent"),
    )


CHIPS = """cp AS (SELECT 'c' || (l_partkey % 60) AS chip_id, 'u' || (l_partkey % 5) AS unit, 'w' || (l_partkey % 12) AS window_id, l_linenumber % 4 AS k, CASE WHEN l_quantity <= 10 THEN 255 WHEN l_quantity <= 30 THEN 0 WHEN l_quantity <= 41 THEN 1 ELSE 2 END AS change, CASE WHEN l_quantity > 30 THEN l_suppkey % 6 + 1 ELSE 255 END AS agent FROM lineitem),
ck AS (SELECT chip_id, unit, window_id, k, count(*) FILTER (change = 0) AS b, count(*) FILTER (change = 1) AS p, count(*) FILTER (change = 2) AS f, count(*) FILTER (change = 255) AS i, count(*) AS n FROM cp GROUP BY ALL),
ct AS (SELECT chip_id, unit, window_id, '[' || string_agg(b, ',' ORDER BY k) || ']' AS background, '[' || string_agg(p, ',' ORDER BY k) || ']' AS partial, '[' || string_agg(f, ',' ORDER BY k) || ']' AS "full", sum(i) / sum(n) AS ignore_share, max(n) AS pixels FROM ck GROUP BY ALL)"""


def chips(spark, sf):
    return L.chip_table(chip_pixels(spark, sf), ["chip_id", "unit", "window_id"], 4)


@query("chip_table", f'WITH {CHIPS} SELECT chip_id, unit, window_id, background, partial, "full", {s6("ignore_share", "ignore_share")}, pixels FROM ct')
def chip_table(spark, sf):
    return chips(spark, sf).withColumn("ignore_share", r6("ignore_share"))


DATES = ["2012-06-01", "2014-07-02", "2016-06-15", "2018-08-03"]


def dated_chips(spark, sf):
    return chips(spark, sf).withColumns({"dates": F.lit('["' + '","'.join(DATES) + '"]'), "native_m": F.lit("[1.0,1.0,0.6,0.6]")})


@query(
    "chip_index",
    f"""WITH {CHIPS}, mx AS (SELECT chip_id, max(n) AS px FROM ck GROUP BY 1)
SELECT chip_id, unit, window_id, CAST(k AS INTEGER) AS k, (['{"', '".join(DATES)}'])[k + 1] AS date_a, (['{"', '".join(DATES)}'])[k + 2] AS date_b, ([1.0::DOUBLE, 1.0, 0.6, 0.6])[k + 2] AS native_b, {s6('(p + f) / px::DOUBLE', 'loss_share')}, {s6('(b + p + f) / px::DOUBLE', 'valid_share')}
FROM ck JOIN mx USING (chip_id) WHERE k < 3 AND (b + p + f) / px::DOUBLE >= 0.7""",
)
def chip_index(spark, sf):
    i = L.chip_index(dated_chips(spark, sf), min_valid=0.7)
    return i.select("chip_id", "unit", "window_id", "k", "date_a", "date_b", "native_b", r6("loss_share").alias("loss_share"), r6("valid_share").alias("valid_share"))


@query(
    "merge_chips",
    f"""WITH {CHIPS}, a AS (SELECT * FROM ct WHERE CAST(replace(chip_id, 'c', '') AS INTEGER) % 3 <> 0), b AS (SELECT * FROM ct WHERE CAST(replace(chip_id, 'c', '') AS INTEGER) % 2 = 0)
SELECT chip_id, 'one' AS run, 'one:' || window_id AS window_id, pixels FROM a UNION ALL SELECT chip_id, 'two', 'two:' || window_id, pixels FROM b WHERE chip_id NOT IN (SELECT chip_id FROM a)""",
)
def merge_chips(spark, sf):
    c = chips(spark, sf)
    n = F.substring("chip_id", 2, 9).cast("int")
    merged, _counts = L.merge_chips({"one": c.where(n % 3 != 0), "two": c.where(n % 2 == 0)})
    return merged.select("chip_id", "run", "window_id", "pixels")


@query("agent_cells", f"WITH {CHIPS} SELECT chip_id, {', '.join(s6(f'count(*) FILTER (agent = {c}) / 4.0', a) for a, c in P.AGENT_CODES.items())} FROM cp GROUP BY chip_id")
def agent_cells(spark, sf):
    return L.agent_cells(chip_pixels(spark, sf), 2).select("chip_id", *[r6(a).alias(a) for a in P.AGENT_CODES])


@query(
    "band_stats",
    f"""WITH b AS (SELECT l_linenumber % 3 * 20 AS red, l_suppkey % 5 * 30 AS nir FROM lineitem), s AS (SELECT red / 255.0 AS red, nir / 255.0 AS nir FROM b WHERE red <> 0 OR nir <> 0)
SELECT 'red' AS band, {s6('avg(red)', 'mean')}, {s6('stddev_pop(red)', 'std')} FROM s UNION ALL SELECT 'nir', {s6('avg(nir)')}, {s6('stddev_pop(nir)')} FROM s""",
)
def band_stats(spark, sf):
    b = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 3 * 20).alias("red"), (F.col("l_suppkey") % 5 * 30).alias("nir"))
    return L.band_stats(b, ["red", "nir"]).select("band", r6("mean").alias("mean"), r6("std").alias("std"))


# --- spatial ------------------------------------------------------------------------------------
def polygons(spark, sf):
    """One concave ring of five vertices per supplier."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 900).cast("double"), (k * 53 % 900).cast("double")
    w = 40.0 + k % 60
    v = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.array(v(0.25, 0.25), v(w, 0.25), v(w, w), v(w / 2, w / 3), v(0.25, w))
    return table(spark, sf, "supplier").select(F.concat(F.lit("p"), k).alias("stand_id"), ring.alias("vertices"))


POLY = """po AS (SELECT 'p' || s_suppkey AS stand_id, (s_suppkey * 37 % 900)::DOUBLE AS x, (s_suppkey * 53 % 900)::DOUBLE AS y, (40 + s_suppkey % 60)::DOUBLE AS w FROM supplier),
ed AS (SELECT stand_id, unnest([{'a': x + 0.25, 'b': y + 0.25, 'c': x + w, 'd': y + 0.25}, {'a': x + w, 'b': y + 0.25, 'c': x + w, 'd': y + w}, {'a': x + w, 'b': y + w, 'c': x + w / 2, 'd': y + w / 3}, {'a': x + w / 2, 'b': y + w / 3, 'c': x + 0.25, 'd': y + w}, {'a': x + 0.25, 'b': y + w, 'c': x + 0.25, 'd': y + 0.25}]) AS e FROM po)"""
CROSS = "(e.b > {y}) <> (e.d > {y}) AND {x} < e.a + ({y} - e.b) / (e.d - e.b) * (e.c - e.a)"


@query(
    "crowns_in_stand",
    f"""WITH {POLY}, {CROWNS}, pt AS (SELECT DISTINCT x, y FROM crowns), hit AS (SELECT stand_id, x, y FROM ed, pt WHERE {CROSS.format(x='x', y='y')} GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT h.stand_id, count(*) AS n_crowns, {s6('avg(d)', 'mean_diam')} FROM hit h JOIN crowns c ON c.x = h.x AND c.y = h.y GROUP BY h.stand_id""",
)
def crowns_in_stand(spark, sf):
    c = crowns(spark, sf).select("x", "y", "crown_diam_m")
    d = F.col("crown_diam_m")
    s = A.polygon_sums(c, polygons(spark, sf), "stand_id", 4.0, {"n_crowns": F.lit(1), "_d": d, "_n": F.when(d.isNotNull(), 1)})
    return s.select("stand_id", "n_crowns", r6(F.try_divide("_d", "_n")).alias("mean_diam"))


@query(
    "zone_cells",
    f"""WITH {POLY}, g AS (SELECT r AS row, c AS col, c * 2.0 + 1 AS px, 1000 - (r * 2.0 + 1) AS py FROM (SELECT unnest(generate_series(0, 499)) AS r) a, (SELECT unnest(generate_series(0, 499)) AS c) b),
hit AS (SELECT stand_id, row, col FROM ed, g WHERE px BETWEEN 0 AND 1000 AND {CROSS.format(x='px', y='py')} GROUP BY ALL HAVING count(*) % 2 = 1), bx AS (SELECT stand_id, (least(ceil((x + w) / 2), 500) - floor((x + 0.25) / 2)) * (least(ceil((1000 - y - 0.25) / 2), 500) - greatest(floor((1000 - y - w) / 2), 0)) AS n FROM po)
SELECT h.stand_id, count(*) AS n_inside, {s6('count(*) * 4.0', 'area_m2')}, {s6('count(*) / any_value(n)', 'bbox_fill_fraction')} FROM hit h JOIN bx USING (stand_id) GROUP BY h.stand_id""",
)
def zone_cells(spark, sf):
    z = A.zone_cells(polygons(spark, sf), "stand_id", 2.0, 500, 500, (0.0, 1000.0))
    s = A.zone_support(z, "stand_id", 2.0)
    return s.select("stand_id", "n_inside", r6("area_m2").alias("area_m2"), r6("bbox_fill_fraction").alias("bbox_fill_fraction"))


@query(
    "crowns_by_component",
    f"""WITH {ZGRID}, {CROWNS}, cc AS (SELECT row, col, CASE WHEN v > 1 THEN 1 WHEN v > 0 THEN 2 ELSE 3 END AS component FROM zg WHERE v IS NOT NULL), p AS (SELECT CAST(floor((1000 - y) / 2) AS INTEGER) AS row, CAST(floor(x / 2) AS INTEGER) AS col FROM crowns)
SELECT coalesce(component, 0) AS component, count(*) AS n FROM p LEFT JOIN cc USING (row, col) GROUP BY 1""",
)
def crowns_by_component(spark, sf):
    v = F.col("v")
    cells = z_grid(spark, sf).where("v IS NOT NULL").select(F.lit("g").alias("unit"), "row", "col", F.when(v > 1, 1).when(v > 0, 2).otherwise(3).alias("component"))
    at = A.code_under_points(crowns(spark, sf).withColumn("unit", F.lit("g")), cells, 2.0, "component", (0.0, 1000.0))
    return at.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(
    "at_centres",
    f"""WITH {ZGRID}, f AS (SELECT row, col, CAST(floor((row + 0.5) * 4.8 / 19.2) AS INTEGER) AS r, CAST(floor((col + 0.5) * 4.8 / 19.2) AS INTEGER) AS c FROM zg), k AS (SELECT row AS r, col AS c, CAST(row % 7 + col % 3 AS INTEGER) AS code FROM zg WHERE row < (SELECT max(row) FROM zg) * 0.2 AND col < 12)
SELECT f.row, f.col, coalesce(code, 0) AS code, code IS NOT NULL AS inside FROM f LEFT JOIN k USING (r, c)""",
)
def at_centres(spark, sf):
    g = z_grid(spark, sf).select("row", "col")
    g = g.withColumn("unit", F.lit("g"))
    extent = g.agg(F.max("row") * 0.2).scalar()  # the coarse grid covers most of the fine one, not all
    coarse = g.where((F.col("row") < extent) & (F.col("col") < 12)).withColumn("code", F.col("row") % 7 + F.col("col") % 3)
    return A.at_centres(g, coarse, 4.8, 19.2, "code").select("row", "col", "code", "inside")


@query(
    "label_cells",
    f"""WITH {YGRID}, p AS (SELECT t AS k, row // 4 AS r, col // 4 AS c, CASE WHEN z > 0.5 THEN 1 WHEN z < -1.5 THEN 255 ELSE 0 END AS ch FROM yg), s AS (SELECT k, r, c, avg((ch = 255)::INT) AS i, count(*) FILTER (ch = 1) AS l, count(*) FILTER (ch < 2) AS n FROM p GROUP BY ALL),
d AS (SELECT t AS k, row // 4 AS r, col // 4 AS c, CAST(least(100, greatest(0, round_even(chm_cover * 100, 0))) AS INTEGER) AS di FROM yg WHERE row % 4 = 2 AND col % 4 = 2)
SELECT k, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CASE WHEN i < 0.5 AND n > 0 AND l / n::DOUBLE >= 0.5 THEN 1 WHEN i < 0.5 AND n > 0 AND l / n::DOUBLE <= 0.1 THEN 0 ELSE 255 END AS target, coalesce(di, 255) AS di FROM s LEFT JOIN d USING (k, r, c)""",
)
def label_cells(spark, sf):
    from sylvaflow.functions.scalars import to_percent

    g = years_grid(spark, sf)
    z = F.col("z")
    px = g.select("unit", F.col("t").alias("k"), "row", "col", F.when(z > 0.5, 1).when(z < -1.5, 255).otherwise(0).alias("change"), F.lit(1).alias("agent"))
    prior = g.select("unit", F.col("t").alias("k"), "row", "col", to_percent(F.col("chm_cover")).alias("percent"))
    return A.label_cells(px, prior, 4).select("k", "row", "col", "target", "di")


def boxes(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    # a strip of squares that grows with the table, so that a box has as many neighbours at any size
    x, y = F.col("o_totalprice") % 9000 + F.floor(k / 15000) * 9600, (k * 13 % 9000).cast("double")
    return o.select(k.alias("object_id"), x.alias("minx"), (x + k % 90).alias("maxx"), y.alias("miny"), (y + k % 70).alias("maxy"), (k % 11 / 10.0).alias("area_ha"))


NEARBY = """WITH b AS (SELECT o_orderkey AS id, o_totalprice % 9000 + o_orderkey // 15000 * 9600 AS x0, o_totalprice % 9000 + o_orderkey // 15000 * 9600 + o_orderkey % 90 AS x1, (o_orderkey * 13 % 9000)::DOUBLE AS y0, o_orderkey * 13 % 9000 + o_orderkey % 70 AS y1, (o_orderkey % 11) / 10.0 AS ha FROM orders), f AS (SELECT * FROM b)
SELECT f.id AS focus_id, count(*) AS n, count(*) FILTER (b.id % 3 = 0) AS refined, round(sum(CASE WHEN b.id % 3 = 0 THEN b.ha * 2 ELSE b.ha END), 6) + 0.0 AS area_ha FROM f JOIN b ON b.x1 >= f.x0 - 300 AND b.x0 <= f.x1 + 300 AND b.y1 >= f.y0 - 300 AND b.y0 <= f.y1 + 300 GROUP BY f.id"""


@query("nearby_objects", NEARBY)
def nearby_objects(spark, sf):
    b = boxes(spark, sf)
    focus = b.withColumnRenamed("object_id", "focus_id")
    refined = b.where("object_id % 3 = 0").select("object_id", (F.col("area_ha") * 2).alias("area_ha"))
    n = A.nearby(b, focus, 300.0, 512.0, refined)
    return n.groupBy("focus_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("geom_src") == "refined", 1)).alias("refined"), r6(F.sum("area_ha")).alias("area_ha"))


@query("nearby_every_object", NEARBY)
def nearby_every_object(spark, sf):
    b = boxes(spark, sf)
    refined = b.where("object_id % 3 = 0").select("object_id", (F.col("area_ha") * 2).alias("area_ha"))
    n = A.nearby(b, b.withColumnRenamed("object_id", "focus_id"), 300.0, 512.0, refined, one_box=True)
    return n.groupBy("focus_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("geom_src") == "refined", 1)).alias("refined"), r6(F.sum("area_ha")).alias("area_ha"))


@query(
    "tile_strata",
    """WITH c AS (SELECT l_orderkey % 64 // 16 * 10 + l_partkey % 64 // 16 AS tile, 's' || (l_suppkey % 9) AS stand, (['Fire', 'Harvest', 'Weather'])[CAST(l_suppkey % 3 + 1 AS INTEGER)] AS lab, count(DISTINCT (l_orderkey % 64, l_partkey % 64)) AS n FROM lineitem GROUP BY ALL)
SELECT tile, CASE WHEN n / 256.0 >= 0.8 THEN stand ELSE '' END AS stand_id, CASE WHEN n / 256.0 >= 0.8 THEN lab ELSE 'undisturbed' END AS stratum FROM c QUALIFY row_number() OVER (PARTITION BY tile ORDER BY n DESC, stand DESC) = 1""",
)
def tile_strata(spark, sf):
    line, s = table(spark, sf, "lineitem"), F.col("l_suppkey")
    row, c = F.col("l_orderkey") % 64, F.col("l_partkey") % 64
    cover = line.select((F.floor(row / 16) * 10 + F.floor(c / 16)).alias("tile"), F.concat(F.lit("s"), s % 9).alias("stand_id"), pick(["Fire", "Harvest", "Weather"], s).alias("dist_label"), row.alias("row"), c.alias("col"))
    return A.tile_strata(cover, 256, 0.8)


@query(
    "whole_tiles",
    """WITH e AS (SELECT 'u' || (o_custkey % 30) AS unit, min(o_totalprice % 700) AS x0, min(o_totalprice % 900) AS y0, 2000 + max(o_totalprice % 777) AS x1, 1500 + max(o_totalprice % 555) AS y1 FROM orders GROUP BY 1),
n AS (SELECT *, greatest(CAST(ceil((x1 - 300 - x0) / 300) AS INTEGER), 0) AS nx, greatest(CAST(ceil((y1 - 300 - y0) / 300) AS INTEGER), 0) AS ny FROM e)
SELECT unit, nx * ny AS n_tiles, round(x0 + (nx - 1) * 300, 6) + 0.0 AS last_x FROM n""",
)
def whole_tiles(spark, sf):
    p = F.col("o_totalprice")
    e = table(spark, sf, "orders").groupBy(F.concat(F.lit("u"), F.col("o_custkey") % 30).alias("unit")).agg(F.min(p % 700).alias("minx"), F.min(p % 900).alias("miny"), (2000 + F.max(p % 777)).alias("maxx"), (1500 + F.max(p % 555)).alias("maxy"))
    return A.whole_tiles(e, 300.0).groupBy("unit").agg(F.count(F.lit(1)).alias("n_tiles"), r6(F.max("x0")).alias("last_x"))


@query(
    "ring_series",
    f"""WITH RECURSIVE {YGRID}, {FLAGS}, {comp_sql('flags')}, big AS (SELECT t, label FROM comp GROUP BY t, label HAVING count(*) >= 8), ob AS (SELECT t, label, row, col FROM comp JOIN big USING (t, label)),
o AS (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS i) a, (SELECT unnest([-2, -1, 0, 1, 2]) AS i) b WHERE a.i * a.i + b.i * b.i <= 4), rg AS (SELECT DISTINCT t, label, row + dr AS row, col + dc AS col FROM ob, o EXCEPT SELECT t, label, row, col FROM ob),
al AS (SELECT t, label, row, col, 'i' AS zn FROM ob UNION ALL SELECT t, label, row, col, 'r' FROM rg)
SELECT al.t, CAST(label AS BIGINT) AS object_id, year, {s6("avg(chm_height) FILTER (zn = 'i')", 'inside')}, {s6("avg(chm_height) FILTER (zn = 'r')", 'ring')} FROM al JOIN yg ON yg.row = al.row AND yg.col = al.col GROUP BY al.t, label, year""",
)
def ring_series(spark, sf):
    obj = G.drop_small(flag_cells(spark, sf), 8).select(F.lit("g").alias("unit"), "t", F.col("label").alias("object_id"), "row", "col")
    heights = years_grid(spark, sf).select(F.lit("g").alias("unit"), "row", "col", "year", F.col("chm_height").alias("height"))
    return A.ring_series(heights, obj, 2, ("unit", "t", "object_id")).select("t", "object_id", "year", r6("inside").alias("inside"), r6("ring").alias("ring"))


# --- reports -----------------------------------------------------------------------------------
def detection(spark, sf):
    g = K.monitored_flags(years_grid(spark, sf)).withColumns({"flag": F.col("z") > 1.1, "probability": F.col("chm_cover")})
    det = G.interval_detections(flag_cells(spark, sf), [0, 1, 2], least=6, growth=3)
    cells = g.join(det.select(*K.DATE, "row", "col", F.lit(True).alias("detected")), [*K.DATE, "row", "col"], "left").withColumn("detected", F.coalesce("detected", F.lit(False)))
    years = g.select("unit", "t", "year").distinct()
    return cells, G.detection_objects(det, g, years, growth_below=6), years


@query(
    "interval_summary",
    f"""WITH RECURSIVE {YGRID}, {FLAGS}, {comp_sql('flags')}, {KEPT}, {OBJ}, mo AS (SELECT *, coalesce(lag(forest) OVER (PARTITION BY row, col ORDER BY t), FALSE) AS monitored FROM yg), rp AS (SELECT f.t, count(*) FILTER (earlier) AS n_rep FROM first f GROUP BY f.t),
a AS (SELECT m.t, count(*) FILTER (monitored) AS mon, count(d.label) AS det, count(*) FILTER (z > 1.1) AS fl FROM mo m LEFT JOIN det d ON d.t = m.t AND d.row = m.row AND d.col = m.col GROUP BY m.t)
SELECT a.t, (2012 + 3 * a.t) || '-' || (2015 + 3 * a.t) AS interval, {s6('mon * 0.036864', 'monitored_ha')}, {s6('det * 0.036864', 'detected_ha')}, {s6('fl * 0.036864', 'detected_ha_nommu')}, {s6('n_rep * 0.036864', 'repeat_ha')}, {s6('det / mon::DOUBLE', 'share_of_monitored')},
  (SELECT count(*) FROM onum o WHERE o.t = a.t) AS n_objects, {s6('(SELECT coalesce(sum(n_cells), 0) FROM onum o WHERE o.t = a.t AND n_cells < 6) * 0.036864', 'growth_ha')} FROM a LEFT JOIN rp ON rp.t = a.t WHERE a.t > 0""",
)
def interval_summary(spark, sf):
    cells, objects, years = detection(spark, sf)
    fits = years.select("unit", "t", *[F.lit(None).cast("double").alias(c) for c in ("mu0", "sigma0", "p0")], F.lit("central").alias("method"), F.lit(False).alias("skipped"))
    s = R.interval_summary(cells, objects, fits, years, 0.036864)
    return s.select("t", "interval", *[r6(c).alias(c) for c in ("monitored_ha", "detected_ha", "detected_ha_nommu", "repeat_ha", "share_of_monitored")], "n_objects", r6("growth_ha").alias("growth_ha"))


@query("run_checks")
def run_checks(spark, sf):
    cells, objects, years = detection(spark, sf)
    cells, objects = cut_lineage(cells), cut_lineage(objects)
    fits = years.select("unit", "t", F.lit(0.0).alias("mu0"), F.when(F.col("t") == 2, 1.7).otherwise(1.0).alias("sigma0"), F.lit(1.0).alias("p0"), F.lit("central").alias("method"), F.lit(False).alias("skipped"))
    summary = R.interval_summary(cells, objects, fits, years, 0.036864)
    on = K.onset(cells.withColumn("flag", F.col("detected")))
    forest = R.forest_area(cells, 0.036864).join(years, K.DATE)
    images = table(spark, sf, "orders").select(F.lit("g").alias("unit"), (F.year("o_orderdate") + 20).alias("year"), F.to_date("o_orderdate").alias("date"))
    images = images.groupBy("unit", "year").agg(F.min("date").alias("date"))
    heights = cells.select("unit", "year", F.col("chm_height").alias("height"))
    return R.check_run(summary, R.run_totals(cells, objects, 0.036864), on, objects, forest, heights, images, 0.036864)


# --- sources ---------------------------------------------------------------------------------------
@query(
    "normalize_observations",
    f"""WITH r AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS stand_id, CAST(o_orderkey AS VARCHAR) AS image_id, epoch_ms(o_orderdate) AS ms, o_totalprice % 997 AS w, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 60 END AS n FROM orders)
SELECT stand_id, image_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS date, CAST(year(make_timestamp(ms * 1000)) AS INTEGER) AS year, CAST(dayofyear(make_timestamp(ms * 1000)) AS INTEGER) AS doy, coalesce(n, 0) AS n_pixels, round(CAST(CAST(w / ((20 + CAST(stand_id AS INTEGER)) * 450.0::DOUBLE / 900) AS FLOAT) AS DOUBLE), 3) + 0.0 AS coverage, 0 AS wrs_path FROM r""",
)
def normalize_observations(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    raw = o.select((F.col("o_custkey") % 100).cast("string").alias("stand_id"), k.cast("string").alias("image_id"), (F.unix_timestamp("o_orderdate") * 1000).alias("time_ms"), (F.col("o_totalprice") % 997).alias("valid_sum"), F.when(k % 7 != 0, k % 60).alias("valid_count"))
    areas = raw.select("stand_id").distinct().select("stand_id", ((20 + F.col("stand_id").cast("int")) * 450.0).alias("area_m2"))
    n = SO.normalize(raw, areas)
    return n.select("stand_id", "image_id", "date", F.col("year").cast("int").alias("year"), F.col("doy").cast("int").alias("doy"), "n_pixels", F.round(F.col("coverage_fraction").cast("double"), 3).alias("coverage"), F.col("wrs_path").cast("int").alias("wrs_path"))


@query(
    "append_observations",
    """WITH a AS (SELECT o_custkey % 100 AS stand_id, o_orderkey // 3 AS image_id, o_orderkey AS time_ms, o_totalprice AS v, o_orderdate AS d FROM orders),
e AS (SELECT stand_id, image_id, time_ms, v FROM a WHERE d < DATE '1999-01-01'), n AS (SELECT * FROM (SELECT stand_id, image_id, time_ms, v FROM a WHERE d >= DATE '1998-01-01') q QUALIFY row_number() OVER (PARTITION BY stand_id, image_id ORDER BY time_ms DESC) = 1)
SELECT * FROM n UNION ALL SELECT e.* FROM e ANTI JOIN n USING (stand_id, image_id)""",
)
def append_observations(spark, sf):
    k = F.col("o_orderkey")
    o, day = table(spark, sf, "orders"), F.col("o_orderdate")
    row = lambda t: t.select((F.col("o_custkey") % 100).alias("stand_id"), F.floor(k / 3).alias("image_id"), k.alias("time_ms"), F.col("o_totalprice").alias("v"))
    return SO.append(row(o.where(day < "1999-01-01")), row(o.where(day >= "1998-01-01")))


@query(
    "decoded_stands",
    f"""WITH d AS (SELECT s_suppkey, (['AlderNE', 'Birch', 'CedarSW'])[CAST(s_suppkey % 3 + 1 AS INTEGER)] AS doqq, s_suppkey % 20 AS u, CASE WHEN s_suppkey % 11 = 0 THEN 999 ELSE 110 + s_suppkey % 35 END AS dt, (40 + s_suppkey % 60)::DOUBLE AS w FROM supplier), e AS (SELECT * FROM d WHERE dt <> 999),
b AS (SELECT *, upper(left(regexp_replace(doqq, '[NSEW]*$', ''), 3) || regexp_extract(doqq, '([NSEW]*)$', 1)) || '-U' || u || '-0-' || (s_suppkey % 2) AS base, abs((0.25 * 0.25 - w * 0.25) + (w * w - w * 0.25) + (w * w / 3 - w / 2 * w) + (w / 2 * w - 0.25 * w / 3) + (0.25 * 0.25 - 0.25 * w)) / 2 AS area FROM e)
SELECT s_suppkey, base || CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN chr(CAST(96 + row_number() OVER (PARTITION BY base ORDER BY area DESC) AS INTEGER)) ELSE '' END AS stand_id, CASE WHEN dt = 120 THEN 'Clearcut' ELSE 'Unknown' END AS dist_label, CASE dt // 10 * 10 WHEN 110 THEN 'Fire' WHEN 120 THEN 'Harvest' WHEN 130 THEN 'Weather' WHEN 140 THEN 'Mining' ELSE 'Unknown' END AS dist_group, {s6('area', 'area_m2')}, {s6('area / ((w - 0.25) * (w - 0.25))', 'bbox_fill')} FROM b""",
)
def decoded_stands(spark, sf):
    k = F.col("s_suppkey")
    w = 40.0 + k % 60
    v = lambda a, b: F.struct(F.lit(a).cast("double").alias("x") if not hasattr(a, "alias") else a.alias("x"), F.lit(b).cast("double").alias("y") if not hasattr(b, "alias") else b.alias("y"))
    d = table(spark, sf, "supplier").select("s_suppkey", pick(["AlderNE", "Birch", "CedarSW"], k).alias("doqq"), (k % 20).alias("uid1"), F.lit(0).alias("uid2"), (k % 2).alias("uid3"), F.when(k % 11 == 0, 999).otherwise(110 + k % 35).cast("int").alias("dist_type"),
                                            F.array(v(0.25, 0.25), v(w, 0.25), v(w, w), v(w / 2, w / 3), v(0.25, w)).alias("vertices"))
    return ST.read_stands(d, {120: "Clearcut"}).select("s_suppkey", "stand_id", "dist_label", "dist_group", r6("area_m2").alias("area_m2"), r6("bbox_fill").alias("bbox_fill"))


@query(
    "input_inventory",
    r"""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '/d/naip/' ELSE '/d/chm/' END || CASE WHEN o_orderkey % 17 = 0 THEN 'misc' ELSE CAST(year(o_orderdate) + 15 AS VARCHAR) END || '/x_' || CASE WHEN o_orderkey % 5 = 0 THEN 'nodate' ELSE strftime(o_orderdate, '%Y%m%d') END || '_a.tif' AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'int16' ELSE 'float32' END AS dtype, o_orderdate AS d FROM orders)
SELECT k, CAST(regexp_extract(path, '/(\d{4})/', 1) AS INTEGER) AS year, CASE WHEN k % 2 = 0 THEN 'naip' ELSE 'chm' END AS kind, CASE WHEN k % 5 <> 0 THEN strftime(d, '%Y-%m-%d') END AS acquired, CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE WHEN k % 3 = 0 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM f WHERE k % 17 <> 0""",
)
def input_inventory(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    folder = F.when(k % 17 == 0, "misc").otherwise((F.year("o_orderdate") + 15).cast("string"))
    name = F.when(k % 5 == 0, "nodate").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    path = F.concat(F.when(k % 2 == 0, "/d/naip/").otherwise("/d/chm/"), folder, F.lit("/x_"), name, F.lit("_a.tif"))
    files = o.select(k.alias("k"), path.alias("path"), F.when(k % 3 == 0, "int16").otherwise("float32").alias("dtype"), F.lit(None).cast("double").alias("scale"))
    return ST.input_inventory(files).select("k", "year", "kind", F.date_format("acquired", "yyyy-MM-dd").alias("acquired"), "scale")


@query(
    "review_store",
    """WITH s AS (SELECT o_orderkey AS sample_id, 'u' || (o_custkey % 9) AS unit, o_orderkey AS "order" FROM orders), l AS (SELECT event_id % 3000 AS sample_id, event_type AS verdict FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 3000 ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT s.unit, s.sample_id FROM s WHERE sample_id NOT IN (SELECT sample_id FROM l) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY "order" <= 9000, "order") = 1)
SELECT s.unit, count(l.verdict) AS done, count(*) AS total, any_value(n.sample_id) AS next_sample FROM s LEFT JOIN l USING (sample_id) JOIN n ON n.unit = s.unit GROUP BY s.unit""",
)
def review_store(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("u"), F.col("o_custkey") % 9).alias("unit"), F.col("o_orderkey").alias("order"))
    log = table(spark, sf, "events").select((F.col("event_id") % 3000).alias("sample_id"), F.col("event_type").alias("verdict"), F.col("ts").alias("saved_at"), F.col("event_id").alias("line"))
    labels = ST.save_labels(log, o)
    after = o.select("unit").distinct().withColumn("order", F.lit(9000))
    nxt = ST.next_open(o, labels, after).select("unit", F.col("sample_id").alias("next_sample"))
    return ST.review_progress(o, labels).join(nxt, "unit")


@query(
    "complete_runs",
    """WITH c AS (SELECT DISTINCT 'u' || (o_custkey % 60) AS unit FROM orders), f AS (SELECT DISTINCT 'u' || (o_custkey % 60) AS unit, (['objects', 'cells', 'params'])[CAST(least(o_orderkey // 61 % 3, CASE WHEN o_custkey % 60 % 4 = 1 THEN 1 ELSE 2 END) + 1 AS INTEGER)] AS file FROM orders)
SELECT unit FROM f GROUP BY unit HAVING count(DISTINCT file) FILTER (file IN ('objects', 'params')) = 2""",
)
def complete_runs(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    unit = F.concat(F.lit("u"), F.col("o_custkey") % 60)
    cat = o.select(F.lit("default").alias("run_tag"), unit.alias("unit")).distinct()
    last = F.when(F.col("o_custkey") % 60 % 4 == 1, 1).otherwise(2)  # a quarter of the units never gets its params
    files = o.select(F.lit("default").alias("run_tag"), unit.alias("unit"), pick(["objects", "cells", "params"], F.least(F.floor(k / 61) % 3, last)).alias("file"))
    return ST.list_runs(cat, "default", files, ["objects", "params"]).select("unit")


@query(
    "year_stack",
    f"WITH {YGRID}, n AS (SELECT row, col FROM yg GROUP BY ALL HAVING count(*) = 3) SELECT CAST(2015 + 3 * t AS INTEGER) AS year, t, count(*) AS n, {s6('sum(chm_height)', 'total')} FROM yg JOIN n USING (row, col) GROUP BY t",
)
def year_stack(spark, sf):
    g = years_grid(spark, sf)
    shared = g.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("row", "col")
    g = g.join(shared, ["row", "col"])
    stack = ST.stack_years({2015 + 3 * t: g.where(F.col("t") == t).select("row", "col", "chm_height") for t in (0, 1, 2)})
    return stack.groupBy("year", "t").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("chm_height")).alias("total"))


# --- streams ------------------------------------------------------------------------------------------
def in_batches(spark, df, parts, start):
    """Run a stream job over rows that arrive part by part; each part is at least one micro-batch with the state of those before."""
    folder = shared_folder(spark, "stream-in")
    for part in parts:
        df.where(part).write.mode("append").parquet(folder)
        start(spark.readStream.schema(df.schema).parquet(folder)).awaitTermination()


def thirds(key):
    """Three parts that interleave in time, so later parts hold late rows; the second repeats some rows of the first."""
    return [key % 3 == 0, (key % 3 == 1) | (key % 6 == 0), key % 3 == 2]




@query(
    "stream_dedup",
    "SELECT DISTINCT user_id AS stand_id, event_id % 40 AS image_id FROM events",
)
def stream_dedup(spark, sf):
    out, ckpt = shared_folder(spark, "stream"), shared_folder(spark, "stream-state")
    e = table(spark, sf, "events")

    def start(stream):
        s = stream.select(F.col("user_id").alias("stand_id"), (F.col("event_id") % 40).alias("image_id"), F.col("ts").cast("timestamp").alias("time"))
        return J.start_once(s, J.append_sink(out, ["stand_id", "image_id"]), ckpt)

    in_batches(spark, e, thirds(F.col("event_id")), start)
    return spark.read.parquet(out).select("stand_id", "image_id")


@query(
    "stream_latest",
    """WITH a AS (SELECT user_id % 7 AS interpreter, user_id % 50 AS item, event_type AS answer, event_id % 6 = 0 AS void, ts, event_id FROM events)
SELECT interpreter, item, answer FROM (SELECT *, row_number() OVER (PARTITION BY interpreter, item ORDER BY ts DESC, event_id DESC) AS n FROM a) q WHERE n = 1 AND NOT void""",
)
def stream_latest(spark, sf):
    out, ckpt = shared_folder(spark, "stream"), shared_folder(spark, "stream-state")
    u, i = F.col("user_id"), F.col("event_id")
    keys, order = ["interpreter", "item"], ["saved", "line"]

    def start(stream):
        s = stream.select((u % 7).alias("interpreter"), (u % 50).alias("item"), F.col("event_type").alias("answer"), (i % 6 == 0).alias("void"), F.col("ts").alias("saved"), i.alias("line"))
        return J.start_once(s, J.folding(J.upsert_sink(out, keys, order), out, keys, order, every=2), ckpt)

    in_batches(spark, table(spark, sf, "events"), thirds(i), start)
    last = J.latest_rows(spark, out, keys, order)
    return last.where(~F.col("void")).select("interpreter", "item", "answer")


def _evidence_sql() -> str:
    parts = ["e0 AS (SELECT vec_id, c, l[1] AS x0, 0 AS s0, l FROM (SELECT vec_id, c, [embedding[c] * 8.0::DOUBLE, embedding[c + 16] * 8.0::DOUBLE, embedding[c + 32] * 8.0::DOUBLE, embedding[c + 48] * 8.0::DOUBLE] AS l FROM embeddings, (SELECT unnest(generate_series(1, 16)) AS c) g) q)"]
    for t in (1, 2, 3):
        parts.append(f"e{t} AS (SELECT *, greatest(0, 0.8 * x{t - 1}) + l[{t + 1}] AS x{t} FROM e{t - 1})")
    rows = " UNION ALL ".join(f"SELECT {t} AS t, count(*) AS n, count(*) FILTER (x{t} > 0) AS running, round(avg(1 / (1 + exp(-(ln(0.05 / 0.95) + x{t})))), 5) AS mean_prob FROM e3" for t in range(4))
    return f"WITH {', '.join(parts)} {rows}"


@query("stream_evidence", _evidence_sql())
def stream_evidence(spark, sf):
    out, ckpt = shared_folder(spark, "stream"), shared_folder(spark, "stream-state")
    s = table(spark, sf, "embeddings").select(F.lit("g").alias("unit"), F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "llr"))
    cells = s.select("unit", "row", (F.col("col") % 16).cast("int").alias("col"), F.floor(F.col("col") / 16).cast("int").alias("t"), (F.col("llr") * 8).cast("double").alias("llr"))
    save = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
    t = F.col("t")
    # the second date comes last, so later dates are given again
    in_batches(spark, cells, [t == 0, t > 1, t == 1], lambda stream: J.start_once(J.running_evidence(stream, 0.05, decay=0.8), save, ckpt))
    r = J.evidence_in_force(spark.read.parquet(out))
    return r.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("onset") >= 0, 1)).alias("running"), F.round(F.avg("prob"), 5).alias("mean_prob"))


@query(
    "stream_annual",
    f"""WITH {OBS}, {LEVEL}, {HARMONIC}, {TREND}, {ANNUAL}
SELECT stand_id, year, n_obs, {s6('ndvi_mean', 'ndvi_mean')}, {s6('amplitude', 'amplitude')}, {s6('slope', 'slope')} FROM annual WHERE n_raw > 0""",
)
def stream_annual(spark, sf):
    obs, annual, state = (shared_folder(spark, n) for n in ("observations", "annual", "stream-state"))
    o = observation_rows(table(spark, sf, "orders"))
    late = F.pmod(F.xxhash64("stand_id", "image_id"), F.lit(6))
    in_batches(spark, o, thirds(late), lambda stream: J.start_once(stream, J.annual_sink(obs, annual, (1995, 2001)), state))
    a = J.read_annual(spark, annual).where("sat_n_observations_raw > 0")
    return a.select("stand_id", "year", F.col("sat_n_observations").alias("n_obs"), r6("ndvi_mean").alias("ndvi_mean"), r6("ndvi_seasonal_amplitude").alias("amplitude"), r6("ndvi_trend").alias("slope"))


# --- candidates ------------------------------------------------------------------------------------------
@query(
    "window_candidates",
    """WITH c AS (SELECT l_partkey % 200 AS cand, l_orderkey % 64 AS row, l_partkey % 64 AS col FROM lineitem GROUP BY ALL), s AS (SELECT cand, count(*) AS n FROM c GROUP BY 1), w AS (SELECT * FROM (VALUES ('w1', 0, 31, 0, 63), ('w2', 20, 60, 10, 40)) t(window_id, r0, r1, c0, c1))
SELECT window_id, cand AS cand_id, round(count(*) * 0.036864::DOUBLE, 6) AS visible_ha, count(*) * 0.036864 < 0.98 * any_value(n) * 0.036864 AS clipped, any_value(n) * 0.036864 >= 0.9 AND count(*) * 0.036864 >= 0.9 AS judged FROM c JOIN s USING (cand) JOIN w ON row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY window_id, cand""",
)
def window_candidates(spark, sf):
    row, c = F.col("l_orderkey") % 64, F.col("l_partkey") % 64
    cells = table(spark, sf, "lineitem").select((F.col("l_partkey") % 200).alias("cand_id"), row.alias("row"), c.alias("col")).distinct()
    items = F.array_compact(F.array(F.when(F.col("row").between(0, 31), "w1"), F.when(F.col("row").between(20, 60) & F.col("col").between(10, 40), "w2")))
    seen = cells.select("*", F.explode(items).alias("window_id"))
    return L.window_candidates(cells, seen, 0.036864, 0.9).select("window_id", "cand_id", r6("visible_ha").alias("visible_ha"), "clipped", "judged")


@query(
    "unit_candidates",
    f"""WITH RECURSIVE {YGRID}, {FLAGS}, {comp_sql('flags')}, {KEPT}, {OBJ}, {OTHERS}
SELECT 'g-di-' || (2015 + 3 * t) || '-' || object_id AS cand_id, 'di' AS source, {s6('n_cells * 0.036864', 'area_ha')}, {s6('mean_prob', 'mean_prob')} FROM onum WHERE t > 0
UNION ALL SELECT 'g-' || source || '-' || (2015 + 3 * t) || '-' || row_number() OVER (PARTITION BY t ORDER BY label), source, {s6('n_cells * 0.036864')}, {s6('mean_prob')} FROM oc""",
)
def unit_candidates(spark, sf):
    cells, objects, years = detection(spark, sf)
    g = years_grid(spark, sf).withColumn("probability", F.col("z") / 5)
    others = G.other_candidates(g, g.where("z < -2.6"), rule={**P.CANDIDATES, "chm_loss_min_drop": 0.5})
    u = L.unit_candidates(objects.where("onset_index > 0"), others, years)
    return u.select("cand_id", "source", r6("area_ha").alias("area_ha"), r6("mean_prob").alias("mean_prob"))


@query(
    "eligible_windows",
    """SELECT 'w' || o_orderkey AS window_id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""",
)
def eligible_windows(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    w = o.select(F.concat(F.lit("w"), k).alias("window_id"), F.when(F.col("o_orderstatus") == "F", "di").when(F.col("o_orderstatus") == "O", "quiet").otherwise("reviewed").alias("stratum"), F.when(k % 7 != 0, 0.5).alias("incl_prob"))
    return L.eligible_windows(w, o.where(k % 11 == 0).select(F.concat(F.lit("w"), k).alias("window_id"))).select("window_id")


@query("standardized")
def standardized(spark, sf):
    from sylvaflow.operators.null_model import standardize

    z = standardize(z_grid(spark, sf), "v", "pop", "local_twopass", 7)
    return z.agg(F.count("z").alias("n"), F.round(F.avg("z"), 4).alias("mean"), F.round(F.stddev_pop("z"), 4).alias("sd"))
