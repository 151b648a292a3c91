"""Queries on null models, decision rules, components and objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import r6
from sylvaflow.operators import cells as K
from sylvaflow.operators import components as G
from sylvaflow.operators import null_model as N
from sylvaflow.operators.decide import decide
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.cell_queries import YGRID, ZGRID, gauss_sql, years_grid, z_grid
from sylvaflow.session import cut_lineage

# The fit works on moments about the first edge, the oracle on centred ones.
NULL = ZGRID + """,
u AS (SELECT row, col, v FROM zg WHERE pop AND v IS NOT NULL),
qs AS (SELECT quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi, count(*) AS n, min(v) AS zmin FROM u),
nb AS (SELECT *, CAST(ceil((hi + 0.05 - lo) / 0.05) AS INTEGER) - 1 AS nb FROM qs),
hist AS (SELECT least(CAST(floor((v - lo) / 0.05) AS INTEGER), nb - 1) AS b, count(*) AS c FROM u, nb WHERE (v - lo) / 0.05 BETWEEN 0 AND nb GROUP BY 1),
pts AS (SELECT lo + (b + 0.5) * 0.05 AS x, ln(c) AS y, c::DOUBLE AS w FROM hist, nb),
ctr AS (SELECT *, x - (SELECT sum(w * x) / sum(w) FROM pts) AS d FROM pts),
mo AS (SELECT (SELECT sum(w * x) / sum(w) FROM pts) AS mx, count(*) AS bins, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * d * d * d) AS s3, sum(w * d * d * d * d) AS s4, sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * d * d * y) AS t2 FROM ctr),
sol AS (SELECT mx, s0, s1, s2, s3, s4, t0, t1, t2, s2 - s1 * s1 / s0 AS a, s3 - s1 * s2 / s0 AS b, s4 - s2 * s2 / s0 AS c, t1 - s1 * t0 / s0 AS e, t2 - s2 * t0 / s0 AS f FROM mo),
coef AS (SELECT *, (f * a - e * b) / (c * a - b * b) AS c2, (e - b * ((f * a - e * b) / (c * a - b * b))) / a AS c1 FROM sol),
fin AS (SELECT *, (t0 - c1 * s1 - c2 * s2) / s0 AS c0 FROM coef),
nul AS (SELECT mx - c1 / (2 * c2) AS mu0, sqrt(-1 / (2 * c2)) AS sigma0, n, zmin,
  least(1.0, exp(c0 - c1 * c1 / (4 * c2) + ln(sqrt(2 * pi()) * sqrt(-1 / (2 * c2)) / (n * 0.05)))) AS p0 FROM fin, qs)"""


@query("null_fit", f"WITH {NULL} SELECT n, {s6('mu0', 'mu0')}, {s6('sigma0', 'sigma0')}, {s6('p0', 'p0')}, 'central' AS method FROM nul")
def null_fit(spark, sf):
    f = N.fit_null(z_grid(spark, sf), "v", "pop")
    return f.select("n", r6("mu0").alias("mu0"), r6("sigma0").alias("sigma0"), r6("p0").alias("p0"), "method")


CURVE = NULL + """,
base AS (SELECT *, least(zmin, mu0 - 8 * sigma0) - 0.05 AS clo FROM nul), bn AS (SELECT *, CAST(ceil((mu0 + 0.05 - clo) / 0.05) AS INTEGER) - 1 AS nbins FROM base),
ch AS (SELECT least(CAST(floor((v - clo) / 0.05) AS INTEGER), nbins - 1) AS b, count(*) AS c FROM u, bn WHERE (v - clo) / 0.05 BETWEEN 0 AND nbins GROUP BY 1),
fr AS (SELECT CAST(i AS INTEGER) AS b, coalesce(c, 0) AS c FROM (SELECT unnest(generate_series(0, (SELECT nbins FROM bn) - 1)) AS i) g LEFT JOIN ch ON ch.b = i),
kw AS (SELECT CAST(k AS INTEGER) AS k, exp(-0.5 * (k / 2.0) * (k / 2.0)) / (SELECT sum(exp(-0.5 * (j / 2.0) * (j / 2.0))) FROM (SELECT unnest(generate_series(-8, 8)) AS j) q) AS w FROM (SELECT unnest(generate_series(-8, 8)) AS k) q),
sm AS (SELECT a.b, sum(w * s.c) AS f FROM fr a, kw, bn JOIN fr s ON s.b = greatest(0, least(nbins - 1, a.b + k)) GROUP BY a.b),
lf0 AS (SELECT b, clo + (b + 0.5) * 0.05 AS ctr, CASE WHEN f > 0 THEN greatest(0, least(1, n * 0.05 * p0 * exp(-0.5 * ((clo + (b + 0.5) * 0.05 - mu0) / sigma0) ** 2) / (sigma0 * sqrt(2 * pi())) / f)) ELSE 1 END AS r FROM sm, bn),
lf AS (SELECT b, ctr, min(r) OVER (ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lf FROM lf0),
sc AS (SELECT zg.row, zg.col, v, mu0, p0, least(greatest((v - clo - 0.025) / 0.05, 0), nbins - 1) AS pos, nbins FROM zg, bn WHERE v IS NOT NULL),
pr AS (SELECT s.row, s.col, v, p0, CASE WHEN v >= mu0 THEN 0 ELSE 1 - (a.lf + (b.lf - a.lf) * (pos - a.b)) END AS prob FROM sc s JOIN lf a ON a.b = least(CAST(floor(pos) AS INTEGER), nbins - 2) JOIN lf b ON b.b = a.b + 1)"""


@query(
    "lfdr_prob",
    f"""WITH {CURVE}, x AS (SELECT *, least(0.9999, greatest(0.0001, 1 - prob)) AS l, least(0.9999, greatest(0.0001, 1 - p0, 0.01)) AS pi FROM pr)
SELECT row, col, round(prob, 5) + 0.0 AS prob, round(ln((1 - l) / l) - ln(pi / (1 - pi)), 4) + 0.0 AS llr FROM x""",
)
def lfdr_prob(spark, sf):
    g = z_grid(spark, sf)
    null = cut_lineage(N.fit_null(g, "v", "pop"))
    models = cut_lineage(N.lfdr_curves(g, "v", "pop", null))
    out = N.likelihood_ratio(N.loss_probability(g, "v", models, "prob"), "v", models, min_prior=0.01)
    return out.where("v IS NOT NULL").select("row", "col", F.round("prob", 5).alias("prob"), F.round("llr", 4).alias("llr"))


CDF = """(CASE WHEN {u} < 0 THEN 1 ELSE 0 END) + (CASE WHEN {u} < 0 THEN -1 ELSE 1 END) * (1 - exp(-0.5 * {u} * {u}) / sqrt(2 * pi()) * (
  0.319381530 / (1 + 0.2316419 * abs({u})) - 0.356563782 / (1 + 0.2316419 * abs({u})) ** 2 + 1.781477937 / (1 + 0.2316419 * abs({u})) ** 3 - 1.821255978 / (1 + 0.2316419 * abs({u})) ** 4 + 1.330274429 / (1 + 0.2316419 * abs({u})) ** 5))"""


@query(
    "bh_reject",
    f"""WITH {NULL}, p AS (SELECT row, col, {CDF.format(u='((v - mu0) / sigma0)')} AS p FROM zg, nul WHERE v IS NOT NULL),
k AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p), c AS (SELECT max(p) AS cut FROM k WHERE p <= 0.2 * k / n)
SELECT row, col, {s6('p', 'p_value')}, coalesce(p <= cut, FALSE) AS rejected FROM p, c""",
)
def bh_reject(spark, sf):
    g = z_grid(spark, sf)
    out = N.bh_reject(g, "v", N.fit_null(g, "v", "pop"), q=0.2)
    return out.where("v IS NOT NULL").select("row", "col", r6("p_value").alias("p_value"), "rejected")


@query(
    "decide_threshold",
    f"""WITH {YGRID}, m AS (SELECT *, coalesce(lag(forest) OVER (PARTITION BY row, col ORDER BY t), FALSE) AS monitored FROM yg)
SELECT t, row, col, monitored AND z <= -1.5 AS flag FROM m""",
)
def decide_threshold(spark, sf):
    m = K.monitored_flags(years_grid(spark, sf))
    flags, _fits = N.decide_flags(m, "D1", rule={**P.DECIDE, "baseline_z": 1.5})
    return flags.select("t", "row", "col", "flag")


@query(
    "date_fits",
    f"""WITH {YGRID}, m AS (SELECT *, coalesce(lag(forest) OVER (PARTITION BY row, col ORDER BY t), FALSE) AS monitored FROM yg)
SELECT t, count(*) FILTER (monitored) AS n_cells, count(*) FILTER (monitored) < 1000 AS skipped FROM m GROUP BY t""",
)
def date_fits(spark, sf):
    _models, fits = N.date_models(K.monitored_flags(years_grid(spark, sf)), "z", "monitored")
    return fits.select("t", "n_cells", "skipped")


def model_sql(source: str) -> str:
    """Null, local fdr and posterior of every field ``k`` of a table (k, row, col, v), as ``pr`` (k, row, col, prob) and ``nul``."""
    return f"""qs AS (SELECT k, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi, count(*) AS n, min(v) AS zmin FROM {source} GROUP BY k),
nb AS (SELECT *, CAST(ceil((hi + 0.05 - lo) / 0.05) AS INTEGER) - 1 AS nb FROM qs),
hist AS (SELECT k, least(CAST(floor((v - lo) / 0.05) AS INTEGER), nb - 1) AS b, count(*) AS c FROM {source} JOIN nb USING (k) WHERE (v - lo) / 0.05 BETWEEN 0 AND nb GROUP BY 1, 2),
pts AS (SELECT k, lo + (b + 0.5) * 0.05 AS x, ln(c) AS y, c::DOUBLE AS w FROM hist JOIN nb USING (k)), mean AS (SELECT k, sum(w * x) / sum(w) AS mx FROM pts GROUP BY k),
ctr AS (SELECT *, x - mx AS d FROM pts JOIN mean USING (k)),
mo AS (SELECT k, any_value(mx) AS mx, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * d * d * d) AS s3, sum(w * d * d * d * d) AS s4, sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * d * d * y) AS t2 FROM ctr GROUP BY k),
sol AS (SELECT *, s2 - s1 * s1 / s0 AS a, s3 - s1 * s2 / s0 AS b, s4 - s2 * s2 / s0 AS c, t1 - s1 * t0 / s0 AS e, t2 - s2 * t0 / s0 AS f FROM mo),
coef AS (SELECT *, (f * a - e * b) / (c * a - b * b) AS c2, (e - b * ((f * a - e * b) / (c * a - b * b))) / a AS c1 FROM sol), fin AS (SELECT *, (t0 - c1 * s1 - c2 * s2) / s0 AS c0 FROM coef),
nul AS (SELECT k, mx - c1 / (2 * c2) AS mu0, sqrt(-1 / (2 * c2)) AS sigma0, n, zmin, least(1.0, exp(c0 - c1 * c1 / (4 * c2) + ln(sqrt(2 * pi()) * sqrt(-1 / (2 * c2)) / (n * 0.05)))) AS p0 FROM fin JOIN qs USING (k)),
base AS (SELECT *, least(zmin, mu0 - 8 * sigma0) - 0.05 AS clo FROM nul), bn AS (SELECT *, CAST(ceil((mu0 + 0.05 - clo) / 0.05) AS INTEGER) - 1 AS nbins FROM base),
ch AS (SELECT k, least(CAST(floor((v - clo) / 0.05) AS INTEGER), nbins - 1) AS b, count(*) AS c FROM {source} JOIN bn USING (k) WHERE (v - clo) / 0.05 BETWEEN 0 AND nbins GROUP BY 1, 2),
slot AS (SELECT k, CAST(unnest(generate_series(0, nbins - 1)) AS INTEGER) AS b FROM bn), fr AS (SELECT k, b, coalesce(c, 0) AS c FROM slot LEFT JOIN ch USING (k, b)),
kw AS (SELECT CAST(j AS INTEGER) AS j, exp(-0.5 * (j / 2.0) * (j / 2.0)) / (SELECT sum(exp(-0.5 * (i / 2.0) * (i / 2.0))) FROM (SELECT unnest(generate_series(-8, 8)) AS i) q) AS w FROM (SELECT unnest(generate_series(-8, 8)) AS j) q),
sm AS (SELECT a.k, a.b, sum(w * s.c) AS f FROM fr a JOIN bn ON bn.k = a.k CROSS JOIN kw JOIN fr s ON s.k = a.k AND s.b = greatest(0, least(nbins - 1, a.b + j)) GROUP BY a.k, a.b),
lf0 AS (SELECT k, b, CASE WHEN f > 0 THEN greatest(0, least(1, n * 0.05 * p0 * exp(-0.5 * ((clo + (b + 0.5) * 0.05 - mu0) / sigma0) ** 2) / (sigma0 * sqrt(2 * pi())) / f)) ELSE 1 END AS r FROM sm JOIN bn USING (k)),
lf AS (SELECT k, b, min(r) OVER (PARTITION BY k ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lf FROM lf0),
sc AS (SELECT k, row, col, v, mu0, least(greatest((v - clo - 0.025) / 0.05, 0), nbins - 1) AS pos, nbins FROM {source} JOIN bn USING (k)),
pr AS (SELECT s.k, s.row, s.col, CASE WHEN v >= mu0 THEN 0 ELSE 1 - (a.lf + (b.lf - a.lf) * (pos - a.b)) END AS prob FROM sc s JOIN lf a ON a.k = s.k AND a.b = least(CAST(floor(pos) AS INTEGER), nbins - 2) JOIN lf b ON b.k = s.k AND b.b = a.b + 1)"""


def decision_sql(sides: dict[str, int], smooth: bool, p: str, floor: str) -> str:
    """A decision rule as ``dec`` (t, row, col, flag, prob): ``sides`` maps a value beside z to its sign."""
    values = {"z": 1, **sides}
    parts = [YGRID, """m AS (SELECT *, coalesce(lag(forest) OVER w, FALSE) AS monitored, lead(z) OVER w AS nx, (z - lag(z, 2) OVER w) / 1.4::DOUBLE AS bz, (lead(z) OVER w - lag(z) OVER w) / 1.4::DOUBLE AS fz FROM yg WINDOW w AS (PARTITION BY row, col ORDER BY t))"""]
    parts.append(f"cnt AS (SELECT t, {', '.join(f'count(*) FILTER (monitored AND {v} IS NOT NULL) AS n{v}' for v in values)} FROM m GROUP BY t)")
    enough = lambda v: f"n{v} >= 1000" + (" AND nz >= 1000" if v == "nx" else "")
    parts.append(f"m2 AS (SELECT m.*, {', '.join(f'monitored AND {enough(v)} AS ok{v}' for v in values)} FROM m JOIN cnt USING (t))")
    fields = ["SELECT t || ':own' AS k, row, col, z AS v FROM m2 WHERE okz AND z IS NOT NULL"]
    for i, sigma in enumerate(N.sigmas_in_cells(P.GRAIN_M) if smooth else []):
        parts.append(gauss_sql(sigma).replace("ker AS", f"ker{i} AS", 1))
        for v, sign in values.items():
            parts.append(f"x{v}{i} AS (SELECT t, row, col, {sign} * {v} AS x FROM m2 WHERE ok{v} AND {v} IS NOT NULL)")
            parts.append(f"h{v}{i} AS (SELECT t, row, col + i AS col, sum(w * x) AS s, sum(w) AS d FROM x{v}{i}, ker{i} GROUP BY 1, 2, 3)")
            parts.append(f"v{v}{i} AS (SELECT t, row + i AS row, col, sum(w * s) AS s, sum(w * d) AS d FROM h{v}{i}, ker{i} GROUP BY 1, 2, 3)")
            fields.append(f"SELECT t || ':{v}{i}' AS k, row, col, s / d AS v FROM x{v}{i} JOIN v{v}{i} USING (t, row, col)")
    parts.append(f"fld AS ({' UNION ALL '.join(fields)})")
    parts.append(model_sql("fld"))
    best = ", ".join(f"greatest(0, max(prob) FILTER (k LIKE '%:{v}%')) AS p{v}" for v in values) if smooth else "NULL AS pz"
    parts.append(f"bs AS (SELECT CAST(split_part(k, ':', 1) AS INTEGER) AS t, row, col, max(prob) FILTER (k LIKE '%:own') AS own, {best} FROM pr GROUP BY 1, 2, 3)")
    parts.append(f"""dd AS (SELECT m2.t, m2.row, m2.col, okz, own, {p} AS p, {floor} AS floor FROM m2 LEFT JOIN bs ON bs.t = m2.t AND bs.row = m2.row AND bs.col = m2.col LEFT JOIN nul ON nul.k = m2.t || ':own'),
dec AS (SELECT t, row, col, coalesce(okz AND own > floor AND p > 0.5, FALSE) AS flag, CASE WHEN okz THEN round(coalesce(p, 0), 5) + 0.0 END AS prob FROM dd)""")
    return ", ".join(parts)


PRIOR = "least(0.9999, greatest(0.0001, 1 - p0, 0.01))"
RULES = {
    "D2": decision_sql({}, False, "own", "0.5"),
    "D6": decision_sql({"nx": -1}, True, "coalesce(pz, 0) * (1 - coalesce(pnx, 0))", PRIOR),
    "D7s": decision_sql({"bz": 1, "fz": 1}, True, "least(coalesce(pz, 0), CASE WHEN okbz AND bz IS NOT NULL THEN coalesce(pbz, 0) END, CASE WHEN okfz AND fz IS NOT NULL THEN coalesce(pfz, 0) END)", "0.5"),
}


def decided(flags):
    return flags.select("t", "row", "col", "flag", F.round("probability", 5).alias("prob"))


def monitored(spark, sf):
    return K.monitored_flags(years_grid(spark, sf))


@query("decide_posterior", f"WITH {RULES['D2']} SELECT t, row, col, flag, prob FROM dec")
def decide_posterior(spark, sf):
    return decided(N.decide_flags(monitored(spark, sf), "D2")[0])


@query("decide_spatial", f"WITH {RULES['D6']} SELECT t, row, col, flag, prob FROM dec")
def decide_spatial(spark, sf):
    return decided(N.decide_flags(monitored(spark, sf), "D6")[0])


@query("decide_bracketed", f"WITH {RULES['D7s']} SELECT t, row, col, flag, prob FROM dec")
def decide_bracketed(spark, sf):
    m = K.change_layer(monitored(spark, sf), "z").withColumns({"back_z": F.col("back") / 1.4, "forward_z": F.col("forward") / 1.4})
    return decided(N.decide_flags(m, "D7s")[0])


# --- components ------------------------------------------------------------------------
def comp_sql(source: str, name: str = "comp", keys: str = "t") -> str:
    """Component label by repeated reach over the 8 neighbours, for a table (t, row, col)."""
    return f"""{name}_walk AS (
  SELECT {keys}, row, col, row * 2147483648 + col AS lab FROM {source}
  UNION
  SELECT n.{keys}, n.row, n.col, w.lab FROM {name}_walk w, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dr, dc)
  JOIN {source} n ON n.{keys} = w.{keys} AND n.row = w.row + o.dr AND n.col = w.col + o.dc WHERE w.lab < n.row * 2147483648 + n.col),
{name} AS (SELECT {keys}, row, col, min(lab) AS label FROM {name}_walk GROUP BY ALL)"""


FLAGS = "flags AS (SELECT t, row, col FROM yg WHERE z > 1.1)"


def flag_cells(spark, sf):
    return years_grid(spark, sf).where("z > 1.1").select("unit", "t", "row", "col")


@query("components", f"WITH RECURSIVE {YGRID}, {FLAGS}, {comp_sql('flags')} SELECT t, row, col, CAST(label AS BIGINT) AS label FROM comp")
def components(spark, sf):
    return G.label_components(flag_cells(spark, sf), tile=32).select("t", "row", "col", "label")


KEPT = """size AS (SELECT t, label, count(*) AS n_cells FROM comp GROUP BY ALL),
big0 AS (SELECT t, label FROM size WHERE t = 0 AND n_cells >= 6),
cells0 AS (SELECT c.* FROM comp c JOIN big0 USING (t, label)),
kept1 AS (SELECT t, label FROM size WHERE t = 1 AND (n_cells >= 6 OR (n_cells >= 3 AND label IN (SELECT c.label FROM comp c JOIN cells0 e ON c.t = 1 AND abs(c.row - e.row) <= 1 AND abs(c.col - e.col) <= 1)))),
cells1 AS (SELECT c.* FROM comp c JOIN kept1 USING (t, label) UNION ALL SELECT * FROM cells0),
kept2 AS (SELECT t, label FROM size WHERE t = 2 AND (n_cells >= 6 OR (n_cells >= 3 AND label IN (SELECT c.label FROM comp c JOIN cells1 e ON c.t = 2 AND abs(c.row - e.row) <= 1 AND abs(c.col - e.col) <= 1)))),
kept AS (SELECT * FROM big0 UNION ALL SELECT * FROM kept1 UNION ALL SELECT * FROM kept2),
det AS (SELECT c.t, c.row, c.col, c.label, n_cells FROM comp c JOIN kept USING (t, label) JOIN size USING (t, label))"""


@query(
    "mmu_objects",
    f"WITH RECURSIVE {YGRID}, {FLAGS}, {comp_sql('flags')}, {KEPT} SELECT t, row, col, CAST(label AS BIGINT) AS label, n_cells FROM det",
)
def mmu_objects(spark, sf):
    return G.interval_detections(flag_cells(spark, sf), [0, 1, 2], least=6, growth=3).select("t", "row", "col", "label", "n_cells")


OBJ = """first AS (SELECT *, t > min(t) OVER (PARTITION BY row, col) AS earlier FROM det),
objs AS (SELECT f.t, f.label, count(*) AS n_cells, avg(earlier::INT) AS earlier_share, avg(y.chm_cover) AS mean_prob, max(y.chm_cover) AS max_prob, avg(y.z) AS mean_z, avg(f.col + 0.5) AS x, avg(f.row + 0.5) AS y
  FROM first f LEFT JOIN yg y ON y.t = f.t AND y.row = f.row AND y.col = f.col GROUP BY f.t, f.label),
onum AS (SELECT *, row_number() OVER (ORDER BY t, label) AS object_id FROM objs)"""


@query(
    "detection_objects",
    f"""WITH RECURSIVE {YGRID}, {FLAGS}, {comp_sql('flags')}, {KEPT}, {OBJ}
SELECT object_id, CAST(2015 + 3 * t AS INTEGER) AS onset_year, CASE WHEN t > 0 THEN (2012 + 3 * t) || '-' || (2015 + 3 * t) ELSE '2015' END AS interval, n_cells, {s6('n_cells * 0.036864', 'area_ha')}, {s6('earlier_share', 'earlier_share')},
  n_cells < 6 AS growth, {s6('mean_prob', 'mean_prob')}, {s6('max_prob', 'max_prob')}, {s6('mean_z', 'mean_z')}, t < 2 AS follow_up, {s6('x * 19.2', 'x')}, {s6('-y * 19.2', 'y')} FROM onum""",
)
def detection_objects(spark, sf):
    g = years_grid(spark, sf)
    det = G.interval_detections(flag_cells(spark, sf), [0, 1, 2], least=6, growth=3)
    years = g.select("unit", "t", "year").distinct()
    o = G.detection_objects(det, g.withColumn("probability", F.col("chm_cover")), years, growth_below=6)
    return o.select("object_id", "onset_year", "interval", "n_cells", *[r6(c).alias(c) for c in ("area_ha", "earlier_share")], "growth", *[r6(c).alias(c) for c in ("mean_prob", "max_prob", "mean_z")], "follow_up", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "decide_full",
    f"""WITH RECURSIVE {RULES['D2']}, fl AS (SELECT t, row, col FROM dec WHERE flag), {comp_sql('fl')}, {KEPT},
ot AS (SELECT row, col, min(t) AS a FROM fl GROUP BY ALL), om AS (SELECT row, col, min(t) AS a FROM det GROUP BY ALL)
SELECT d.t, d.row, d.col, flag, det.t IS NOT NULL AS detected, prob, coalesce(ot.a, -1) AS onset_index, coalesce(om.a, -1) AS onset_index_mmu FROM dec d
LEFT JOIN det ON det.t = d.t AND det.row = d.row AND det.col = d.col LEFT JOIN ot ON ot.row = d.row AND ot.col = d.col LEFT JOIN om ON om.row = d.row AND om.col = d.col""",
)
def decide_full(spark, sf):
    out, _ = decide(monitored(spark, sf), [0, 1, 2], "D2", least=6, growth=3)
    return out.select("t", "row", "col", "flag", "detected", F.round("probability", 5).alias("prob"), "onset_index", "onset_index_mmu")


@query(
    "onset_objects",
    f"""WITH RECURSIVE {YGRID}, o AS (SELECT row, col, CAST(min(t) AS INTEGER) AS t FROM yg WHERE z > 1.1 GROUP BY row, col), {comp_sql('o')}
SELECT c.t, c.row, c.col, s.n_cells FROM comp c JOIN (SELECT t, label, count(*) AS n_cells FROM comp GROUP BY ALL) s ON s.t = c.t AND s.label = c.label WHERE n_cells >= 4""",
)
def onset_objects(spark, sf):
    g = years_grid(spark, sf).withColumns({"flag": F.col("z") > 1.1, "monitored": F.lit(True)})
    return G.onset_objects(K.onset(g), 4).select("t", "row", "col", "n_cells")


@query(
    "unmatched_patches",
    f"""WITH RECURSIVE {YGRID}, pc AS (SELECT t, row, col, CAST(least(100, greatest(0, round_even(chm_cover * 100, 0))) AS INTEGER) AS pct, forest FROM yg), fl AS (SELECT t, row, col FROM pc WHERE pct >= 78), ob AS (SELECT t, row, col FROM yg WHERE z < -2.2), {comp_sql('fl')},
seen AS (SELECT DISTINCT c.t, c.label FROM comp c, (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS i) b) o JOIN ob ON ob.t = c.t AND ob.row = c.row + dr AND ob.col = c.col + dc)
SELECT c.t, CAST(c.label AS BIGINT) AS label, count(*) AS cells, {s6('avg(pct)', 'mean_percent')}, {s6('avg(forest::INT)', 'forest_share')}, {s6('avg(c.row)', 'row_centre')} FROM comp c JOIN pc ON pc.t = c.t AND pc.row = c.row AND pc.col = c.col
WHERE (c.t, c.label) NOT IN (SELECT (t, label) FROM seen) GROUP BY c.t, c.label HAVING count(*) >= 3""",
)
def unmatched_patches(spark, sf):
    from sylvaflow.functions.scalars import to_percent

    g = years_grid(spark, sf)
    pct = g.select("unit", "t", "row", "col", to_percent(F.col("chm_cover")).alias("percent"), "forest")
    u = G.unmatched_patches(pct, g.where("z < -2.2"), K.DATE, cut=78, least=3)
    return u.select("t", "label", "cells", *[r6(c).alias(c) for c in ("mean_percent", "forest_share", "row_centre")])


OTHERS = f"""l AS (SELECT *, coalesce(lag(forest) OVER w, FALSE) AS f0, coalesce(lag(forest) OVER w AND NOT forest AND lag(chm_cover) OVER w - chm_cover >= 0.5, FALSE) AS lost FROM yg WINDOW w AS (PARTITION BY row, col ORDER BY t)),
near AS (SELECT DISTINCT t, row + dr AS row, col + dc AS col FROM yg, (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS i) b) o WHERE z < -2.6),
fl AS (SELECT l.t, l.row, l.col FROM l LEFT JOIN near n ON n.t = l.t AND n.row = l.row AND n.col = l.col WHERE f0 AND (z / 5 >= 0.2 OR lost) AND n.t IS NULL), {comp_sql('fl', 'oth')},
oc AS (SELECT c.t, CAST(c.label AS BIGINT) AS label, CASE WHEN avg(lost::INT) >= 0.5 THEN 'chm' ELSE 'weak' END AS source, count(*) AS n_cells, avg(z / 5) AS mean_prob FROM oth c JOIN l ON l.t = c.t AND l.row = c.row AND l.col = c.col GROUP BY c.t, c.label HAVING count(*) >= 9)"""


@query("other_candidates", f"WITH RECURSIVE {YGRID}, {OTHERS} SELECT t, label, source, n_cells, {s6('n_cells * 0.036864', 'area_ha')}, {s6('mean_prob', 'mean_prob')} FROM oc")
def other_candidates(spark, sf):
    g = years_grid(spark, sf).withColumn("probability", F.col("z") / 5)
    o = G.other_candidates(g, g.where("z < -2.6"), rule={**P.CANDIDATES, "chm_loss_min_drop": 0.5})
    return o.select("t", "label", "source", "n_cells", r6("area_ha").alias("area_ha"), r6("mean_prob").alias("mean_prob"))


@query("cluster_probability")
def cluster_probability(spark, sf):
    g = z_grid(spark, sf)
    null = cut_lineage(N.fit_null(g, "v", "pop"))
    models = cut_lineage(N.lfdr_curves(g, "v", "pop", null))
    m = g.join(null.select(*K.DATE, F.col("mu0").alias("_m")), K.DATE).withColumn("mirror", 2 * F.col("_m") - F.col("v")).drop("_m")
    m = N.loss_probability(N.loss_probability(m, "v", models, "p"), "mirror", models, "pm")
    m = m.withColumns({"loss": K.holds(F.col("pop") & (F.col("p") > 0.05)), "gain": K.holds(F.col("pop") & (F.col("pm") > 0.05))})
    m = cut_lineage(m)
    c = G.cluster_probability(m, "v", null, "loss", "gain")
    return c.select("label", "n_cells", r6("mass").alias("mass"), r6("probability").alias("probability"))


@query(
    "hole_filling",
    f"""WITH RECURSIVE {ZGRID}, a AS (SELECT 0 AS t, row, col, coalesce(v > -0.6, FALSE) AS f FROM zg), b AS (SELECT t, row, col FROM a WHERE NOT f),
w AS (SELECT row, col, row * 2147483648 + col AS lab FROM b UNION SELECT n.row, n.col, w.lab FROM w, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc) JOIN b n ON n.row = w.row + o.dr AND n.col = w.col + o.dc WHERE w.lab < n.row * 2147483648 + n.col),
l AS (SELECT row, col, min(lab) AS label FROM w GROUP BY ALL), s AS (SELECT label FROM l GROUP BY label HAVING count(*) <= 2)
SELECT a.row, a.col, a.f OR l.label IN (SELECT label FROM s) AS filled FROM a LEFT JOIN l ON l.row = a.row AND l.col = a.col""",
)
def hole_filling(spark, sf):
    g = z_grid(spark, sf)
    on = G.fill_holes(g.where("v > -0.6"), g, 2).withColumn("filled", F.lit(True))
    return g.join(on, [*K.DATE, "row", "col"], "left").select("row", "col", F.coalesce("filled", F.lit(False)).alias("filled"))


@query("refined_loss")
def refined_loss(spark, sf):
    g = years_grid(spark, sf)
    # patches of 6 x 6 cells share one height, so that openings have a size
    blk = (F.floor(F.col("row") / 6) * 7 + F.floor(F.col("col") / 6) * 3) % 5
    px = g.select("unit", "t", "row", "col", F.lit(15.0).alias("h0"), F.when(blk == 0, 1.0).otherwise(14.0).alias("h1"))
    seed = px.where("h1 < 5 AND row % 12 < 6")
    openings, env, stats = G.refine(px, seed, K.DATE, 0.6, open_radius_m=0.6, min_opening_m2=3.0, close_radius_m=1.2, fill_holes_m2=2.0, min_envelope_m2=5.0)
    return stats.select("t", *[r6(c).alias(c) for c in ("envelope_ha", "openings_ha", "opening_share", "canopy0_share", "iou_seed")], "n_openings")
