"""Queries on cells: blocks, change, moving windows, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import r6
from sylvaflow.operators import cells as K
from sylvaflow.operators import zones as Z
from sylvaflow.operators.ranks import robust_stats
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.stand_ins import GRID, GRID_YEARS, SPARSE, grid, grid_years, sparse_cells, table
from sylvaflow.session import cut_lineage


def z_grid(spark, sf):
    """The dense grid as one date; vector elements scale to about unit variance."""
    v = F.when((F.col("row") + F.col("col")) % 97 == 0, None).otherwise(F.col("value") * 8)
    return grid(spark, sf).select(F.lit("g").alias("unit"), F.lit(0).alias("t"), "row", "col", v.alias("v"), ((F.col("row") + F.col("col")) % 11 != 0).alias("pop"))


ZGRID = GRID + """,
zg AS (SELECT row, col, CASE WHEN (row + col) % 97 = 0 THEN NULL ELSE value * 8 END AS v, (row + col) % 11 <> 0 AS pop FROM cells)"""


def years_grid(spark, sf):
    """Height, cover and forest at three dates from the shifted grids."""
    g = grid_years(spark, sf)
    h = F.greatest(F.lit(0.0), (F.col("value") + 0.25) * 40)
    return g.select("unit", "t", (2015 + 3 * F.col("t")).alias("year"), "row", "col", h.alias("chm_height"), (h / 20).alias("chm_cover"), (h > 9).alias("forest"), (F.col("value") * 8).alias("z"))


YGRID = GRID_YEARS + """,
yg AS (SELECT unit, t, CAST(2015 + 3 * t AS INTEGER) AS year, row, col, greatest(0, (value + 0.25) * 40) AS chm_height,
       greatest(0, (value + 0.25) * 40) / 20 AS chm_cover, greatest(0, (value + 0.25) * 40) > 9 AS forest, value * 8 AS z FROM dated)"""


@query(
    "block_cells",
    f"""WITH px AS (SELECT l_returnflag AS unit, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_orderkey % 64 AS INTEGER) AS row, CAST(l_partkey % 64 AS INTEGER) AS col,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE (l_quantity - 1.0) / 2.0 END AS height, l_tax * 100 AS red, l_extendedprice % 90 AS nir FROM lineitem),
b AS (SELECT unit, year, row // 4 AS row, col // 4 AS col, count(height) AS n, avg(height) AS h, avg(CASE WHEN height > 5 THEN 1.0 WHEN height IS NOT NULL THEN 0.0 END) AS c,
  count(CASE WHEN nir + red > 0 THEN 1 END) AS nn, avg(CASE WHEN nir + red > 0 THEN (nir - red) / greatest(nir + red, 1) END) AS ndvi FROM px GROUP BY ALL)
SELECT unit, year, row, col, {s6('CASE WHEN n / 16.0 >= 0.5 THEN h END', 'chm_height')}, {s6('CASE WHEN n / 16.0 >= 0.5 THEN c END', 'chm_cover')}, {s6('n / 16.0', 'valid_share')}, {s6('CASE WHEN nn / 16.0 >= 0.5 THEN ndvi END', 'ndvi')} FROM b""",
)
def block_cells(spark, sf):
    line = table(spark, sf, "lineitem")
    px = line.select(
        F.col("l_returnflag").alias("unit"), F.year("l_shipdate").alias("year"), (F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"),
        F.when(F.col("l_suppkey") % 9 != 0, (F.col("l_quantity") - 1.0) / 2.0).alias("height"), (F.col("l_tax") * 100).alias("red"), (F.col("l_extendedprice") % 90).alias("nir"),
    )
    b = K.block_aggregate(px, 4, bands=True)
    return b.select("unit", "year", "row", "col", *[r6(c).alias(c) for c in ("chm_height", "chm_cover", "valid_share", "ndvi")])


@query(
    "band_mean_ndvi",
    f"""WITH px AS (SELECT l_returnflag AS unit, CAST(year(l_shipdate) AS INTEGER) AS t, CAST(l_orderkey % 64 AS INTEGER) AS row, CAST(l_partkey % 64 AS INTEGER) AS col, l_linenumber % 3 * 20 AS red, l_suppkey % 5 * 30 AS nir FROM lineitem),
c AS (SELECT unit, t, row // 8 AS row, col // 8 AS col, count(*) FILTER (red <> 0 OR nir <> 0) AS n, sum(red) AS r, sum(nir) AS i FROM px GROUP BY ALL),
v AS (SELECT unit, t, row, col, CASE WHEN n >= 32 AND r + i > 0 THEN (i - r) / (i + r)::DOUBLE END AS ndvi FROM c),
g AS (SELECT unit, row, col FROM v GROUP BY ALL HAVING bool_and(ndvi IS NOT NULL) AND max(ndvi) < 0.6)
SELECT unit, t, row, col, {s6('ndvi', 'ndvi')}, (unit, row, col) IN (SELECT (unit, row, col) FROM g) AS never_green FROM v""",
)
def band_mean_ndvi(spark, sf):
    line = table(spark, sf, "lineitem")
    px = line.select(
        F.col("l_returnflag").alias("unit"), F.year("l_shipdate").alias("t"), (F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"),
        (F.col("l_linenumber") % 3 * 20).alias("red"), (F.col("l_suppkey") % 5 * 30).alias("nir"), F.lit(0).alias("other"),
    )
    v = K.band_mean_ndvi(px, 8, ["unit", "t"])
    low = K.never_green(v, 0.6).withColumn("never_green", F.lit(True))
    return v.join(low, K.CELL, "left").select("unit", "t", "row", "col", r6("ndvi").alias("ndvi"), F.coalesce("never_green", F.lit(False)).alias("never_green"))


@query(
    "pool_labels",
    """WITH px AS (SELECT l_returnflag AS unit, CAST(year(l_shipdate) AS INTEGER) AS k, CAST(l_orderkey % 64 // 4 AS INTEGER) AS row, CAST(l_partkey % 64 // 4 AS INTEGER) AS col,
  CASE WHEN l_quantity <= 10 THEN 255 WHEN l_quantity <= 30 THEN 0 WHEN l_quantity <= 41 THEN 1 ELSE 2 END AS change, CASE WHEN l_suppkey % 4 = 0 THEN 255 ELSE l_suppkey % 6 + 1 END AS agent FROM lineitem),
s AS (SELECT unit, k, row, col, avg(CASE WHEN change = 255 THEN 1.0 ELSE 0.0 END) AS i, count(*) FILTER (change = 1) AS p, count(*) FILTER (change = 2) AS f, count(*) FILTER (change < 3) AS l FROM px GROUP BY ALL),
m AS (SELECT unit, k, row, col, agent FROM (SELECT unit, k, row, col, agent, count(*) AS n FROM px WHERE agent <> 255 GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY unit, k, row, col ORDER BY n DESC, agent) = 1),
o AS (SELECT s.*, agent, CASE WHEN i < 0.5 AND l > 0 AND (p + f) / l::DOUBLE >= 0.5 THEN CASE WHEN f >= p THEN 2 ELSE 1 END WHEN i < 0.5 AND l > 0 AND (p + f) / l::DOUBLE <= 0.1 THEN 0 ELSE 255 END AS pooled FROM s LEFT JOIN m USING (unit, k, row, col))
SELECT unit, k, row, col, pooled, CASE WHEN pooled IN (1, 2) THEN coalesce(agent, 255) ELSE 255 END AS agent FROM o""",
)
def pool_labels(spark, sf):
    q = F.col("l_quantity")
    px = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("unit"), F.year("l_shipdate").alias("k"), F.floor(F.col("l_orderkey") % 64 / 4).cast("int").alias("row"), F.floor(F.col("l_partkey") % 64 / 4).cast("int").alias("col"),
        F.when(q <= 10, 255).when(q <= 30, 0).when(q <= 41, 1).otherwise(2).alias("change"), F.when(F.col("l_suppkey") % 4 == 0, 255).otherwise(F.col("l_suppkey") % 6 + 1).alias("agent"),
    )
    return K.pool_labels(px, ["unit", "k", "row", "col"])


@query(
    "forest_dips",
    f"""WITH {SPARSE}, f AS (SELECT unit, row, col, dense_rank() OVER (PARTITION BY unit ORDER BY year) - 1 AS t, chm_cover >= 0.5 AS f0 FROM sparse),
d AS (SELECT *, f0 OR (coalesce(lag(f0) OVER w, FALSE) AND coalesce(lead(f0) OVER w, FALSE)) AS forest FROM f WINDOW w AS (PARTITION BY unit, row, col ORDER BY t))
SELECT unit, row, col, t, f0 AS raw, forest, coalesce(lag(forest) OVER w, FALSE) AS monitored, CASE WHEN t = 0 THEN forest ELSE coalesce(lag(forest) OVER w, FALSE) END AS population FROM d WINDOW w AS (PARTITION BY unit, row, col ORDER BY t)""",
)
def forest_dips(spark, sf):
    f = K.date_index(sparse_cells(spark, sf)).withColumns({"forest": K.forest_flag(F.col("chm_cover")), "raw": K.forest_flag(F.col("chm_cover"))})
    return K.monitored_flags(K.fill_dips(f)).select("unit", "row", "col", "t", "raw", "forest", "monitored", "population")


@query(
    "unstable_intervals",
    f"""WITH {SPARSE}, a AS (SELECT unit, dense_rank() OVER (PARTITION BY unit ORDER BY year) - 1 AS t, chm_cover >= 0.5 AS f FROM sparse), s AS (SELECT unit, t, count(*) FILTER (f) AS area FROM a GROUP BY ALL),
l AS (SELECT *, lag(area) OVER (PARTITION BY unit ORDER BY t) AS b FROM s)
SELECT unit, t - 1 AS k, area, CASE WHEN b > 0 THEN abs(area - b) / b::DOUBLE ELSE 1 END > 0.15 AS unstable FROM l WHERE b IS NOT NULL""",
)
def unstable_intervals(spark, sf):
    return K.unstable_intervals(K.date_index(sparse_cells(spark, sf)).withColumn("forest", K.forest_flag(F.col("chm_cover"))))


@query(
    "forest_masks",
    f"""WITH {SPARSE}, v AS (SELECT *, CASE WHEN row % 13 = 0 THEN 255 ELSE (chm_cover >= 0.5)::INT END AS a, CASE WHEN col % 11 = 0 THEN 255 ELSE (probability > 0.5)::INT END AS b FROM sparse),
m AS (SELECT unit, row, col, CASE WHEN a = 255 OR b = 255 THEN 255 WHEN a = 1 OR b = 1 THEN 1 ELSE 0 END AS mask FROM v)
SELECT unit, row, col, CASE WHEN bool_or(mask = 255) THEN 255 ELSE bool_and(mask = 1)::INT END AS stable, count(*) FILTER (mask = 1) AS n_forest_years FROM m GROUP BY ALL""",
)
def forest_masks(spark, sf):
    a = K.coded_mask(F.when(F.col("row") % 13 != 0, F.col("chm_cover")), 0.5)
    b = K.coded_mask(F.when(F.col("col") % 11 != 0, F.col("probability")), 0.5, strict=True)
    return K.stable_forest(sparse_cells(spark, sf).select(*K.CELL, K.combine_masks(a, b, "or").alias("mask")))


@query(
    "ndvi_forest_mask",
    f"""WITH {ZGRID}, r AS (SELECT v FROM zg WHERE v IS NOT NULL AND row % 2 = 0), s AS (SELECT median(v) AS m FROM r), d AS (SELECT 1.4826 * median(abs(v - m)) AS sc FROM r, s)
SELECT row, col, CASE WHEN v IS NULL THEN 255 ELSE ((v - m) / sc > 0.3)::INT END AS mask FROM zg, s, d""",
)
def ndvi_forest_mask(spark, sf):
    g = z_grid(spark, sf)
    stats = K.reference_stats(g.where("v IS NOT NULL AND row % 2 = 0"), ["unit"], "v", K.Z_WIDTH)
    df = g.join(stats, "unit")
    return df.select("row", "col", K.coded_mask((F.col("v") - F.col("median")) / F.col("scale"), 0.3, strict=True).alias("mask"))


@query(
    "cell_change_brackets",
    f"""WITH {YGRID} SELECT t, row, col, {s6('chm_height - lag(chm_height, 1) OVER w', 'change')}, {s6('chm_height - lag(chm_height, 2) OVER w', 'back')}, {s6('lead(chm_height, 1) OVER w - lag(chm_height, 1) OVER w', 'forward')}
FROM yg WINDOW w AS (PARTITION BY row, col ORDER BY t)""",
)
def cell_change_brackets(spark, sf):
    return K.change_layer(years_grid(spark, sf), "chm_height").select("t", "row", "col", *[r6(c).alias(c) for c in ("change", "back", "forward")])


@query(
    "onset",
    f"""WITH {YGRID}, f AS (SELECT *, z < -1.2 AS flag, coalesce(lag(forest) OVER (PARTITION BY row, col ORDER BY t), FALSE) AS monitored FROM yg)
SELECT row, col, coalesce(min(t) FILTER (flag AND monitored), -1) AS onset_index,
  CASE WHEN count(*) FILTER (flag AND monitored) > 0 THEN arg_min(year, t) FILTER (flag AND monitored) WHEN bool_or(monitored AND t > 0) THEN 0 ELSE -1 END AS onset_year FROM f GROUP BY row, col""",
)
def onset(spark, sf):
    m = K.monitored_flags(years_grid(spark, sf))
    return K.onset(m.withColumn("flag", F.col("monitored") & (F.col("z") < -1.2))).select("row", "col", "onset_index", "onset_year")


@query(
    "history_z",
    f"""WITH {YGRID}, h AS (SELECT *, count(x) OVER w AS n, avg(x) OVER w AS m, greatest(0, var_samp(x) OVER w) AS v FROM (SELECT *, CASE WHEN forest THEN z END AS x FROM yg) q WINDOW w AS (PARTITION BY row, col ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT t, median(v) AS s0 FROM h WHERE forest AND n >= 2 GROUP BY t HAVING count(*) >= 200),
a AS (SELECT h.*, CASE WHEN n >= 1 THEN z - m END AS a1, CASE WHEN n >= 2 THEN (z - m) / sqrt(((n - 1) * v + 2 * s0) / (n - 1 + 2)) END AS a2 FROM h LEFT JOIN s ON s.t = h.t),
c1 AS (SELECT t, median(a1) AS c FROM a WHERE forest AND a1 IS NOT NULL GROUP BY t HAVING count(*) >= 200), k1 AS (SELECT a.t, any_value(c) AS c, 1.4826 * median(abs(a1 - c)) AS k FROM a JOIN c1 ON a.t = c1.t WHERE forest GROUP BY a.t),
c2 AS (SELECT t, median(a2) AS c FROM a WHERE forest AND a2 IS NOT NULL GROUP BY t HAVING count(*) >= 200), k2 AS (SELECT a.t, any_value(c) AS c, 1.4826 * median(abs(a2 - c)) AS k FROM a JOIN c2 ON a.t = c2.t WHERE forest GROUP BY a.t)
SELECT a.t, row, col, n AS hist_n, {s6('(a1 - k1.c) / k1.k', 'pixmean')}, {s6('(a2 - k2.c) / k2.k', 'pixz')} FROM a LEFT JOIN k1 ON k1.t = a.t LEFT JOIN k2 ON k2.t = a.t""",
)
def history_z(spark, sf):
    g = years_grid(spark, sf)
    a = K.history_z(g.withColumn("x", F.col("z")), "x", "forest", "pixmean").select(*K.DATE, "row", "col", F.col("z").alias("pixmean"))
    b = K.history_z(g.withColumn("x", F.col("z")), "x", "forest", "pixz").select(*K.DATE, "row", "col", F.col("z").alias("pixz"))
    n = K.history(g, "z", "forest").select(*K.DATE, "row", "col", "hist_n")
    out = n.join(a, [*K.DATE, "row", "col"]).join(b, [*K.DATE, "row", "col"])
    return out.select("t", "row", "col", "hist_n", r6("pixmean").alias("pixmean"), r6("pixz").alias("pixz"))


# Three dates, so the oracle unrolls the recursion date by date.
@query(
    "accumulate",
    f"""WITH {YGRID}, c AS (SELECT row, col, max(z) FILTER (t = 0) AS a, max(z) FILTER (t = 1) AS b, max(z) FILTER (t = 2) AS d, coalesce(bool_or(row % 3 <> 0) FILTER (t = 0), FALSE) AS m0,
  coalesce(bool_or(row % 5 <> 0) FILTER (t = 1), FALSE) AS m1, coalesce(bool_or(row % 7 <> 0) FILTER (t = 2), FALSE) AS m2 FROM yg GROUP BY row, col HAVING count(*) = 3),
s0 AS (SELECT *, a AS x0, 0 AS st0 FROM c),
s1 AS (SELECT *, greatest(0, 0.8 * x0) + b AS x1, CASE WHEN 0.8 * x0 <= 0 THEN 1 ELSE st0 END AS st1 FROM s0),
s2 AS (SELECT *, greatest(0, 0.8 * x1) + d AS x2, CASE WHEN 0.8 * x1 <= 0 THEN 2 ELSE st1 END AS st2 FROM s1),
p AS (SELECT *, 1 / (1 + exp(-(ln(0.05 / 0.95) + x0))) AS p0, 1 / (1 + exp(-(ln(0.05 / 0.95) + x1))) AS p1, 1 / (1 + exp(-(ln(0.05 / 0.95) + x2))) AS p2 FROM s2)
SELECT row, col, {s6('p2', 'last_prob')}, CASE WHEN x2 > 0 THEN st2 ELSE -1 END AS last_onset,
  CASE WHEN x0 > 0 AND m0 AND p0 > 0.2 THEN 0 WHEN x1 > 0 AND [m0, m1, m2][st1 + 1] AND p1 > 0.2 THEN st1 WHEN x2 > 0 AND [m0, m1, m2][st2 + 1] AND p2 > 0.2 THEN st2 ELSE -1 END AS first_onset,
  {s6('1 / (1 + exp(-(ln(0.05 / 0.95) + a + b)))', 'confirmed')} FROM p""",
)
def accumulate(spark, sf):
    t, row = F.col("t"), F.col("row")
    on = F.when(t == 0, row % 3 != 0).when(t == 1, row % 5 != 0).otherwise(row % 7 != 0)
    g = years_grid(spark, sf).select(*K.DATE, "row", "col", F.col("z").alias("llr"), on.alias("monitored"))
    runs = K.accumulate(g, 0.05, decay=0.8)
    first = K.first_accumulated(runs, 0.2)
    nxt = K.confirm_next(g, 0.05).where("t = 0").select(*K.CELL, "confirmed")
    out = runs.where(F.size("prob") == 3).join(first, K.CELL).join(nxt, K.CELL)
    return out.select("row", "col", r6(F.get("prob", F.lit(2))).alias("last_prob"), F.get("onset", F.lit(2)).alias("last_onset"), "first_onset", r6("confirmed").alias("confirmed"))


STATS = """st AS (SELECT median(v) AS centre FROM zg WHERE pop), sc AS (SELECT centre, 1.4826 * (SELECT median(abs(v - centre)) FROM zg WHERE pop) AS scale FROM st)"""


@query(
    "population_stats",
    f"WITH {ZGRID}, {STATS} SELECT (SELECT count(v) FROM zg WHERE pop) AS n, {s6('centre', 'centre')}, {s6('scale', 'scale')} FROM sc",
)
def population_stats(spark, sf):
    s = robust_stats(z_grid(spark, sf).where("pop"), K.DATE, "v", K.Z_WIDTH, min_rows=200, scale=P.MAD_SCALE)
    return s.select("n", r6("centre").alias("centre"), r6("scale").alias("scale"))


@query(
    "scene_z",
    f"WITH {ZGRID}, {STATS}, m AS (SELECT avg(v) AS a, stddev_pop(v) AS b FROM zg WHERE pop) SELECT row, col, {s6('(v - centre) / scale', 'robust')}, {s6('(v - a) / b', 'plain')}, {s6('((v - centre) / scale + 2 * (v - a) / b) / sqrt(5)', 'combined')} FROM zg, sc, m",
)
def scene_z(spark, sf):
    g = K.scene_z(K.scene_z(z_grid(spark, sf), "v", "pop", out="robust"), "v", "pop", robust=False, out="plain")
    return g.select("row", "col", r6("robust").alias("robust"), r6("plain").alias("plain"), r6(K.stouffer([F.col("robust"), F.col("plain")], [1.0, 2.0])).alias("combined"))


@query(
    "local_z",
    f"""WITH {ZGRID}, {STATS}, u AS (SELECT row, col, v, CASE WHEN pop AND abs((v - centre) / scale) <= 3 THEN v END AS x FROM zg, sc),
o AS (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest(generate_series(-3, 3)) AS i) a, (SELECT unnest(generate_series(-3, 3)) AS i) b),
g AS (SELECT row + dr AS row, col + dc AS col, count(x) AS n, coalesce(sum(x), 0) AS s, coalesce(sum(x * x), 0) AS q FROM u, o GROUP BY 1, 2),
w AS (SELECT u.row, u.col, u.v, g.n, g.s, g.q FROM u JOIN g ON g.row = u.row AND g.col = u.col),
m AS (SELECT w.*, s / nullif(n, 0) AS mean, greatest(sqrt(greatest(q / nullif(n, 0) - (s / nullif(n, 0)) * (s / nullif(n, 0)), 0)), 0.25 * scale) AS sd, n / 49.0 < 0.2 AS thin, centre, scale FROM w, sc)
SELECT row, col, {s6('(v - CASE WHEN thin THEN centre ELSE mean END) / CASE WHEN thin THEN scale ELSE sd END', 'z')} FROM m""",
)
def local_z(spark, sf):
    return K.local_z(z_grid(spark, sf), "v", "pop", 7).select("row", "col", r6("z").alias("z"))


def gauss_sql(sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    return f"""ker AS (SELECT i, exp(-0.5 * (i / {sigma}) * (i / {sigma})) / (SELECT sum(exp(-0.5 * (j / {sigma}) * (j / {sigma}))) FROM (SELECT unnest(generate_series(-{r}, {r})) AS j) q) AS w FROM (SELECT unnest(generate_series(-{r}, {r})) AS i) q)"""


@query(
    "smooth_z",
    f"""WITH {ZGRID}, {gauss_sql(1.3)}, u AS (SELECT row, col, CASE WHEN pop THEN v END AS x FROM zg),
h AS (SELECT a.row, a.col + k.i AS col, sum(k.w * a.x) AS s, sum(k.w) AS d FROM u a, ker k WHERE a.x IS NOT NULL GROUP BY 1, 2),
v AS (SELECT h.row + k.i AS row, h.col, sum(k.w * s) AS s, sum(k.w * d) AS d FROM h, ker k GROUP BY 1, 2)
SELECT u.row, u.col, {s6('CASE WHEN u.x IS NOT NULL THEN v.s / v.d END', 'z')} FROM u LEFT JOIN v ON v.row = u.row AND v.col = u.col""",
)
def smooth_z(spark, sf):
    return K.smooth_z(z_grid(spark, sf), "v", "pop", 1.3, "z").select("row", "col", r6("z").alias("z"))


@query(
    "residual_z",
    f"""WITH {YGRID}, g AS (SELECT row, col, max(z) FILTER (t = 0) AS pre, max(z) FILTER (t = 1) AS post, bool_or(row % 4 <> 0) AS ref FROM yg GROUP BY row, col),
e AS (SELECT quantile_cont(pre, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM g WHERE ref AND pre IS NOT NULL AND post IS NOT NULL),
b AS (SELECT g.*, CASE WHEN pre IS NOT NULL THEN len(list_filter(q, lambda x: pre >= x)) END AS bin FROM g, e),
m AS (SELECT bin, median(post) AS med FROM b WHERE ref AND bin IS NOT NULL AND post IS NOT NULL GROUP BY bin HAVING count(*) >= 5),
d AS (SELECT b.bin, any_value(med) AS med, median(abs(post - med)) * 1.4826 + 0.0001 AS sp FROM b JOIN m ON b.bin = m.bin WHERE ref AND post IS NOT NULL GROUP BY b.bin)
SELECT row, col, {s6('(post - med) / sp', 'z')} FROM b LEFT JOIN d ON d.bin = b.bin""",
)
def residual_z(spark, sf):
    g = years_grid(spark, sf).groupBy("unit", "row", "col").agg(F.max(F.when(F.col("t") == 0, F.col("z"))).alias("pre"), F.max(F.when(F.col("t") == 1, F.col("z"))).alias("post"))
    g = g.withColumns({"k": F.lit(0), "reference": F.col("row") % 4 != 0})
    return K.residual_z(g).select("row", "col", r6("z").alias("z"))


@query(
    "otsu_threshold",
    f"""WITH {ZGRID}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM zg), h AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 256) AS INTEGER), 255) AS b, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM zg, s WHERE v IS NOT NULL GROUP BY 1),
c AS (SELECT b, n, lo + (b + 0.5) * (hi - lo) / 256 AS c FROM h),
w AS (SELECT b, c, sum(n) OVER l AS w1, sum(n * c) OVER l AS m1, sum(n) OVER u AS w2, sum(n * c) OVER u AS m2 FROM c WINDOW l AS (ORDER BY b), u AS (ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT {s6('arg_max(c, round(CAST(w1 AS DOUBLE) * w2 * (m1 / w1 - m2 / w2) * (m1 / w1 - m2 / w2), 6))', 'threshold')} FROM w WHERE w2 IS NOT NULL""",
)
def otsu_threshold(spark, sf):
    return K.otsu_threshold(z_grid(spark, sf), ["unit"], "v").select(r6("threshold").alias("threshold"))


@query(
    "within_distance",
    f"""WITH {ZGRID}, s AS (SELECT row, col FROM zg WHERE v > 2.2),
d AS (SELECT z.row, z.col, min((z.row - s.row) * (z.row - s.row) + (z.col - s.col) * (z.col - s.col)) AS q FROM zg z, s GROUP BY 1, 2)
SELECT z.row, z.col, {s6('sqrt(q)', 'distance')}, coalesce(q <= 6.25, FALSE) AS near FROM zg z LEFT JOIN d ON d.row = z.row AND d.col = z.col""",
)
def within_distance(spark, sf):
    g = z_grid(spark, sf)
    dist = K.distance_to(g, K.holds(F.col("v") > 2.2))
    near = K.within(g, g.where("v > 2.2"), 2.5).select(*K.DATE, "row", "col", F.lit(True).alias("near"))
    return dist.join(near, [*K.DATE, "row", "col"], "left").select("row", "col", r6("distance").alias("distance"), F.coalesce("near", F.lit(False)).alias("near"))


def tiles(spark, sf, size: int):
    g = z_grid(spark, sf)
    return g.select("*", F.floor(F.col("row") / size).cast("int").alias("wr"), F.floor(F.col("col") / size).cast("int").alias("wc"))


TILES16 = ZGRID + ", tz AS (SELECT *, row // 16 AS wr, col // 16 AS wc, coalesce(v >= 0.3, FALSE) AS canopy FROM zg)"


@query(
    "edge_density",
    f"""WITH {TILES16}, e AS (SELECT a.wr, a.wc, a.row, a.col, bool_or(abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.canopy <> b.canopy) AS edge, count(*) = 9 AS inner_cell
  FROM tz a JOIN tz b ON a.wr = b.wr AND a.wc = b.wc AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL)
SELECT wr, wc, {s6('count(*) FILTER (edge) * 0.6 / (count(*) * 0.36)', 'all_edges')}, {s6('count(*) FILTER (edge AND inner_cell) * 0.6 / (count(*) * 0.36)', 'inner_edges')} FROM e GROUP BY wr, wc""",
)
def edge_density(spark, sf):
    t = tiles(spark, sf, 16).withColumn("canopy", K.holds(F.col("v") >= 0.3))
    zone = ["wr", "wc"]
    a = K.edge_density(t, "canopy", zone, 0.6, inner=False).withColumnRenamed("edge_density", "all_edges")
    b = K.edge_density(t, "canopy", zone, 0.6).withColumnRenamed("edge_density", "inner_edges")
    return a.join(b, zone).select(*zone, r6("all_edges").alias("all_edges"), r6("inner_edges").alias("inner_edges"))


@query(
    "line_index",
    f"""WITH {TILES16}, e AS (SELECT a.wr, a.wc, a.row % 16 AS y, a.col % 16 AS x FROM tz a JOIN tz b ON a.wr = b.wr AND a.wc = b.wc AND abs(a.row - b.row) + abs(a.col - b.col) = 1 WHERE a.canopy <> b.canopy GROUP BY ALL),
h AS (SELECT wr, wc, a, round(round(cos(a * pi() / 90 - pi() / 2), 12) * x + round(sin(a * pi() / 90 - pi() / 2), 12) * y) AS rho, count(*) AS n FROM e, (SELECT unnest(generate_series(0, 89)) AS a) g GROUP BY ALL)
SELECT wr, wc, {s6('1 - avg(n) / max(n)', 'linearity_index')} FROM h GROUP BY wr, wc""",
)
def line_index(spark, sf):
    parts = max(1, table(spark, sf, "embeddings").count() >> 11)  # dealt by tile once, as many tiles to a task at any size
    t = tiles(spark, sf, 16).withColumn("canopy", K.holds(F.col("v") >= 0.3)).repartition(parts, "wr", "wc")
    e = K.edge_cells(t, "canopy", ["wr", "wc"]).where("edge").select("wr", "wc", (F.col("col") % 16).alias("x"), (F.col("row") % 16).alias("y"))
    return K.linearity(e, ["wr", "wc"]).select("wr", "wc", r6("linearity_index").alias("linearity_index"))


GLCM = """q AS (SELECT wr, wc, row, col, CAST(floor((v - min(v) OVER k) / (max(v) OVER k - min(v) OVER k) * 15) AS INTEGER) AS q, count(v) OVER k AS n_valid FROM tz WHERE v IS NOT NULL WINDOW k AS (PARTITION BY wr, wc)),
p AS (SELECT a.wr, a.wc, o.k, a.q AS i, b.q AS j FROM q a, (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) o(k, dr, dc) JOIN q b ON b.wr = a.wr AND b.wc = a.wc AND b.row = a.row + o.dr AND b.col = a.col + o.dc),
s AS (SELECT wr, wc, k, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT wr, wc, k, j, i FROM p) u GROUP BY ALL),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY wr, wc, k) AS f FROM s)"""


@query(
    "texture_entropy",
    f"""WITH {TILES16}, {GLCM}, e AS (SELECT wr, wc, k, -sum(f * log2(f)) AS e FROM f GROUP BY ALL), n AS (SELECT wr, wc, count(v) AS n_valid FROM tz GROUP BY ALL)
SELECT n.wr, n.wc, n_valid, {s6('CASE WHEN n_valid >= 250 THEN avg(e.e) END', 'glcm_texture')}, CASE WHEN n_valid < 250 THEN 'n_valid=' || n_valid || ' < min_valid_pixels=250' END AS reason FROM n LEFT JOIN e USING (wr, wc) GROUP BY n.wr, n.wc, n_valid""",
)
def texture_entropy(spark, sf):
    t = K.texture_entropy(tiles(spark, sf, 16), ["wr", "wc"], "v", min_valid=250)
    return t.select("wr", "wc", "n_valid", r6("glcm_texture").alias("glcm_texture"), F.col("glcm_texture_reason").alias("reason"))


@query(
    "texture_properties",
    f"""WITH {TILES16}, {GLCM}, m AS (SELECT wr, wc, k, sum(f * (i - j) * (i - j)) AS contrast, sum(f * abs(i - j)) AS dissimilarity, sum(f / (1.0 + (i - j) * (i - j))) AS homogeneity, sum(f * f) AS asm FROM f GROUP BY ALL)
SELECT wr, wc, {s6('avg(contrast)', 'contrast')}, {s6('avg(dissimilarity)', 'dissimilarity')}, {s6('avg(homogeneity)', 'homogeneity')}, {s6('avg(asm)', 'asm')}, {s6('avg(sqrt(asm))', 'energy')} FROM m GROUP BY wr, wc""",
)
def texture_properties(spark, sf):
    t = K.texture_properties(tiles(spark, sf, 16), ["wr", "wc"], "v")
    return t.select("wr", "wc", *[r6(c).alias(c) for c in ("contrast", "dissimilarity", "homogeneity", "asm", "energy")])


@query(
    "relative_elevation",
    f"""WITH {ZGRID}, n AS (SELECT max(row) + 1 AS rows FROM zg), o AS (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest(generate_series(-2, 2)) AS i) a, (SELECT unnest(generate_series(-2, 2)) AS i) b),
t AS (SELECT z.row, z.col, z.v, z.row + dr AS r, z.col + dc AS c, rows FROM zg z, o, n), m AS (SELECT row, col, v, CASE WHEN r < 0 THEN -1 - r WHEN r >= rows THEN 2 * rows - 1 - r ELSE r END AS r, CASE WHEN c < 0 THEN -1 - c WHEN c >= 64 THEN 127 - c ELSE c END AS c FROM t)
SELECT m.row, m.col, {s6('any_value(m.v) - avg(b.v)', 'rei')} FROM m JOIN zg b ON b.row = m.r AND b.col = m.c GROUP BY m.row, m.col""",
)
def relative_elevation(spark, sf):
    rows = table(spark, sf, "embeddings").count()
    return K.relative_elevation(z_grid(spark, sf), "v", 5, rows, 64).select("row", "col", r6("rei").alias("rei"))


@query(
    "terrain",
    f"""WITH {GRID}, n AS (SELECT a.row, a.col, max(a.value) AS z5, {', '.join(f"max(CASE WHEN b.row - a.row = {r} AND b.col - a.col = {c} THEN b.value END) AS z{i}" for i, (r, c) in enumerate([(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)], 1) if i != 5)}
  FROM cells a JOIN cells b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col HAVING count(*) = 9),
g AS (SELECT row, col, ((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7)) / 8 AS p, ((z7 + 2 * z8 + z9) - (z1 + 2 * z2 + z3)) / 8 AS q, z6 - 2 * z5 + z4 AS r, z2 - 2 * z5 + z8 AS t, (z3 + z7 - z1 - z9) / 4 AS s FROM n),
a AS (SELECT *, degrees(atan2(q, -p)) AS turn, CASE WHEN degrees(atan2(q, -p)) < 0 THEN 90 - degrees(atan2(q, -p)) WHEN degrees(atan2(q, -p)) > 90 THEN 450 - degrees(atan2(q, -p)) ELSE 90 - degrees(atan2(q, -p)) END AS aspect FROM g)
SELECT row, col, {s6('degrees(atan(sqrt(p * p + q * q)))', 'slope_deg')}, {s6('aspect', 'aspect')}, {s6('cos(radians(aspect))', 'northness')}, {s6('sin(radians(aspect))', 'eastness')}, {s6('-(r * p * p - 2 * s * p * q + t * q * q) / (p * p + q * q)', 'profile_curvature')} FROM a""",
)
def terrain(spark, sf):
    g = grid(spark, sf).select(F.lit("g").alias("unit"), F.lit(0).alias("t"), "row", "col", "value")
    return K.terrain(g, "value", 1.0).select("row", "col", *[r6(c).alias(c) for c in ("slope_deg", "aspect", "northness", "eastness", "profile_curvature")])


@query(
    "image_gaps",
    """WITH px AS (SELECT l_returnflag AS unit, CAST(l_orderkey % 64 AS INTEGER) AS row, CAST(l_partkey % 64 AS INTEGER) AS col, max(CASE WHEN (l_orderkey % 64 // 4 * 7 + l_partkey % 64 // 4 * 3) % 17 = 0 THEN 0 ELSE l_tax END) AS red, sum(l_quantity) AS height FROM lineitem GROUP BY ALL),
g AS (SELECT *, red = 0 AS gap FROM px), c AS (SELECT unit, row // 4 AS r, col // 4 AS c, avg(gap::INT) AS s FROM g GROUP BY ALL), n AS (SELECT DISTINCT a.unit, a.r, a.c FROM c a JOIN c b ON a.unit = b.unit AND b.s >= 0.5 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 1)
SELECT g.unit, g.row, g.col, CASE WHEN gap THEN 'gap' WHEN n.unit IS NOT NULL THEN 'edge' END AS why, CASE WHEN NOT gap AND n.unit IS NULL THEN height END AS masked_height FROM g LEFT JOIN n ON n.unit = g.unit AND n.r = g.row // 4 AND n.c = g.col // 4""",
)
def image_gaps(spark, sf):
    row, c = (F.col("l_orderkey") % 64).cast("int"), (F.col("l_partkey") % 64).cast("int")
    off = (F.floor(row / 4) * 7 + F.floor(c / 4) * 3) % 17 == 0
    px = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("unit"), row.alias("row"), c.alias("col"), F.when(off, 0.0).otherwise(F.col("l_tax")).alias("red"), "l_quantity")
    px = px.groupBy("unit", "row", "col").agg(F.max("red").alias("red"), F.sum("l_quantity").alias("height")).withColumns({"nir": F.lit(0.0), "other": F.lit(0.0)})
    return K.image_gaps(px, ["unit"], 4, 1.0).select("unit", "row", "col", "why", "masked_height")


@query(
    "source_mosaic",
    """WITH px AS (SELECT l_orderkey % 128 AS row, l_partkey % 128 AS col, l_linenumber AS src, max(CASE WHEN l_suppkey % 4 = 0 THEN l_quantity END) AS v FROM lineitem GROUP BY ALL)
SELECT row, col, arg_min(v, src) FILTER (v IS NOT NULL) AS value, min(src) FILTER (v IS NOT NULL) AS source_order FROM px GROUP BY row, col""",
)
def source_mosaic(spark, sf):
    px = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 128).alias("row"), (F.col("l_partkey") % 128).alias("col"), F.col("l_linenumber").alias("source_order")).agg(F.max(F.when(F.col("l_suppkey") % 4 == 0, F.col("l_quantity"))).alias("value"))
    return K.mosaic(px, ["row", "col"])


FILES = """files AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS unit, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice % 50 AS l, o_totalprice % 37 AS b, 1000 + o_totalprice % 60 AS r, 1200 + o_totalprice % 70 AS u FROM orders)"""


@query(
    "common_grid",
    f"""WITH {FILES}, y AS (SELECT unit, year, min(l) AS l, min(b) AS b, max(r) AS r, max(u) AS u FROM files GROUP BY ALL), x AS (SELECT unit, max(l) AS l, max(b) AS b, min(r) AS r, min(u) AS u FROM y GROUP BY unit),
p AS (SELECT unit, CAST(ceil(l / 0.6 - 1e-6) AS BIGINT) AS first_col, CAST(floor(r / 0.6 + 1e-6) AS BIGINT) AS stop_col, CAST(ceil((1300 - u) / 0.6 - 1e-6) AS BIGINT) AS first_row, CAST(floor((1300 - b) / 0.6 + 1e-6) AS BIGINT) AS stop_row FROM x)
SELECT unit, first_row, first_col, (stop_row - first_row) // 32 AS cell_rows, (stop_col - first_col) // 32 AS cell_cols FROM p""",
)
def common_grid(spark, sf):
    o = table(spark, sf, "orders")
    p = F.col("o_totalprice")
    files = o.select((F.col("o_custkey") % 40).cast("string").alias("unit"), F.year("o_orderdate").alias("year"), (p % 50).alias("left"), (p % 37).alias("bottom"), (1000 + p % 60).alias("right"), (1200 + p % 70).alias("top"))
    return K.common_grid(files, 0.6, 19.2, (0.0, 1300.0))


@query(
    "grid_problems",
    """SELECT CAST(o_custkey % 300 AS VARCHAR) AS unit, count(*) AS n_layers, concat_ws(', ', CASE WHEN count(DISTINCT o_orderkey % 50 = 0) > 1 THEN 'crs' END, CASE WHEN count(DISTINCT (o_orderkey % 30 = 1, o_orderkey % 90 = 1)) > 1 THEN 'origin' END, CASE WHEN count(DISTINCT (o_orderkey % 40 = 2)) > 1 THEN 'shape' END) AS differs FROM orders GROUP BY 1""",
)
def grid_problems(spark, sf):
    k = F.col("o_orderkey")
    layers = table(spark, sf, "orders").select((F.col("o_custkey") % 300).cast("string").alias("unit"), (k % 50 == 0).alias("crs"), F.lit(0.6).alias("pixel_m"), (k % 30 == 1).alias("left"), (k % 90 == 1).alias("top"), (k % 40 == 2).alias("rows"), F.lit(5).alias("cols"))
    return K.grid_problems(layers)


@query(
    "lattice_starts",
    """WITH a AS (SELECT p_partkey, 300 + p_size * 37 AS length, p_partkey * 11 % 1000 AS origin FROM part),
r AS (SELECT *, ((-origin) % 384 + 384) % 384 AS f FROM a)
SELECT p_partkey, CAST(start AS BIGINT) AS start FROM (SELECT p_partkey, unnest(CASE WHEN length <= 512 THEN [0] ELSE list_distinct(list_concat([0, length - 512], CASE WHEN f <= length - 512 THEN generate_series(f, length - 512, 384) ELSE [0] END)) END) AS start FROM r) q""",
)
def lattice_starts(spark, sf):
    axis = table(spark, sf, "part").select("p_partkey", (300 + F.col("p_size") * 37).cast("long").alias("length"), (F.col("p_partkey") * 11 % 1000).alias("origin"))
    return K.lattice_starts(axis, 512, 384).select("p_partkey", "start")


@query(
    "halo_blocks",
    f"""WITH {GRID}, b AS (SELECT r AS block_row, c AS block_col FROM (SELECT unnest(generate_series(0, (SELECT max(row) // 16 FROM cells) + 1)) AS r) x, (SELECT unnest(generate_series(0, 4)) AS c) y)
SELECT block_row, block_col, count(*) AS n_cells, count(*) FILTER (row // 16 = block_row AND col // 16 = block_col) AS n_core FROM b JOIN cells ON row BETWEEN block_row * 16 - 3 AND block_row * 16 + 18 AND col BETWEEN block_col * 16 - 3 AND block_col * 16 + 18 GROUP BY ALL""",
)
def halo_blocks(spark, sf):
    g = K.halo_blocks(grid(spark, sf), 16, 3)
    return g.groupBy("block_row", "block_col").agg(F.count(F.lit(1)).alias("n_cells"), F.count(F.when(F.col("core"), 1)).alias("n_core"))


@query(
    "distance_bins",
    f"""WITH {ZGRID}, s AS (SELECT row, col FROM zg WHERE v > 2.2),
d AS (SELECT z.row, z.col, any_value(z.v) AS h, sqrt(min((z.row - s.row) * (z.row - s.row) + (z.col - s.col) * (z.col - s.col))) * 0.6 AS dist FROM zg z, s GROUP BY z.row, z.col),
b(lo, hi) AS (VALUES (0.0::DOUBLE, 0.6::DOUBLE), (0.6, 1.8), (1.8, 3.6), (3.6, 5.5), (50, 60))
SELECT lo AS bin_lo, hi AS bin_hi, count(h) AS n_pixels, {s6('CASE WHEN count(h) >= 10 THEN avg(CASE WHEN h >= 2 THEN 1.0 WHEN h IS NOT NULL THEN 0.0 END) END', 'canopy_fraction')}, {s6('CASE WHEN count(h) >= 10 THEN median(h) END', 'height_median')}, {s6('CASE WHEN count(h) >= 10 THEN quantile_cont(h, 0.9) END', 'height_p90')}
FROM b LEFT JOIN d ON dist >= lo AND dist < hi GROUP BY lo, hi""",
)
def distance_bins(spark, sf):
    d = K.distance_to(z_grid(spark, sf), K.holds(F.col("v") > 2.2))
    d = cut_lineage(d.select(F.col("v").alias("height"), (F.col("distance") * 0.6).alias("distance")))  # several passes follow
    out = Z.height_by_distance(d, [0.0, 0.6, 1.8, 3.6, 5.5])
    far = Z.height_by_distance(d, [50.0, 60.0])
    return out.unionByName(far).select("bin_lo", "bin_hi", "n_pixels", *[r6(c).alias(c) for c in ("canopy_fraction", "height_median", "height_p90")])


