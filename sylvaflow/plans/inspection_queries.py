"""Queries on inspection samples, yearly metrics by name, unions of shapes, window tables, tiles and lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import r6
from sylvaflow.operators import annual as AN
from sylvaflow.operators import cells as K
from sylvaflow.operators import components as G
from sylvaflow.operators import inspection as I
from sylvaflow.operators import spatial as A
from sylvaflow.operators import sweep as U
from sylvaflow.operators import verdicts as V
from sylvaflow.operators import windows as WN
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.cell_queries import YGRID, years_grid
from sylvaflow.plans.change_queries import FLAGS, KEPT, OBJ, comp_sql, flag_cells
from sylvaflow.plans.label_queries import CROSS, POLY, polygons
from sylvaflow.plans.sample_queries import alloc_sql, key_sql
from sylvaflow.plans.stand_ins import GRID, SENSOR_OF, grid, table
from sylvaflow.plans.stand_queries import CROWNS, GRID_H, PIXEL_METRICS, crowns, grid_heights
from sylvaflow.plans.verdict_queries import pick, sql_pick

# --- inspection sample -----------------------------------------------------------------------
CELL_HA = 0.036864
LABEL = "CASE WHEN t > 0 THEN (2012 + 3 * t) || '-' || (2015 + 3 * t) ELSE '2015' END"
INSPECTION_DESIGN = {"n_detected": 24, "n_below_mmu": 6, "n_no_detection": 12, "min_per_interval": 2, "seed": 0}


def _drawn_sql(src: str, out: str, stratum: str, total: int, least: int, number: str) -> str:
    key = key_sql(f"0:{stratum}", "('g:' || t || ':' || label)")
    return f"""{out}_c AS (SELECT iv, count(*) AS n FROM {src} GROUP BY iv), {alloc_sql(f'{out}_c', f'{out}_s', str(total), least, 'iv')},
{out} AS (SELECT '{stratum}' AS stratum, {number} AS object_id, iv, t, n_cells, mean_prob, mean_z, x * 19.2 AS x, -y * 19.2 AS y, n, share / n::DOUBLE AS incl
  FROM (SELECT o.*, s.n, s.share, row_number() OVER (PARTITION BY iv ORDER BY {key}, t, label) AS r FROM {src} o JOIN {out}_s s USING (iv)) q WHERE r <= share)"""


@query(
    "inspection_sample",
    f"""WITH RECURSIVE {YGRID}, {FLAGS}, {comp_sql('flags')}, {KEPT}, {OBJ},
mo AS (SELECT row, col, t, z, coalesce(lag(forest) OVER (PARTITION BY row, col ORDER BY t), FALSE) AS mon FROM yg),
fi AS (SELECT row, col, CAST(min(t) AS INTEGER) AS t FROM flags GROUP BY row, col), rj AS (SELECT t, row, col FROM fi ANTI JOIN det USING (row, col)), {comp_sql('rj', 'rc')},
kept_o AS (SELECT *, {LABEL} AS iv FROM onum),
near_o AS (SELECT t, label, count(*) AS n_cells, avg(chm_cover) AS mean_prob, avg(z) AS mean_z, avg(col + 0.5) AS x, avg(row + 0.5) AS y, {LABEL} AS iv FROM rc JOIN yg USING (t, row, col) GROUP BY t, label HAVING count(*) >= 3),
{_drawn_sql('kept_o', 'dk', 'detected', 24, 2, 'object_id')}, {_drawn_sql('near_o', 'dn', 'below_mmu', 6, 1, 'NULL')},
ev AS (SELECT row, col, bool_or(z > 1.1) AS f, count(*) FILTER (mon AND t > 0) AS nd, arg_min({{'t': t, 'z': z}}, {key_sql('0:date', "('g:' || row || ':' || col || ':' || t)")}) FILTER (mon AND t > 0) AS p FROM mo GROUP BY row, col),
fl8 AS (SELECT DISTINCT row + a AS row, col + b AS col FROM ev, (SELECT unnest([-1, 0, 1]) AS a) u, (SELECT unnest([-1, 0, 1]) AS b) w WHERE f),
qu AS (SELECT e.* FROM ev e ANTI JOIN fl8 USING (row, col) WHERE NOT f AND nd > 0),
dq AS (SELECT 'no_detection' AS stratum, NULL AS object_id, p.t AS t, p.z AS mean_z, (col + 0.5) * 19.2 AS x, -(row + 0.5) * 19.2 AS y, n, least(12, n) / n::DOUBLE / nd AS incl
  FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {key_sql('0:no_detection', "('g:' || row || ':' || col)")}, row, col) AS r FROM qu) k WHERE r <= 12),
al AS (SELECT stratum, object_id, iv, t, n_cells, mean_prob, mean_z, x, y, n, incl FROM dk UNION ALL SELECT stratum, object_id, iv, t, n_cells, mean_prob, mean_z, x, y, n, incl FROM dn
  UNION ALL SELECT stratum, object_id, {LABEL}, t, 1, NULL, mean_z, x, y, n, incl FROM dq)
SELECT printf('S%02d', row_number() OVER (ORDER BY list_position(['detected', 'below_mmu', 'no_detection'], stratum), t, object_id NULLS FIRST, y, x)) AS sample_id, stratum, object_id, iv AS interval, CAST(2015 + 3 * t AS INTEGER) AS onset_year,
  n_cells, {s6('mean_prob', 'mean_prob')}, {s6('mean_z', 'mean_z')}, {s6('x', 'x')}, n AS n_population, {s6('incl', 'incl_prob')}, round(1 / incl, 4) AS weight, t < 2 AS follow_up FROM al""",
)
def inspection_sample(spark, sf):
    g = K.monitored_flags(years_grid(spark, sf)).withColumn("flag", F.col("z") > 1.1)
    flags = flag_cells(spark, sf)
    kept = G.interval_detections(flags, [0, 1, 2], least=6, growth=3)
    layers = g.withColumn("probability", F.col("chm_cover"))
    years = g.select("unit", "t", "year").distinct()
    objects = G.detection_objects(kept, layers, years, growth_below=6)
    near = G.detection_objects(I.rejected_cells(flags, kept), layers, years)
    s = I.inspection_sample(objects, near, I.quiet_cells(g, 0, clear=1), years, mmu_ha=6 * CELL_HA, cell_m=19.2, design=INSPECTION_DESIGN)
    return s.select("sample_id", "stratum", "object_id", "interval", "onset_year", "n_cells", r6("mean_prob").alias("mean_prob"), r6("mean_z").alias("mean_z"), r6("x").alias("x"), "n_population", r6("incl_prob").alias("incl_prob"), F.round("weight", 4).alias("weight"), "follow_up")


# --- yearly metrics by name ----------------------------------------------------------------------
def band_observations(spark, sf):
    """Orders as observations with four bands; some bands are missing and some sensors not yet in service."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    sensor = F.element_at(F.create_map(*[F.lit(x) for pair in SENSOR_OF.items() for x in pair]), F.substring("o_orderpriority", 1, 1))
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).cast("string").alias("stand_id"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"), sensor.alias("sensor"),
        F.when(k % 19 != 0, p % 613 / 1000.0).alias("red"), F.when(k % 31 != 0, p % 997 / 1000.0).alias("nir"), (p % 411 / 1000.0).alias("swir1"), (p % 291 / 1000.0).alias("swir2"),
    )


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN live AND {a} + {b} <> 0 AND ({a} - {b}) / ({a} + {b}) BETWEEN -1 AND 1 THEN ({a} - {b}) / ({a} + {b}) END"


def _annual_metrics_sql() -> str:
    inside = "doy BETWEEN 152 AND 258"
    reason = lambda n, least, where: f"CASE WHEN {n} < {least} THEN 'n_obs=' || {n} || '{where} < min_obs={least}' END"
    season = " in DOY 152-258"
    return f"""WITH o AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS stand_id, CAST(year(o_orderdate) AS INTEGER) AS year, dayofyear(o_orderdate) AS doy,
  (substr(o_orderpriority, 1, 1) = '1' AND year(o_orderdate) BETWEEN 1984 AND 2012) OR (substr(o_orderpriority, 1, 1) IN ('2', '5') AND year(o_orderdate) BETWEEN 1999 AND 2024) AS live,
  CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice % 613 / 1000.0::DOUBLE END AS red, CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice % 997 / 1000.0::DOUBLE END AS nir, o_totalprice % 411 / 1000.0::DOUBLE AS swir1, o_totalprice % 291 / 1000.0::DOUBLE AS swir2 FROM orders),
i AS (SELECT stand_id, year, doy, {_ratio('nir', 'red')} AS ndvi, {_ratio('nir', 'swir2')} AS nbr, {_ratio('nir', 'swir1')} AS ndmi FROM o),
a AS (SELECT stand_id, year, count(ndvi) FILTER ({inside}) AS n, count(ndvi) FILTER (NOT {inside}) AS no, count(ndvi) AS nn, avg(ndvi) FILTER ({inside}) AS m, avg(ndvi) FILTER (NOT {inside}) AS mo, stddev_pop(ndvi) AS s,
  count(nbr) FILTER ({inside}) AS nb, min(nbr) FILTER ({inside}) AS b, count(ndmi) FILTER ({inside}) AS nm, avg(ndmi) FILTER ({inside}) AS d FROM i GROUP BY stand_id, year)
SELECT stand_id, year, {s6('CASE WHEN n >= 3 THEN m END', 'ndvi_season_mean')}, {reason('n', 3, season)} AS ndvi_season_mean_reason, {s6('CASE WHEN nb >= 3 THEN b END', 'nbr_season_min')}, {reason('nb', 3, season)} AS nbr_season_min_reason,
  {s6('CASE WHEN nm >= 3 THEN d END', 'ndmi_season_mean')}, {s6('CASE WHEN n >= 2 AND no >= 2 THEN m - mo END', 'ndvi_season_contrast')}, coalesce({reason('n', 2, ' in season')}, {reason('no', 2, ' out of season')}) AS ndvi_season_contrast_reason,
  {s6('CASE WHEN nn >= 3 THEN s END', 'ndvi_spread')} FROM a"""


@query("annual_metrics", _annual_metrics_sql())
def annual_metrics(spark, sf):
    m = AN.standard_catalogue().compute(band_observations(spark, sf))
    values = ["ndvi_season_mean", "nbr_season_min", "ndmi_season_mean", "ndvi_season_contrast", "ndvi_spread"]
    return m.select("stand_id", "year", *[r6(c).alias(c) for c in values], "ndvi_season_mean_reason", "nbr_season_min_reason", "ndvi_season_contrast_reason")


# --- unions of shapes ------------------------------------------------------------------------------
RUNS = ["a", "b", "c"]


def run_boxes(spark, sf):
    """A box per order, in a strip that grows with the table, so that boxes of a run overlap."""
    k = F.col("o_orderkey")
    x, y = F.floor(F.col("o_totalprice") % 600).cast("double"), (k * 13 % 500 + F.floor(k / 15000) * 600).cast("double")
    w, h = 3 + k % 9, 2 + k % 7
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    ring = F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    return table(spark, sf, "orders").select(F.lit("g").alias("unit"), pick(RUNS, k).alias("run"), k.alias("shape"), ring.alias("vertices"))


@query(
    "union_overlap",
    f"""WITH b AS (SELECT {sql_pick(RUNS, 'o_orderkey')} AS run, CAST(floor(o_totalprice % 600) AS BIGINT) AS x, o_orderkey * 13 % 500 + o_orderkey // 15000 * 600 AS y, 3 + o_orderkey % 9 AS w, 2 + o_orderkey % 7 AS h FROM orders),
r AS (SELECT run, x, w, unnest(generate_series(y, y + h - 1)) AS py FROM b), c AS (SELECT DISTINCT run, py, unnest(generate_series(x, x + w - 1)) AS px FROM r),
f AS (SELECT px, py, bool_or(run = 'a') AS a, bool_or(run = 'b') AS b, bool_or(run = 'c') AS c FROM c GROUP BY px, py)
SELECT run, {s6('CASE run WHEN ' + "'a' THEN count(*) FILTER (a) WHEN 'b' THEN count(*) FILTER (b) ELSE count(*) FILTER (c) END", 'area')},
  {', '.join(s6(f"100.0 * count(*) FILTER ({r} AND CASE run WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END) / count(*) FILTER (CASE run WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END)", r) for r in RUNS)}
FROM f, (SELECT unnest(['a', 'b', 'c']) AS run) q GROUP BY run""",
)
def union_overlap(spark, sf):
    u = U.union_overlap(run_boxes(spark, sf), RUNS, band=16.0, tile=32.0)
    return u.select("run", r6("area").alias("area"), *[r6(r).alias(r) for r in RUNS])


# --- window tables -----------------------------------------------------------------------------------
SIZES = [25.0, 50.0]
ZONE = "window_m, wr, wc"
SAME = "a.window_m = b.window_m AND a.wr = b.wr AND a.wc = b.wc"


def _window_table_sql() -> str:
    shares = ", ".join(e.strip().rstrip(",") for e in PIXEL_METRICS.strip().split("\n") if "n_valid" not in e)
    names = ["gap_fraction", "crown_fraction", *P.HEIGHT_BANDS]
    return f"""WITH {GRID}, {GRID_H}, {CROWNS}, b AS (SELECT gh.row, gh.col, height, value * 8 AS v FROM gh JOIN cells USING (row, col)), w AS (SELECT unnest([25.0, 50.0])::DOUBLE AS window_m, unnest([8, 16]) AS px), n AS (SELECT count(*) AS rows FROM embeddings),
fr AS (SELECT window_m, CAST(unnest(generate_series(0, rows // px - 1)) AS INTEGER) AS wr, px FROM w, n), fm AS (SELECT window_m, wr, CAST(unnest(generate_series(0, 64 // px - 1)) AS INTEGER) AS wc FROM fr),
t AS (SELECT window_m, px, row // px AS wr, col // px AS wc, row, col, height, v, coalesce(height >= 2, FALSE) AS canopy FROM b, w, n WHERE row // px < rows // px AND col // px < 64 // px),
hs AS (SELECT {ZONE}, count(height) AS n_valid, {shares} FROM t GROUP BY ALL),
q AS (SELECT {ZONE}, row, col, CAST(floor((v - min(v) OVER k) / (max(v) OVER k - min(v) OVER k) * 15) AS INTEGER) AS q, count(v) OVER k AS nv FROM t WINDOW k AS (PARTITION BY {ZONE})),
p AS (SELECT a.window_m, a.wr, a.wc, o.k, a.q AS i, b.q AS j FROM q a, (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) o(k, dr, dc) JOIN q b ON {SAME} AND b.row = a.row + o.dr AND b.col = a.col + o.dc WHERE a.nv >= 100),
s AS (SELECT {ZONE}, k, i, j, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT window_m, wr, wc, k, j, i FROM p) u GROUP BY ALL), g AS (SELECT *, n / sum(n) OVER (PARTITION BY {ZONE}, k) AS f FROM s),
te AS (SELECT {ZONE}, avg(e) AS e FROM (SELECT {ZONE}, k, -sum(f * log2(f)) AS e FROM g GROUP BY ALL) x GROUP BY ALL),
ed AS (SELECT a.window_m, a.px, a.wr, a.wc, a.row, a.col, bool_or(abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.canopy <> b.canopy) AS edge, count(*) = 9 AS inner_cell FROM t a JOIN t b ON {SAME} AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL),
es AS (SELECT {ZONE}, count(*) FILTER (edge AND inner_cell) * 3.125 / (count(*) * 3.125 * 3.125) AS density FROM ed GROUP BY ALL),
ho AS (SELECT {ZONE}, a, round(round(cos(a * pi() / 90 - pi() / 2), 12) * (col - wc * px) + round(sin(a * pi() / 90 - pi() / 2), 12) * (row - wr * px)) AS rho, count(*) AS n FROM ed, (SELECT unnest(generate_series(0, 89)) AS a) z WHERE edge GROUP BY ALL),
ls AS (SELECT {ZONE}, 1 - avg(n) / max(n) AS line FROM ho GROUP BY ALL),
cp AS (SELECT CAST(floor(x / 3.125) AS INTEGER) AS col, CAST(floor((1000 - y) / 3.125) AS INTEGER) AS row, d FROM crowns),
cs AS (SELECT window_m, row // px AS wr, col // px AS wc, count(d) AS nc, CASE WHEN count(d) >= 3 THEN avg(d) END AS cm, CASE WHEN count(d) >= 3 THEN stddev_pop(d) / avg(d) END AS cv FROM cp, w, n WHERE row >= 0 AND col >= 0 AND row // px < rows // px AND col // px < 64 // px GROUP BY ALL)
SELECT fm.window_m, fm.wr, fm.wc, coalesce(n_valid, 0) AS n_valid, {', '.join(s6(c, c) for c in names)}, {s6('te.e', 'glcm_texture')}, {s6('es.density', 'edge_density')}, {s6('ls.line', 'linearity_index')}, coalesce(nc, 0) AS crown_count, {s6('cm', 'crown_mean')}, {s6('cv', 'crown_cv')}
FROM fm LEFT JOIN hs USING ({ZONE}) LEFT JOIN te USING ({ZONE}) LEFT JOIN es USING ({ZONE}) LEFT JOIN ls USING ({ZONE}) LEFT JOIN cs USING ({ZONE})"""


@query("window_table", _window_table_sql())
def window_table(spark, sf):
    values = grid(spark, sf).select("row", "col", (F.col("value") * 8).alias("band"))
    pixels = grid_heights(spark, sf).join(values, ["row", "col"])
    rows = table(spark, sf, "embeddings").count()
    w = WN.window_table(pixels, SIZES, 3.125, rows, 64, crowns=crowns(spark, sf), origin=(0.0, 1000.0), min_valid=100)
    names = ["gap_fraction", "crown_fraction", *P.HEIGHT_BANDS, "glcm_texture", "edge_density", "linearity_index", "crown_mean", "crown_cv"]
    return w.select("window_m", "wr", "wc", "n_valid", "crown_count", *[r6(c).alias(c) for c in names])


# --- tiles ---------------------------------------------------------------------------------------------
STRATA = {"Clearcut": "clearcut", "Wind": "wind"}
DISTURBANCES = ["Clearcut", "Wind", "Unknown", "Ice"]


@query(
    "described_tiles",
    f"""WITH {GRID}, {GRID_H}, {POLY}, ca AS (SELECT row // 16 AS tr, col // 16 AS tc, 1 - count(height) / 256.0::DOUBLE AS nodata, count(*) FILTER (height >= 2) / 256.0::DOUBLE AS canopy, median(height) FILTER (height >= 2) AS hm, quantile_cont(height, 0.9) FILTER (height >= 2) AS hp FROM gh GROUP BY ALL),
g AS (SELECT r AS row, c AS col, c * 2.0 + 1 AS px, 1000 - (r * 2.0 + 1) AS py FROM (SELECT unnest(generate_series(0, 499)) AS r) a, (SELECT unnest(generate_series(0, 63)) AS c) b),
hit AS (SELECT stand_id, row, col FROM ed, g WHERE {CROSS.format(x='px', y='py')} GROUP BY ALL HAVING count(*) % 2 = 1),
cv AS (SELECT row // 16 AS tr, col // 16 AS tc, stand_id, count(*) / 256.0::DOUBLE AS cover FROM hit GROUP BY ALL), be AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY tr, tc ORDER BY cover DESC, stand_id DESC) = 1),
nm AS (SELECT tr, tc, stand_id, CASE {sql_pick(DISTURBANCES, 'CAST(substr(stand_id, 2) AS BIGINT)')} WHEN 'Clearcut' THEN 'clearcut' WHEN 'Wind' THEN 'wind' END AS st FROM be WHERE cover >= 0.15),
jo AS (SELECT ca.*, CASE WHEN st IS NOT NULL THEN nm.stand_id END AS stand_id, coalesce(st, CASE WHEN nodata > 0.2 OR canopy < 0.6 THEN 'edge_and_gap' END) AS st FROM ca LEFT JOIN nm USING (tr, tc)),
cu AS (SELECT median(hm) AS cut FROM jo WHERE st IS NULL AND hm IS NOT NULL)
SELECT CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, {s6('nodata', 'nodata_fraction')}, {s6('canopy', 'canopy_fraction')}, {s6('hm', 'height_median')}, {s6('hp', 'height_p90')}, stand_id, coalesce(st, CASE WHEN hm >= cut THEN 'undisturbed_tall' WHEN hm < cut THEN 'undisturbed_mixed' ELSE 'undisturbed' END) AS stratum FROM jo, cu""",
)
def described_tiles(spark, sf):
    canopy = A.tile_canopy(grid_heights(spark, sf), 16, canopy_m=2.0, keys=())
    p = polygons(spark, sf)
    cover = A.tile_cover(A.zone_runs(p, "stand_id", 2.0, 500, 64, (0.0, 1000.0)), "stand_id", 16)
    labels = p.select("stand_id", pick(DISTURBANCES, F.substring("stand_id", 2, 20).cast("bigint")).alias("dist_label"))
    d = A.describe_tiles(canopy, cover, labels, STRATA, max_nodata=0.2, min_canopy=0.6)
    return d.select("tr", "tc", *[r6(c).alias(c) for c in ("nodata_fraction", "canopy_fraction", "height_median", "height_p90")], "stand_id", "stratum")


# --- acquisitions ----------------------------------------------------------------------------------------
@query(
    "acquisition_layer",
    """SELECT 'u' || (o_custkey % 50 % 6) AS unit, 'w' || (o_custkey % 50) AS window_id, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(min(o_orderdate), '%Y-%m-%d') AS acquisition_date, CASE WHEN o_custkey % 2 = 0 THEN 'naip' ELSE 'state' END AS naip_source,
  CASE WHEN o_custkey % 50 % 7 <> 0 THEN (o_custkey % 50 % 3 + 1) * 0.5::DOUBLE END AS native_m, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS item_ids FROM orders GROUP BY o_custkey % 50, o_custkey % 2, year(o_orderdate)""",
)
def acquisition_layer(spark, sf):
    w = F.col("o_custkey") % 50
    o = table(spark, sf, "orders").select(w.alias("w"), F.year("o_orderdate").cast("string").alias("year"), "o_orderdate", "o_orderpriority")
    info = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.when(F.col("w") % 2 == 0, "naip").otherwise("state").alias("source"),
        F.when(F.col("w") % 7 != 0, (F.col("w") % 3 + 1) * 0.5).alias("native_m"), F.col("items").alias("item_ids"),
    )
    per = o.groupBy("w", "year").agg(F.min("o_orderdate").alias("date"), F.array_sort(F.collect_set("o_orderpriority")).alias("items"))
    meta = per.groupBy("w").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("year", info))).alias("years"))).alias("meta"))
    windows = meta.select(F.concat(F.lit("u"), F.col("w") % 6).alias("unit"), F.concat(F.lit("w"), F.col("w")).alias("window_id"), "meta")
    return V.acquisition_layer(windows)


# --- lattices ----------------------------------------------------------------------------------------------
BOUNDS = """b AS (SELECT 'u' || (o_custkey % 30) AS unit, min(o_totalprice % 700) - 300 AS minx, min(o_totalprice % 900) - 5000 AS miny, 2000 + max(o_totalprice % 777) AS maxx, 1500 + max(o_totalprice % 555) AS maxy FROM orders GROUP BY 1),
e AS (SELECT unit, CAST(floor(round_even(minx / 0.6, 0) / 32) * 32 AS BIGINT) AS col0, CAST(ceil(round_even(maxx / 0.6, 0) / 32) * 32 AS BIGINT) AS x1, CAST(floor(round_even(miny / 0.6, 0) / 32) * 32 AS BIGINT) AS y0, CAST(ceil(round_even(maxy / 0.6, 0) / 32) * 32 AS BIGINT) AS row0 FROM b),
gr AS (SELECT unit, col0, row0, (x1 - col0) // 32 AS cols, (row0 - y0) // 32 AS rows FROM e)"""


def unit_bounds(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy(F.concat(F.lit("u"), F.col("o_custkey") % 30).alias("unit")).agg(
        (F.min(p % 700) - 300).alias("minx"), (F.min(p % 900) - 5000).alias("miny"), (2000 + F.max(p % 777)).alias("maxx"), (1500 + F.max(p % 555)).alias("maxy")
    )


@query("outward_grid", f"WITH {BOUNDS} SELECT unit, col0, row0, cols, rows FROM gr")
def outward_grid(spark, sf):
    return K.outward_grid(unit_bounds(spark, sf), 0.6, 32)


@query(
    "grid_blocks",
    f"""WITH {BOUNDS}, r AS (SELECT *, unnest(generate_series(0, rows - 1, 48)) AS row FROM gr), c AS (SELECT *, unnest(generate_series(0, cols - 1, 48)) AS col FROM r)
SELECT unit, row, col, least(48, rows - row) AS n_rows, least(48, cols - col) AS n_cols, least(48, rows - row) + 12 AS halo_rows, least(48, cols - col) + 12 AS halo_cols FROM c""",
)
def grid_blocks(spark, sf):
    return K.grid_blocks(K.outward_grid(unit_bounds(spark, sf), 0.6, 32), 48, 6)
