"""Queries on what is written and read back, and on small operators around tables and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow.functions.columns import r6
from sylvaflow.operators import components as G
from sylvaflow.operators import labels as L
from sylvaflow.operators import reports as R
from sylvaflow.operators import zones as Z
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.cell_queries import YGRID, ZGRID, years_grid, z_grid
from sylvaflow.plans.change_queries import FLAGS, KEPT, OBJ, comp_sql
from sylvaflow.plans.label_queries import REASON, SMALL_RULE, detection, label_parts, label_pixels
from sylvaflow.plans.stand_ins import table
from sylvaflow.session import shared_folder
from sylvaflow.sources import observations as SO
from sylvaflow.sources import tables as ST


@query("metric_stack", f"WITH {ZGRID} SELECT 'twice' AS metric, row, col, {s6('v * 2', 'value')} FROM zg WHERE v IS NOT NULL")
def metric_stack(spark, sf):
    path, g = shared_folder(spark, "metrics"), z_grid(spark, sf).where("v IS NOT NULL")
    ST.write_metric_stack({"once": g.select("row", "col", F.col("v").alias("value")), "twice": g.select("row", "col", (F.col("v") * 2).alias("value"))}, path)
    return ST.read_metric_stack(spark, path, ["twice"]).select("metric", "row", "col", r6("value").alias("value"))


@query("stored_years", f"WITH {YGRID} SELECT unit, year, row, col, {s6('chm_height', 'chm_height')} FROM yg WHERE year IN (2015, 2021)")
def stored_years(spark, sf):
    path = shared_folder(spark, "years")
    ST.write_year_stack(years_grid(spark, sf).select("unit", "year", "row", "col", "chm_height"), path)
    return ST.read_year_stack(spark, path, "g", [2015, 2021]).select("unit", "year", "row", "col", r6("chm_height").alias("chm_height"))


@query(
    "stored_observations",
    """WITH o AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS stand_id, CAST(o_orderkey // 2 AS VARCHAR) AS image_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS ms, CASE WHEN year(o_orderdate) < 1999 THEN 0 ELSE 1 END AS batch, o_orderkey % 60 AS n FROM orders)
SELECT stand_id, image_id, year, CAST(n AS INTEGER) AS n_pixels FROM o QUALIFY row_number() OVER (PARTITION BY stand_id, image_id ORDER BY batch DESC, ms DESC) = 1""",
)
def stored_observations(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select((F.col("o_custkey") % 100).cast("string").alias("stand_id"), F.floor(k / 2).cast("string").alias("image_id"), F.year("o_orderdate").cast("short").alias("year"), k.alias("time_ms"), (k % 60).cast("int").alias("n_pixels"))
    schema = SO.observation_schema()
    have = {f.name for f in raw.schema.fields}
    rows = raw.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    path = shared_folder(spark, "observations")
    for batch, part in enumerate(("year < 1999", "year >= 1999", "year >= 1999")):
        SO.write_batch(rows.where(part), path, min(batch, 1))  # the second batch is written twice
    return SO.read_observations(spark, path).select("stand_id", "image_id", F.col("year").cast("int").alias("year"), "n_pixels")


@query(
    "batch_units",
    """SELECT 'c' || c_custkey AS unit_id, CASE WHEN c_custkey % 3 = 0 THEN 'point' ELSE 'cell' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'n' || c_nationkey END AS label, CASE WHEN c_custkey % 3 = 0 THEN CAST(CASE WHEN c_custkey % 2 = 0 THEN 2.5 ELSE 3.0 END AS DOUBLE) END AS buffer_km FROM customer""",
)
def batch_units(spark, sf):
    k = F.col("c_custkey")
    point = k % 3 == 0
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), k).alias("unit_id"), F.when(k % 4 != 0, F.concat(F.lit("n"), "c_nationkey")).alias("label"), F.when(point, -86.5).alias("lon"), F.when(point, 39.25).alias("lat"),
        F.when(k % 2 == 0, 2.5).alias("buffer_km"), F.lit("2012 2014").alias("years"),
    )
    path = shared_folder(spark, "batch")
    rows.write.csv(path, header=True)
    return ST.read_batch(spark, path).select("unit_id", "kind", "label", "buffer_km")


@query(
    "ordered_records",
    """WITH y AS (SELECT o_custkey % 100 AS stand, year(o_orderdate) AS y, count(*) AS n, max(o_orderpriority) AS p FROM orders GROUP BY ALL)
SELECT stand, string_agg(y || ':' || n || ':' || p, ' ' ORDER BY y) AS records FROM y GROUP BY stand""",
)
def ordered_records(spark, sf):
    y = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("stand"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    text = F.transform("sequence", lambda s: F.concat_ws(":", s["year"], s["n"], s["p"]))
    return ST.ordered_records(y, "stand").select("stand", F.array_join(text, " ").alias("records"))


@query(
    "patch_table",
    f"""WITH {YGRID}, p AS (SELECT row // 8 * 8 + col // 8 AS patch_id, year, chm_height AS h FROM yg WHERE row % 17 <> 0)
SELECT patch_id, year, count(h) AS n_pixels, {s6('count(h) * 0.36', 'area_m2')}, {s6('avg((h >= 2)::INT)', 'canopy_fraction')}, {s6('median(h)', 'height_median')}, {s6('quantile_cont(h, 0.9)', 'height_p90')} FROM p GROUP BY ALL""",
)
def patch_table(spark, sf):
    g = years_grid(spark, sf)
    cells = g.select((F.floor(F.col("row") / 8) * 8 + F.floor(F.col("col") / 8)).alias("patch_id"), "year", F.when(F.col("row") % 17 != 0, F.col("chm_height")).alias("height"))
    p = Z.patch_table(cells, 0.6)
    return p.select("patch_id", "year", "n_pixels", *[r6(c).alias(c) for c in ("area_m2", "canopy_fraction", "height_median", "height_p90")])


FOUR = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc)"


def four_sql(source: str, name: str) -> str:
    """Components over the four neighbours of a table (row, col)."""
    return f"""{name}w AS (SELECT row, col, row * 2147483648 + col AS lab FROM {source} UNION SELECT n.row, n.col, w.lab FROM {name}w w, {FOUR} JOIN {source} n ON n.row = w.row + o.dr AND n.col = w.col + o.dc WHERE w.lab < n.row * 2147483648 + n.col),
{name} AS (SELECT row, col, min(lab) AS label FROM {name}w GROUP BY ALL)"""


@query(
    "cleaned_mask",
    f"""WITH RECURSIVE {ZGRID}, a AS (SELECT row, col FROM zg WHERE v > -0.6), k AS (SELECT DISTINCT a.row, a.col FROM a, {FOUR} JOIN a n ON n.row = a.row + o.dr AND n.col = a.col + o.dc),
b AS (SELECT row, col FROM zg EXCEPT SELECT row, col FROM k), {four_sql('b', 'fb')}, small AS (SELECT label FROM fb GROUP BY label HAVING count(*) <= 2)
SELECT row, col FROM k UNION SELECT row, col FROM fb WHERE label IN (SELECT label FROM small)""",
)
def cleaned_mask(spark, sf):
    g = z_grid(spark, sf)
    return G.clean_mask(g.where("v > -0.6"), g, 2, 3).select("row", "col")


@query(
    "run_totals",
    f"""WITH RECURSIVE {YGRID}, {FLAGS}, {comp_sql('flags')}, {KEPT}, {OBJ}, e AS (SELECT count(DISTINCT (row, col)) * 0.036864 AS ha FROM det)
SELECT 'g' AS unit, count(*) AS n_objects, {s6('sum(n_cells) * 0.036864', 'detected_ha')}, count(*) FILTER (t = 2) AS no_follow_up, {s6('coalesce(sum(n_cells) FILTER (t = 2), 0) * 0.036864', 'no_follow_up_ha')}, {s6('any_value(ha)', 'ever_detected_ha')} FROM onum, e""",
)
def run_totals(spark, sf):
    cells, objects, _years = detection(spark, sf)
    t = R.run_totals(cells, objects, 0.036864)
    return t.select("unit", "n_objects", "no_follow_up", *[r6(c).alias(c) for c in ("detected_ha", "no_follow_up_ha", "ever_detected_ha")])


@query(
    "absent_files",
    """WITH w AS (SELECT 'c' || o_orderkey || '_' || p || '.tif' AS file FROM orders, (SELECT unnest(['naip', 'change', 'aux', 'agent']) AS p) q),
h AS (SELECT 'c' || o_orderkey || '_' || (['naip', 'change', 'aux'])[CAST(o_custkey % 3 + 1 AS INTEGER)] || '.tif' AS file FROM orders) SELECT file FROM w WHERE file NOT IN (SELECT file FROM h)""",
)
def absent_files(spark, sf):
    chip = F.concat(F.lit("c"), "o_orderkey")
    o = table(spark, sf, "orders")
    part = F.element_at(F.array(*[F.lit(p) for p in ("naip", "change", "aux")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    return L.absent_files(o.select(chip.alias("chip_id")), o.select(F.concat(chip, F.lit("_"), part, F.lit(".tif")).alias("file")))


@query(
    "window_labels",
    f"WITH {REASON} SELECT k, res.r AS row, res.c AS col, reason, CAST(least(100, greatest(0, round_even(prob * 100, 0))) AS INTEGER) AS percent FROM res JOIN px USING (k, r, c)",
)
def window_labels(spark, sf):
    w = L.window_labels(label_pixels(spark, sf), label_parts(spark, sf), SMALL_RULE)
    return w.select("k", "row", "col", "reason", F.col("percent").cast("int").alias("percent"))


@query("standardized_scene", f"""WITH {YGRID}, m AS (SELECT t, median(chm_height) AS c FROM yg WHERE forest GROUP BY t), d AS (SELECT t, median(abs(chm_height - c)) * 1.4826 AS s FROM yg JOIN m USING (t) WHERE forest GROUP BY t)
SELECT t, row, col, {s6('(chm_height - c) / s', 'z')} FROM yg JOIN m USING (t) JOIN d USING (t)""")
def standardized_scene(spark, sf):
    from sylvaflow.operators.null_model import standardize

    return standardize(years_grid(spark, sf).drop("z"), "chm_height", "forest", "scene", 9).select("t", "row", "col", r6("z").alias("z"))
