"""Queries on scalar functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions import scalars as C
from sylvaflow.functions.columns import r6, random_key
from sylvaflow.operators import screens as R
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.stand_ins import SPARSE, sparse_cells, table


def s8(expression: str, name: str) -> str:
    """Digital numbers scale to seven decimals, so these are compared at eight."""
    return f"round(CAST({expression} AS DOUBLE), 8) + 0.0 AS {name}"


def bands(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("red"), (F.col("l_extendedprice") % 101).alias("nir"),
        (F.col("l_partkey") % 50).alias("swir1"), (F.col("l_suppkey") % 50).alias("swir2"),
    )


@query(
    "spectral_indices",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS red, l_extendedprice % 101 AS nir, (l_partkey % 50)::DOUBLE AS swir1, (l_suppkey % 50)::DOUBLE AS swir2 FROM lineitem)
SELECT l_orderkey, l_linenumber, {s6('(nir - red) / nullif(nir + red, 0)', 'ndvi')}, {s6('(nir - swir2) / nullif(nir + swir2, 0)', 'nbr')}, {s6('(nir - swir1) / nullif(nir + swir1, 0)', 'ndmi')} FROM b""",
)
def spectral_indices(spark, sf):
    x = C.compute_indices(bands(spark, sf), ["ndvi", "nbr", "ndmi"])
    return x.select("l_orderkey", "l_linenumber", *[r6(n).alias(n) for n in ("ndvi", "nbr", "ndmi")])


def sensor_pixels(spark, sf):
    line = table(spark, sf, "lineitem")
    sensor = F.element_at(F.array(*[F.lit(s[0]) for s in P.SENSORS]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    dn = [(7000 + (F.col("l_partkey") * i + F.col("l_orderkey")) % 38000).cast("int").alias(f"sr_b{i}") for i in range(1, 8)]
    return line.select("l_orderkey", "l_linenumber", sensor.alias("sensor"), (F.col("l_suppkey") % 5 * 64 + F.col("l_linenumber") % 2).cast("int").alias("qa"),
                       (F.col("l_partkey") % 3).cast("int").alias("radsat"), *dn)


@query(
    "sensor_pixels",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, 'L' || ([4, 5, 7, 8, 9])[l_linenumber % 5 + 1] AS sensor, l_suppkey % 5 * 64 + l_linenumber % 2 AS qa, CAST(l_partkey % 3 AS INTEGER) AS radsat,
  list_transform([1, 2, 3, 4, 5, 6, 7], lambda i: (7000 + (l_partkey * i + l_orderkey) % 38000) * 2.75e-05::DOUBLE - 0.2) AS sr FROM lineitem),
n AS (SELECT *, sensor IN ('L8', 'L9') AS oli FROM b),
h AS (SELECT *, sr[CASE WHEN oli THEN 4 ELSE 3 END] AS red, sr[CASE WHEN oli THEN 5 ELSE 4 END] AS nir, sr[CASE WHEN oli THEN 6 ELSE 5 END] AS swir1, sr[7] AS swir2,
      (radsat & CASE WHEN oli THEN 120 ELSE 92 END) = 0 AND (qa & 63) = 0 AND ((qa >> 8) & 3) < 2 AS clear FROM n)
SELECT l_orderkey, l_linenumber, sensor, {', '.join(s8(f'CASE WHEN clear AND least(red, nir, swir1, swir2) >= 0 AND greatest(red, nir, swir1, swir2) <= 1 THEN {b} END', b) for b in ('red', 'nir', 'swir1', 'swir2'))} FROM h""",
)
def sensor_pixel_query(spark, sf):
    x = C.prepare_pixels(sensor_pixels(spark, sf), spark, medium_confidence=True)
    return x.select("l_orderkey", "l_linenumber", "sensor", *[F.round(n, 8).alias(n) for n in ("red", "nir", "swir1", "swir2")])


@query(
    "active_sensors",
    """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) + o_orderkey % 30 AS INTEGER) AS year FROM orders),
s(n, a, b) AS (VALUES ('L4', 1982, 1993), ('L5', 1984, 2012), ('L7', 1999, 2024), ('L8', 2013, 9999), ('L9', 2021, 9999))
SELECT year, string_agg(n, ',' ORDER BY n) AS sensors FROM y JOIN s ON year BETWEEN a AND b GROUP BY year""",
)
def active_sensors(spark, sf):
    y = table(spark, sf, "orders").select((F.year("o_orderdate") + F.col("o_orderkey") % 30).cast("int").alias("year")).distinct()
    return C.active_sensors(y, spark)


@query(
    "collection_order",
    """WITH s(n, a, b) AS (VALUES ('L4', 1982, 1993), ('L5', 1984, 2012), ('L7', 1999, 2024), ('L8', 2013, 9999), ('L9', 2021, 9999)),
o AS (SELECT o_orderkey AS scene, ([ 'L4', 'L5', 'L7', 'L8', 'L9'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] AS sensor, o_orderdate AS t, o_totalprice % 100 AS cloud FROM orders)
SELECT scene, sensor, row_number() OVER (PARTITION BY strftime(t, '%Y-%m') ORDER BY t, scene) AS position FROM o JOIN s ON o.sensor = s.n
WHERE a <= 1999 AND b >= 1996 AND t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '2000-01-01' AND cloud < 80""",
)
def collection_order(spark, sf):
    o = table(spark, sf, "orders")
    sensor = F.element_at(F.array(*[F.lit(s[0]) for s in P.SENSORS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    scenes = o.select(F.col("o_orderkey").alias("scene"), sensor.alias("sensor"), F.col("o_orderdate").alias("time"), (F.col("o_totalprice") % 100).alias("cloud"))
    return R.collection(scenes, "1996-01-01", "2000-01-01", [s[0] for s in P.SENSORS]).select("scene", "sensor", "position")


@query(
    "cover_classes",
    f"""WITH r(code, lo, hi) AS (VALUES (0, 0.0, 0.01), (1, 0.01, 0.05), (2, 0.05, 0.1), (3, 0.1, 0.2), (4, 0.2, 0.4), (5, 0.4, 0.6), (6, 0.6, 0.8), (7, 0.8, 1.0))
SELECT p_partkey, {s6('lo', 'lo')}, {s6('hi', 'hi')}, {s6('(lo + hi) / 2', 'mid')},
  CASE CASE WHEN p_size % 7 = 0 THEN 999 ELSE 100 + p_partkey % 50 END WHEN 999 THEN 'Non-disturbance' ELSE
  CASE (100 + p_partkey % 50) // 10 * 10 WHEN 110 THEN 'Fire' WHEN 120 THEN 'Harvest' WHEN 130 THEN 'Weather' WHEN 140 THEN 'Mining' ELSE 'Unknown' END END AS dist_group
FROM part LEFT JOIN r ON code = p_size % 10""",
)
def cover_classes(spark, sf):
    p = table(spark, sf, "part")
    lo, hi, mid = C.cover_bounds(F.col("p_size") % 10)
    code = F.when(F.col("p_size") % 7 == 0, 999).otherwise(100 + F.col("p_partkey") % 50)
    return p.select("p_partkey", r6(lo).alias("lo"), r6(hi).alias("hi"), r6(mid).alias("mid"), C.disturbance_group(code).alias("dist_group"))


@query(
    "place_codes",
    r"""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE lower(c_mktsegment) || ([ 'NE', 'SW', '', 'N', 'WESN'])[CAST(c_custkey % 5 + 1 AS INTEGER)] END AS name FROM customer)
SELECT c_custkey, upper(left(regexp_replace(coalesce(name, 'UNK'), '[NSEW]*$', ''), 3) || regexp_extract(coalesce(name, 'UNK'), '([NSEW]*)$', 1)) AS code FROM n""",
)
def place_codes(spark, sf):
    c = table(spark, sf, "customer")
    name = F.concat(F.lower("c_mktsegment"), F.element_at(F.array(*[F.lit(x) for x in ("NE", "SW", "", "N", "WESN")]), (F.col("c_custkey") % 5 + 1).cast("int")))
    return c.select("c_custkey", C.place_code(F.when(F.col("c_custkey") % 11 != 0, name)).alias("code"))


@query(
    "quad_grid",
    f"""WITH p AS (SELECT o_orderkey, -(60 + o_totalprice % 60) AS lon, 20 + o_totalprice % 31 AS lat FROM orders),
q AS (SELECT *, floor(lat) AS lat0, floor(-lon) AS lon0 FROM p),
c AS (SELECT *, least(floor((lat0 + 1 - lat) / 0.125), 7) AS r, least(floor((lon + lon0 + 1) / 0.125), 7) AS k FROM q),
b AS (SELECT *, lat0 + 1 - r * 0.125 AS north, -(lon0 + 1) + k * 0.125 AS west FROM c)
SELECT o_orderkey, printf('q%02d%03d%02d', CAST(lat0 AS INTEGER), CAST(lon0 AS INTEGER), CAST(r * 8 + k + 1 AS INTEGER)) AS quad,
  {s6('west', 'west')}, {s6('north - 0.125', 'south')}, {s6('west + 0.0625', 'q_west')}, {s6('north', 'q_north')},
  {s6('lon - 2.5 / (111.32 * cos(radians(lat)))', 'box_west')}, {s6('lat + 2.5 / 111.32', 'box_north')} FROM b""",
)
def quad_grid(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (-(60 + F.col("o_totalprice") % 60)).alias("lon"), (20 + F.col("o_totalprice") % 31).alias("lat"))
    o = o.withColumn("quad", C.quad_id(F.col("lon"), F.col("lat")))
    b, q = C.quad_bounds(F.col("quad")), C.quad_bounds(F.col("quad"), F.lit("ne"))
    box = C.point_bounds(F.col("lon"), F.col("lat"), F.lit(2.5))
    return o.select("o_orderkey", "quad", r6(b["west"]).alias("west"), r6(b["south"]).alias("south"), r6(q["west"]).alias("q_west"), r6(q["north"]).alias("q_north"),
                    r6(box["west"]).alias("box_west"), r6(box["north"]).alias("box_north"))


@query(
    "chip_windows",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS lo, l_extendedprice + l_quantity * 40 AS hi FROM lineitem),
s AS (SELECT *, CAST(floor((lo - 19.2) / 307.2) AS BIGINT) AS f, CAST(floor((hi + 19.2) / 307.2) AS BIGINT) AS l, CAST(floor((lo + hi) / 2 / 307.2) AS BIGINT) - 1 AS st FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN l - f + 1 > 3 THEN least(greatest(st, f), l - 2) ELSE f END AS first_chip, CASE WHEN l - f + 1 > 3 THEN 3 ELSE l - f + 1 END AS n_chips,
  CAST(floor(((l_orderkey % 5000) + 0.5) * 0.6 / 19.2) AS BIGINT) AS coarse FROM s""",
)
def chip_windows(spark, sf):
    line = table(spark, sf, "lineitem")
    w = C.chip_window(F.col("l_extendedprice"), F.col("l_extendedprice") + F.col("l_quantity") * 40)
    return line.select("l_orderkey", "l_linenumber", w["first"].alias("first_chip"), w["count"].cast("long").alias("n_chips"), C.coarse_cell(F.col("l_orderkey") % 5000, 0.6, 0.0, 19.2).alias("coarse"))


@query(
    "window_of_point",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey % 1000 AS x, l_partkey % 1000 AS y FROM lineitem),
w AS (SELECT *, CAST(floor((x - 100) / 30.0) AS INTEGER) AS c, CAST(floor((900 - y) / 30.0) AS INTEGER) AS r FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN c BETWEEN 0 AND 24 AND r BETWEEN 0 AND 19 THEN r ELSE -1 END AS wr, CASE WHEN c BETWEEN 0 AND 24 AND r BETWEEN 0 AND 19 THEN c ELSE -1 END AS wc FROM w""",
)
def window_of_point(spark, sf):
    from sylvaflow.operators.zones import window_of_point as place

    line = table(spark, sf, "lineitem")
    rc = place((F.col("l_orderkey") % 1000).cast("double"), (F.col("l_partkey") % 1000).cast("double"), (100.0, 900.0), 30.0, (20, 25))
    return line.select("l_orderkey", "l_linenumber", rc["row"].alias("wr"), rc["col"].alias("wc"))


@query(
    "date_chunks",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), m AS (SELECT y, make_date(y, CAST(k AS BIGINT), 1::BIGINT) AS d FROM y, (SELECT unnest(generate_series(1, 12)) AS k) g)
SELECT strftime(d, '%Y-%m') AS label, strftime(d, '%Y-%m-%d') AS "start", strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS "end" FROM m
UNION ALL SELECT y || 'H' || h, strftime(make_date(y, CAST(h * 6 - 5 AS BIGINT), 1::BIGINT), '%Y-%m-%d'), strftime(make_date(y, CAST(h * 6 - 5 AS BIGINT), 1::BIGINT) + INTERVAL 6 MONTH, '%Y-%m-%d') FROM y, (SELECT unnest([1, 2]) AS h) g
UNION ALL SELECT CAST(y AS VARCHAR), y || '-01-01', (y + 1) || '-01-01' FROM y""",
)
def date_chunks(spark, sf):
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    out = C.explode_chunks(years, 1)
    return out.unionByName(C.explode_chunks(years, 6)).unionByName(C.explode_chunks(years, 12))


@query(
    "season_gaps",
    """WITH d AS (SELECT o_custkey % 100 AS site, year(o_orderdate) AS y, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY ALL),
g AS (SELECT site, y, d, lag(y) OVER w AS y0, lag(d) OVER w AS d0 FROM d WINDOW w AS (PARTITION BY site ORDER BY y))
SELECT site, y0 || '-' || y AS interval, abs(dayofyear(d) - dayofyear(d0)) AS gap_days, month(d) < 5 OR month(d) > 9 AS off_season FROM g WHERE abs(dayofyear(d) - dayofyear(d0)) > 42""",
)
def season_gaps(spark, sf):
    o = table(spark, sf, "orders")
    images = o.select((F.col("o_custkey") % 100).alias("site"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("date"))
    return R.season_gaps(images, ["site"]).select("site", "interval", F.col("gap_days").cast("long").alias("gap_days"), "off_season")


@query(
    "item_names",
    """WITH n AS (SELECT o_orderkey, ['m', lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0'), (['nw', 'ne', 'sw', 'se', 'xx'])[CAST(o_orderkey % 5 + 1 AS INTEGER)], '16',
  (['1', '060', '.6', '30', '030'])[CAST(o_orderkey // 5 % 5 + 1 AS INTEGER)], strftime(o_orderdate, '%Y%m%d')] AS t, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT o_orderkey, CASE WHEN t[3] <> 'xx' THEN t[2] END AS quad, CASE WHEN t[3] <> 'xx' THEN t[3] END AS quarter, CASE WHEN t[3] <> 'xx' THEN d END AS date,
  CASE WHEN t[3] <> 'xx' THEN CASE t[5] WHEN '1' THEN 1.0::DOUBLE WHEN '060' THEN 0.6::DOUBLE WHEN '.6' THEN 0.6::DOUBLE WHEN '030' THEN 0.3::DOUBLE END END AS gsd, d AS acquired FROM n""",
)
def item_names(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    base = F.concat(F.lit("m_"), F.lpad((k % 10000000).cast("string"), 7, "0"), F.lit("_"), pick("nw", "ne", "sw", "se", "xx"), F.lit("_16_"), F.element_at(F.array(*[F.lit(x) for x in ("1", "060", ".6", "30", "030")]), (F.floor(k / 5) % 5 + 1).cast("int")), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"))
    item = C.parse_item(base)
    return o.select("o_orderkey", item["quad"].alias("quad"), item["quarter"].alias("quarter"), F.date_format(item["date"], "yyyy-MM-dd").alias("date"), item["gsd"].alias("gsd"),
                    F.date_format(C.acquisition_date(F.concat(F.lit("x/"), base)), "yyyy-MM-dd").alias("acquired"))


@query(
    "interval_timing",
    """WITH t AS (SELECT o_orderkey, (year(o_orderdate) - 1) || '-' || year(o_orderdate) AS det, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN 'unsure' WHEN o_orderkey % 9 = 2 THEN 'bad' ELSE (1995 + o_orderkey % 4) || '-' || (1996 + o_orderkey % 5) END AS ref FROM orders),
p AS (SELECT *, TRY_CAST(split_part(det, '-', 2) AS INTEGER) AS d, TRY_CAST(split_part(ref, '-', 2) AS INTEGER) AS r FROM t)
SELECT o_orderkey, det AS label, CASE WHEN r IS NULL THEN 'unsure' WHEN d = r THEN 'match' WHEN d > r THEN 'detected_late' ELSE 'detected_early' END AS timing FROM p""",
)
def interval_timing(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    det = C.interval_label(F.year("o_orderdate") - 1, F.year("o_orderdate"))
    ref = F.when(k % 9 == 0, None).when(k % 9 == 1, "unsure").when(k % 9 == 2, "bad").otherwise(C.interval_label(1995 + k % 4, 1996 + k % 5))
    return o.select("o_orderkey", det.alias("label"), C.interval_timing(det, ref).alias("timing"))


KEY12 = "CAST(('0x' || substr(sha256('{seed}:' || {name}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query(
    "random_keys",
    f"SELECT s_suppkey, {s6(KEY12.format(seed=7, name='s_name'), 'key')}, substr(sha256('7:' || s_name), 1, 10) AS digest FROM supplier",
)
def random_keys(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", r6(random_key(7, F.col("s_name"))).alias("key"), F.substring(F.sha2(F.concat(F.lit("7:"), "s_name"), 256), 1, 10).alias("digest"))


@query(
    "sub_strata",
    """SELECT o_orderkey, concat_ws('-', CASE WHEN year(o_orderdate) = 2001 THEN 'last' ELSE 'earlier' END, CASE WHEN o_totalprice % 1 >= 0.9 THEN 'high' ELSE 'low' END,
  CASE WHEN o_totalprice % 9 >= 5 THEN 'large' WHEN o_totalprice % 9 >= 1 THEN 'medium' ELSE 'small' END) AS sub,
  CASE WHEN o_orderstatus = 'F' THEN 'accepted_' || CASE WHEN o_custkey % 6 IN (1, 2) THEN 'diffuse' ELSE 'other' END || '_' || coalesce((['harvest', 'wind', NULL])[CAST(o_custkey % 3 + 1 AS INTEGER)], 'mixed') ELSE o_orderstatus END AS audit_sub FROM orders""",
)
def sub_strata(spark, sf):
    o, c = table(spark, sf, "orders"), F.col("o_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("clearcut", "thinning", "wind", "fire", "mining", "flood")]), (c % 6 + 1).cast("int"))
    agent = F.when(c % 3 == 0, "harvest").when(c % 3 == 1, "wind")
    stratum = F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("other")
    sub = C.sub_stratum(F.year("o_orderdate").cast("string"), F.lit("2001"), F.col("o_totalprice") % 1, F.col("o_totalprice") % 9)
    return o.select("o_orderkey", sub.alias("sub"), C.audit_sub_stratum(stratum, F.col("o_orderstatus"), kind, agent).alias("audit_sub"))


def _when(items, default):
    return "CASE " + " ".join(f"WHEN r = {k} THEN {v}" for k, v in items) + f" ELSE {default} END"


@query(
    "reason_labels",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, (l_partkey + l_linenumber) % 44 AS r FROM lineitem)
SELECT r, count(*) AS n, {_when([(P.REASONS[n], v) for n, v in P.POLICY.items()], 255)} AS change,
  {_when([(P.REASONS[n], f"'{g}'") for g, ns in P.REASON_GROUPS.items() for n in ns], 'NULL')} AS reason_group FROM x GROUP BY r""",
)
def reason_labels(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(((F.col("l_partkey") + F.col("l_linenumber")) % 44).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return x.select("r", "n", C.change_label(F.col("r")).alias("change"), C.reason_group(F.col("r")).alias("reason_group"))


@query(
    "cover_series",
    """WITH s AS (SELECT p_partkey AS stand_id, 1990 + p_size AS y1, p_size % 10 AS t1, CASE WHEN p_size % 5 = 0 THEN 9999 ELSE 2000 + p_size END AS y2, p_partkey % 10 AS t2 FROM part),
l AS (SELECT stand_id, 'pre' AS which, y1 AS y, t1 AS t FROM s UNION ALL SELECT stand_id, 'post', y2, t2 FROM s),
r(code, lo, hi) AS (VALUES (0, 0.0, 0.01), (1, 0.01, 0.05), (2, 0.05, 0.1), (3, 0.1, 0.2), (4, 0.2, 0.4), (5, 0.4, 0.6), (6, 0.6, 0.8), (7, 0.8, 1.0))
SELECT stand_id, which, nullif(y, 9999) AS year, t AS tree_class, round(lo::DOUBLE, 6) AS tree_lo, round(hi::DOUBLE, 6) AS tree_hi FROM l LEFT JOIN r ON code = t""",
)
def cover_series(spark, sf):
    s = table(spark, sf, "part").select(
        F.col("p_partkey").alias("stand_id"), (1990 + F.col("p_size")).alias("y1"), (F.col("p_size") % 10).cast("long").alias("t1"),
        F.when(F.col("p_size") % 5 == 0, 9999).otherwise(2000 + F.col("p_size")).alias("y2"), (F.col("p_partkey") % 10).alias("t2"),
    )
    out = R.cover_series(s, [("pre", "y1", "t1"), ("post", "y2", "t2")])
    return out.select("stand_id", "which", "year", "tree_class", r6("tree_lo").alias("tree_lo"), r6("tree_hi").alias("tree_hi"))


@query(
    "allometry",
    f"SELECT l_orderkey, l_linenumber, {s6('3.09632 + 0.00895 * l_quantity * l_quantity', 'width')}, {s6('2 * (3.09632 + 0.00895 * l_quantity * l_quantity)', 'open_width')} FROM lineitem",
)
def allometry(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(C.popescu_width(q)).alias("width"), r6(C.open_grown_width(q)).alias("open_width"))


@query(
    "encodings",
    """WITH v AS (SELECT unit, year, row, col, chm_height AS h, probability AS p, (chm_height - 6) * 40.003 AS z, CASE WHEN row % 5 = 0 THEN -1 WHEN row % 5 = 1 THEN 0 ELSE year END AS y FROM sparse)
SELECT unit, year, row, col, CAST(greatest(-32767, least(32767, round_even(z * 100, 0))) AS INTEGER) AS z_code, round(greatest(-32767, least(32767, round_even(z * 100, 0))) / 100, 6) + 0.0 AS z_back,
  CASE WHEN y < 0 THEN 255 WHEN y > 0 THEN greatest(1, least(254, y - 2000)) ELSE 0 END AS onset_code, CAST(greatest(0, least(254, round_even(h / 0.25, 0))) AS INTEGER) AS h_code,
  CAST(greatest(0, least(100, round_even(p * 100, 0))) AS INTEGER) AS percent,
  CASE WHEN greatest(0, least(100, round_even(p * 100, 0))) >= 50 THEN CAST(row % 6 + 1 AS INTEGER) ELSE 0 END AS agent, CAST(floor(greatest(0, least(1, h / 20)) * 255 + 0.5) AS INTEGER) AS byte FROM v""".replace("FROM sparse)", "FROM sparse)").replace("WITH v", f"WITH {SPARSE}, v"),
)
def encodings(spark, sf):
    h, p, row = F.col("chm_height"), F.col("probability"), F.col("row")
    z = (h - 6) * 40.003
    y = F.when(row % 5 == 0, -1).when(row % 5 == 1, 0).otherwise(F.col("year"))
    return sparse_cells(spark, sf).select(
        "unit", "year", "row", "col", C.encode_z(z).cast("int").alias("z_code"), r6(C.quantize_z(z)).alias("z_back"), C.encode_onset(y).alias("onset_code"),
        C.encode_height(h).alias("h_code"), C.to_percent(p).alias("percent"), C.flagged_code(row % 6 + 1, C.to_percent(p), 0.5).alias("agent"), C.to_uint8(h, F.lit(0.0), F.lit(20.0)).alias("byte"),
    )


@query(
    "peak_probability",
    f"WITH {SPARSE} SELECT unit, row, col, CAST(round_even(least(1, max(probability)) * 100, 0) AS INTEGER) AS peak FROM sparse GROUP BY ALL",
)
def peak_probability(spark, sf):
    return sparse_cells(spark, sf).groupBy("unit", "row", "col").agg(C.encode_peak(F.col("probability")).alias("peak"))


@query(
    "pair_targets",
    """WITH x AS (SELECT CASE l_linenumber % 4 WHEN 3 THEN 255 ELSE l_linenumber % 4 END AS c, l_partkey % 2 = 0 AS a, l_suppkey % 2 = 0 AS b FROM lineitem)
SELECT c, a, b, CASE WHEN c = 255 THEN 255 WHEN c > 0 THEN 1 ELSE 0 END AS target, CASE WHEN NOT a AND b THEN 255 WHEN c = 255 THEN 255 ELSE 0 END AS reversed, count(*) AS n FROM x GROUP BY ALL""",
)
def pair_targets(spark, sf):
    m = F.col("l_linenumber") % 4
    x = table(spark, sf, "lineitem").select(F.when(m == 3, 255).otherwise(m).alias("c"), (F.col("l_partkey") % 2 == 0).alias("a"), (F.col("l_suppkey") % 2 == 0).alias("b"))
    c, a, b = F.col("c"), F.col("a"), F.col("b")
    x = x.select("*", C.pair_target(c, a, b).alias("target"), C.pair_target(c, a, b, True).alias("reversed"))
    return x.groupBy("c", "a", "b", "target", "reversed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "soil_variables",
    """SELECT p_partkey % 64 AS row, p_partkey // 64 AS col, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 0 END AS parmat_kind, 0 AS texture_class, p_retailprice AS awc_total_cm, CAST(NULL AS DOUBLE) AS hydric_pct FROM part""",
)
def soil_variables(spark, sf):
    p = table(spark, sf, "part")
    cells = p.select((F.col("p_partkey") % 64).alias("row"), F.floor(F.col("p_partkey") / 64).alias("col"), "p_type", "p_retailprice")
    layers = {
        "parmat_kind": cells.select("row", "col", C.soil_code(F.col("p_type"), {"unknown": 0, "ECONOMY": 1, "STANDARD": 2}).alias("value")),
        "awc_total_cm": cells.select("row", "col", F.col("p_retailprice").alias("value")),
    }
    return R.stack_variables(layers, {"parmat_kind": "code", "texture_class": "code", "awc_total_cm": "number", "hydric_pct": "number"})


@query(
    "stand_screen",
    """WITH y AS (SELECT array_agg(DISTINCT year(o_orderdate)) AS years FROM orders),
s AS (SELECT p_partkey AS stand_id, p_retailprice * 30 / 4046.856 AS acres, 1994 + p_size % 8 AS last_pre, 1995 + p_size % 9 AS first_post, p_size % 3 = 1 AS inside, p_size % 4 = 0 AS single FROM part),
c AS (SELECT *, len(list_filter(years, lambda v: v <= last_pre)) AS n_pre, len(list_filter(years, lambda v: v >= first_post)) AS n_post FROM s, y)
SELECT stand_id, n_pre, n_post, n_pre >= 1 AND n_post >= 3 AND acres >= 8 AND inside AND single AS passes,
  concat_ws('; ', CASE WHEN n_pre < 1 THEN 'has_pre_date' END, CASE WHEN n_post < 3 THEN 'enough_post_dates' END, CASE WHEN acres < 8 THEN 'large_enough' END, CASE WHEN NOT inside THEN 'complete_footprint' END, CASE WHEN NOT single THEN 'single_event' END) AS fails FROM c""",
)
def stand_screen(spark, sf):
    p = table(spark, sf, "part")
    stands = p.select(F.col("p_partkey").alias("stand_id"), (F.col("p_retailprice") * 30).alias("area_m2"), (1994 + F.col("p_size") % 8).alias("last_pre"), (1995 + F.col("p_size") % 9).alias("first_post"),
                      (F.col("p_size") % 3 == 1).alias("complete"), (F.col("p_size") % 4 == 0).alias("single"))
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct().agg(F.array_sort(F.collect_list("y"))).scalar()
    s = R.screen_stands(stands, years, min_post_dates=3, min_acres=8.0)
    return s.select("stand_id", "n_pre", "n_post", "passes", "fails")


@query(
    "year_plan",
    """WITH c AS (SELECT year(o_orderdate) + o_custkey % 4 AS y, avg(CASE WHEN o_orderpriority < '3' THEN 1.0 ELSE 0.0 END) * 1.6 AS a, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 1.45 AS b FROM orders GROUP BY 1)
SELECT y AS year, CASE WHEN a >= 0.64 THEN 'first' WHEN b >= 0.64 THEN 'second' END AS source, CASE WHEN a < 0.64 AND b < 0.64 THEN printf('covers %.0f%% of the box (< 64%%)', greatest(a, b) * 100) END AS skipped FROM c""",
)
def year_plan(spark, sf):
    o = table(spark, sf, "orders")
    year = F.year("o_orderdate") + F.col("o_custkey") % 4
    c = o.groupBy(year.alias("year")).agg((F.avg((F.col("o_orderpriority") < "3").cast("double")) * 1.6).alias("a"), (F.avg((F.col("o_orderstatus") == "F").cast("double")) * 1.45).alias("b"))
    return R.plan_years(c.select("year", F.col("a").alias("coverage")), c.select("year", F.col("b").alias("coverage")), min_coverage=0.64).select("year", "source", "skipped")


@query(
    "decision_filters",
    f"""WITH t AS (SELECT p_size, p_brand, avg(p_retailprice) % 200 AS density_per_ha, avg(p_partkey) % 0.2 AS capped_fraction, (count(*) % 7) / 7.0 AS assigned_fraction, sum(p_retailprice) % 1 AS allo_slope, avg(p_partkey) % 13 AS allo_rmse FROM part GROUP BY ALL),
f AS (SELECT *, NOT density_per_ha BETWEEN 75 AND 200 AS f1, NOT capped_fraction BETWEEN 0 AND 0.1 AS f2, NOT assigned_fraction BETWEEN 0.6 AND 0.95 AS f3, NOT allo_slope >= 0.05 AS f4 FROM t)
SELECT p_size, p_brand, f1 AS fail_density_per_ha, f2 AS fail_capped_fraction, f3 AS fail_assigned_fraction, f4 AS fail_allo_slope, NOT (f1 OR f2 OR f3 OR f4) AS passes,
  CASE WHEN NOT (f1 OR f2 OR f3 OR f4) THEN rank() OVER (PARTITION BY NOT (f1 OR f2 OR f3 OR f4) ORDER BY round(allo_rmse, 6)) END AS rank FROM f""",
)
def decision_filters(spark, sf):
    p = table(spark, sf, "part")
    t = p.groupBy("p_size", "p_brand").agg(
        (F.avg("p_retailprice") % 200).alias("density_per_ha"), (F.avg("p_partkey") % 0.2).alias("capped_fraction"), (F.count(F.lit(1)) % 7 / 7.0).alias("assigned_fraction"),
        (F.sum("p_retailprice") % 1).alias("allo_slope"), F.round(F.avg("p_partkey") % 13, 6).alias("allo_rmse"),
    )
    d = R.decision_filters(t, P.HARD_FILTERS, "allo_rmse")
    return d.select("p_size", "p_brand", *[f"fail_{c}" for c in P.HARD_FILTERS], "passes", "rank")

