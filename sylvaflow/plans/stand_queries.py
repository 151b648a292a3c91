"""Queries on stands: structure metrics, change, stages and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.functions.columns import r6
from sylvaflow.operators import observations as O
from sylvaflow.operators import stages as S
from sylvaflow.operators import zones as Z
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.observation_queries import ANNUAL, HARMONIC, LEVEL, TREND
from sylvaflow.plans.stand_ins import OBS, PIXELS, observations, stand_pixels, table

KEY = ["stand_id", "year"]
PIXEL_METRICS = """
  count(height) AS n_valid,
  avg(CASE WHEN height < 2 THEN 1.0 WHEN height IS NOT NULL THEN 0.0 END) AS gap_fraction,
  avg(CASE WHEN height >= 2 THEN 1.0 WHEN height IS NOT NULL THEN 0.0 END) AS crown_fraction,
  avg(CASE WHEN height >= 0.5 AND height < 2 THEN 1.0 WHEN height IS NOT NULL THEN 0.0 END) AS shrub_fraction,
  avg(CASE WHEN height >= 2 AND height < 10 THEN 1.0 WHEN height IS NOT NULL THEN 0.0 END) AS small_tree_fraction,
  avg(CASE WHEN height >= 10 AND height < 20 THEN 1.0 WHEN height IS NOT NULL THEN 0.0 END) AS mid_canopy_fraction,
  avg(CASE WHEN height >= 20 AND height < 100 THEN 1.0 WHEN height IS NOT NULL THEN 0.0 END) AS tall_canopy_fraction"""
HEIGHTS = f"""heights AS (
  SELECT stand_id, year, {PIXEL_METRICS}, 1 - count(height) / count(*)::DOUBLE AS nodata_fraction,
    CASE WHEN count(*) FILTER (height >= 2) >= 10 THEN avg(height) FILTER (height >= 2) END AS height_mean,
    CASE WHEN count(*) FILTER (height >= 2) >= 10 THEN quantile_cont(height, 0.5) FILTER (height >= 2) END AS height_median,
    CASE WHEN count(*) FILTER (height >= 2) >= 10 THEN quantile_cont(height, 0.9) FILTER (height >= 2) END AS height_p90,
    CASE WHEN count(*) FILTER (height >= 2) >= 10 THEN max(height) FILTER (height >= 2) END AS height_max,
    CASE WHEN count(*) FILTER (height >= 2) >= 10 THEN stddev_pop(height) FILTER (height >= 2) / avg(height) FILTER (height >= 2) END AS height_cv
  FROM pixels GROUP BY stand_id, year)"""
SHARES = [*P.HEIGHT_BANDS, "gap_fraction", "crown_fraction"]
STATS = ["nodata_fraction", "height_mean", "height_median", "height_p90", "height_max", "height_cv"]


@query(
    "stand_height_metrics",
    f"WITH {PIXELS}, {HEIGHTS} SELECT stand_id, year, n_valid, {', '.join(s6(c, c) for c in SHARES + STATS)} FROM heights",
)
def stand_height_metrics(spark, sf):
    m = Z.zone_pixel_metrics(stand_pixels(spark, sf), KEY)
    return m.select(*KEY, F.col("n_valid_pixels").alias("n_valid"), *[r6(c).alias(c) for c in SHARES + STATS])


@query(
    "stand_change",
    f"""WITH {PIXELS}, {HEIGHTS}
SELECT stand_id, year, {s6('gap_fraction - lag(gap_fraction) OVER w', 'd_gap_fraction')},
       {s6('height_p90 - lag(height_p90) OVER w', 'd_height_p90')}, CAST(NULL AS DOUBLE) AS d_crown_cv
FROM heights WINDOW w AS (PARTITION BY stand_id ORDER BY year)""",
)
def stand_change(spark, sf):
    m = Z.zone_pixel_metrics(stand_pixels(spark, sf), KEY)
    out = Z.add_change(m, ["gap_fraction", "height_p90", "crown_cv"])
    return out.select(*KEY, r6("d_gap_fraction").alias("d_gap_fraction"), r6("d_height_p90").alias("d_height_p90"), "d_crown_cv")


# Repeated cells: an 8 x 8 grid per stand, mean height of the pixels in a cell.
def stand_cells(spark, sf):
    p = stand_pixels(spark, sf).select(*KEY, (F.col("row") % 8).alias("row"), (F.col("col") % 8).alias("col"), "height")
    return p.groupBy(*KEY, "row", "col").agg((F.sum("height") / F.count("height") / 2.003).alias("height"))


CELLS = """scells AS (
  SELECT stand_id, year, row % 8 AS row, col % 8 AS col, sum(height) / count(height) / 2.003::DOUBLE AS height
  FROM pixels GROUP BY ALL)"""


@query(
    "gap_persistence",
    f"""WITH {PIXELS}, {CELLS},
link AS (SELECT stand_id, year, lag(year) OVER (PARTITION BY stand_id ORDER BY year) AS prev FROM (SELECT DISTINCT stand_id, year FROM scells) d)
SELECT a.stand_id, a.year,
       {s6('''count(*) FILTER (b.height IS NOT NULL AND a.height < 2 AND b.height < 2)
             / nullif(count(b.height), 0)::DOUBLE''', 'gap_persistence')}
FROM scells a JOIN link l ON a.stand_id = l.stand_id AND a.year = l.year AND l.prev IS NOT NULL
LEFT JOIN scells b ON b.stand_id = a.stand_id AND b.year = l.prev AND b.row = a.row AND b.col = a.col
WHERE a.height IS NOT NULL GROUP BY a.stand_id, a.year""",
)
def gap_persistence(spark, sf):
    return Z.gap_persistence(stand_cells(spark, sf)).select(*KEY, r6("gap_persistence").alias("gap_persistence"))


def crowns(spark, sf):
    line, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return line.join(o, line["l_orderkey"] == o["o_orderkey"]).select(
        (F.col("o_custkey") % 100).cast("string").alias("stand_id"), F.year("o_orderdate").alias("year"),
        (F.col("l_orderkey") % 1000).cast("double").alias("x"), (F.col("l_partkey") % 1000).cast("double").alias("y"),
        (1.0 + F.col("l_extendedprice") % 9).alias("crown_diam_m"), F.col("l_quantity").alias("apex_h_m"),
    )


CROWNS = """crowns AS (
  SELECT CAST(o_custkey % 100 AS VARCHAR) AS stand_id, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(l_orderkey % 1000 AS DOUBLE) AS x, CAST(l_partkey % 1000 AS DOUBLE) AS y,
         1.0 + l_extendedprice % 9 AS d, l_quantity AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CROWN_STATS = """cstats AS (
  SELECT stand_id, year, count(*) AS n_crowns, CASE WHEN count(*) >= 75 THEN stddev_pop(d) / avg(d) END AS crown_cv,
         CASE WHEN count(*) >= 75 THEN quantile_cont(d, 0.9) END AS crown_p90, CASE WHEN count(*) >= 75 THEN avg(d) END AS crown_mean,
         CASE WHEN count(*) >= 75 THEN median(d) END AS crown_median, CASE WHEN count(*) >= 75 THEN stddev_pop(d) END AS crown_std,
         CASE WHEN count(*) < 75 THEN 'n_crowns=' || count(*) || ' < min_crowns=75' END AS crown_reason
  FROM crowns GROUP BY stand_id, year)"""
CROWN_COLS = ["crown_cv", "crown_p90", "crown_mean", "crown_median", "crown_std"]


@query(
    "crown_stats",
    f"WITH {CROWNS}, {CROWN_STATS} SELECT stand_id, year, n_crowns, {', '.join(s6(c, c) for c in CROWN_COLS)}, crown_reason FROM cstats",
)
def crown_stats(spark, sf):
    c = Z.crown_stats(crowns(spark, sf), KEY)
    return c.select(*KEY, "n_crowns", *[r6(n).alias(n) for n in CROWN_COLS], "crown_reason")


@query(
    "stand_records",
    f"""WITH {PIXELS}, {HEIGHTS}, {CROWNS}, {CROWN_STATS}
SELECT h.stand_id, h.year, {s6('gap_fraction', 'gap_fraction')}, {s6('height_cv', 'height_cv')}, {s6('crown_cv', 'crown_cv')},
       concat_ws('; ', 'crown_cv: ' || crown_reason, 'crown_mean: ' || crown_reason, 'crown_p90: ' || crown_reason,
                 'edge_density: no spatial metrics supplied',
                 CASE WHEN lag(h.year) OVER (PARTITION BY h.stand_id ORDER BY h.year) IS NULL
                      THEN 'gap_persistence: first date of the series, nothing to compare to' END,
                 'glcm_texture: no image supplied', 'linearity_index: no spatial metrics supplied',
                 'row_directionality: no spatial metrics supplied') AS unavailable
FROM heights h LEFT JOIN cstats c ON c.stand_id = h.stand_id AND c.year = h.year""",
)
def stand_records(spark, sf):
    r = Z.stand_records(stand_pixels(spark, sf), crowns=crowns(spark, sf))
    return r.select(*KEY, *[r6(c).alias(c) for c in ("gap_fraction", "height_cv", "crown_cv")], "unavailable")


@query(
    "registered_metrics",
    f"WITH {PIXELS} SELECT stand_id, {s6('avg(CASE WHEN height < 2 THEN 1.0 ELSE 0.0 END)', 'gap_fraction')}, {s6('avg(CASE WHEN height >= 20 AND height < 100 THEN 1.0 ELSE 0.0 END)', 'tall_canopy_fraction')} FROM pixels WHERE height IS NOT NULL GROUP BY stand_id",
)
def registered_metrics(spark, sf):
    m = Z.registered_metrics(stand_pixels(spark, sf), ["stand_id"], ["gap_fraction", "tall_canopy_fraction"])
    return m.select("stand_id", r6("gap_fraction").alias("gap_fraction"), r6("tall_canopy_fraction").alias("tall_canopy_fraction"))


@query(
    "registered_deltas",
    f"""WITH {PIXELS}, {HEIGHTS}
SELECT stand_id, year, {s6('gap_fraction - lag(gap_fraction) OVER w', 'delta_gap_fraction')}, {s6('crown_fraction - lag(crown_fraction) OVER w', 'delta_crown_fraction')}
FROM heights WINDOW w AS (PARTITION BY stand_id ORDER BY year)""",
)
def registered_deltas(spark, sf):
    m = Z.registered_metrics(stand_pixels(spark, sf), KEY, ["gap_fraction", "crown_fraction"])
    names = ["delta_gap_fraction", "delta_crown_fraction"]
    return m.select(*KEY, *[r6(Z.DELTAS.build(n)).alias(n) for n in names])


YEARS = list(range(1995, 2002))


@query(
    "metric_matrix",
    f"""WITH {PIXELS}, {HEIGHTS},
long AS (SELECT stand_id, year, 'gap_fraction' AS metric, gap_fraction AS v FROM heights UNION ALL SELECT stand_id, year, 'height_cv', height_cv FROM heights)
SELECT stand_id, metric, {', '.join(s6(f'max(v) FILTER (year = {y})', f'"{y}"') for y in YEARS)} FROM long GROUP BY ALL""",
)
def metric_matrix(spark, sf):
    m = Z.zone_pixel_metrics(stand_pixels(spark, sf), KEY).select(*KEY, "gap_fraction", "height_cv")
    wide = Z.metric_matrix(m, ["gap_fraction", "height_cv"], YEARS)
    return wide.select("stand_id", "metric", *[r6(f"`{y}`").alias(str(y)) for y in YEARS])


# --- stage and trajectory --------------------------------------------------------
def joined(spark, sf):
    stand = Z.stand_records(stand_pixels(spark, sf), crowns=crowns(spark, sf))
    # The driver's heights give few canopy gaps, so the shares are stretched into the range of the envelopes.
    stand = stand.withColumns({"gap_fraction": F.col("gap_fraction") * 6, "shrub_fraction": F.col("shrub_fraction") * 3, "gap_persistence": F.lit(None).cast("double")})
    return Z.join_satellite(stand, O.annual_frame(observations(spark, sf)))


JOINED = f"""{OBS}, {LEVEL}, {HARMONIC}, {TREND}, {ANNUAL}, {PIXELS}, {HEIGHTS}, {CROWNS}, {CROWN_STATS},
joined AS (
  SELECT h.stand_id, h.year, h.gap_fraction * 6 AS gap_fraction, h.shrub_fraction * 3 AS shrub_fraction, h.crown_fraction, c.crown_cv,
         a.ndvi_mean, a.amplitude AS ndvi_seasonal_amplitude, a.slope AS ndvi_trend, a.why,
         concat_ws('; ', 'crown_cv: ' || crown_reason, 'crown_mean: ' || crown_reason, 'crown_p90: ' || crown_reason,
                 'edge_density: no spatial metrics supplied',
                 CASE WHEN lag(h.year) OVER (PARTITION BY h.stand_id ORDER BY h.year) IS NULL
                      THEN 'gap_persistence: first date of the series, nothing to compare to' END,
                 'glcm_texture: no image supplied', 'linearity_index: no spatial metrics supplied',
                 'row_directionality: no spatial metrics supplied', nullif(a.why, '')) AS unavailable
  FROM heights h LEFT JOIN cstats c ON c.stand_id = h.stand_id AND c.year = h.year
  LEFT JOIN annual a ON a.stand_id = h.stand_id AND a.year = h.year)"""


@query(
    "stand_satellite_join",
    f"""WITH {JOINED} SELECT stand_id, year, {s6('gap_fraction', 'gap_fraction')}, {s6('ndvi_mean', 'ndvi_mean')}, {s6('ndvi_seasonal_amplitude', 'ndvi_seasonal_amplitude')}, {s6('ndvi_trend', 'ndvi_trend')}, unavailable FROM joined""",
)
def stand_satellite_join(spark, sf):
    j = joined(spark, sf)
    return j.select(*KEY, *[r6(c).alias(c) for c in ("gap_fraction", "ndvi_mean", "ndvi_seasonal_amplitude", "ndvi_trend")], "unavailable")


STAGE_METRICS = ["gap_fraction", "crown_cv", "shrub_fraction", "ndvi_mean", "ndvi_seasonal_amplitude"]
_ENV = ",\n    ".join(
    f"('{s}', {i}, '{m}', {lo}::DOUBLE, {hi}::DOUBLE)"
    for i, s in enumerate(P.STAGE_ORDER)
    for m, (lo, hi) in P.ENVELOPES["type_00"][s].items()
)
STAGES = f"""env(stage, pos, metric, lo, hi) AS (VALUES {_ENV}),
mlong AS (
  SELECT stand_id, year, unnest(['gap_fraction', 'crown_cv', 'shrub_fraction', 'ndvi_mean', 'ndvi_seasonal_amplitude']) AS metric,
         unnest([gap_fraction, crown_cv, shrub_fraction, ndvi_mean, ndvi_seasonal_amplitude]) AS v
  FROM joined),
scored AS (
  SELECT stand_id, year, stage, pos, count(*) AS n, avg(CASE WHEN v BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS score
  FROM mlong JOIN env USING (metric) WHERE v IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY stand_id, year ORDER BY score DESC, pos) = 1),
staged AS (
  SELECT j.*, CASE WHEN score >= 0.5 THEN stage END AS stage, CASE WHEN score >= 0.5 THEN pos + 1 ELSE 0 END AS stage_code,
         coalesce(score, 0.0) AS stage_score, coalesce(n, 0) AS n_evaluated,
         CASE WHEN score IS NULL THEN 'no envelope metric was evaluable' WHEN score < 0.5 THEN printf('best score %.2f < min_score 0.50', score) END AS stage_reason
  FROM joined j LEFT JOIN best b ON b.stand_id = j.stand_id AND b.year = j.year)"""


@query(
    "stage_assign",
    f"WITH {JOINED}, {STAGES} SELECT stand_id, year, stage, stage_code, {s6('stage_score', 'stage_score')}, n_evaluated, stage_reason FROM staged",
)
def stage_assign(spark, sf):
    s = S.classify_stages(joined(spark, sf))
    return s.select(*KEY, "stage", "stage_code", r6("stage_score").alias("stage_score"), "n_evaluated", "stage_reason")


# Thresholds of the published rules seldom hold on the given tables, so the query adds two classes
# in front that exercise every kind of predicate.
QUERY_RULES = {
    "Q1": [("stage", None, "any", "in", ["ESI", "LSI"]), ("metric", "ndvi_mean", "mean", ">=", 0.45), ("stage_delta", None, "any", "!=", 0)],
    "Q2": [("persistence", "gap_fraction", "scalar", ">=", 0.5, 0.3), ("metric", "ndvi_trend", "latest", "<=", 0.05), ("stage", None, "latest", "==", "ESI")],
    "Q3": [("metric", "ndvi_seasonal_amplitude", "any", ">=", 0.3), ("metric", "crown_fraction", "all", ">=", 0.5), ("stage", None, "earliest", "==", "LSI")],
    **P.TRAJECTORIES,
}
QUERY_ORDER = ["Q1", "Q2", "Q3", *P.TRAJECTORY_ORDER]
QUERY_CODES = {**P.TRAJECTORY_CODES, "Q1": 101, "Q2": 102, "Q3": 103}


def trajectories(spark, sf):
    staged = S.classify_stages(joined(spark, sf)).drop("gap_persistence", "glcm_texture", "edge_density", "linearity_index", "row_directionality")
    return S.classify_trajectories(staged, rules=QUERY_RULES, order=QUERY_ORDER, codes=QUERY_CODES)


_PREDS = """preds AS (
  SELECT stand_id, count(*) AS dates, count(*) FILTER (stage_code <> 0) AS n_dates,
    bool_or(stage_code IN (1, 2)) AND coalesce(avg(ndvi_mean) >= 0.45, FALSE) AND coalesce(bool_or(step <> 0), FALSE) AS q1,
    avg(CASE WHEN gap_fraction >= 0.3 THEN 1.0 ELSE 0.0 END) >= 0.5 AND coalesce(list_last(list(ndvi_trend ORDER BY year)) <= 0.05, FALSE)
      AND arg_max(stage_code, year) = 1 AS q2,
    bool_or(coalesce(ndvi_seasonal_amplitude >= 0.3, FALSE)) AND bool_and(coalesce(crown_fraction >= 0.5, FALSE)) AND arg_min(stage_code, year) = 2 AS q3,
    bool_and(stage_code IN (3, 4)) AND coalesce(max(ndvi_trend) <= -0.004, FALSE) AS ds2,
    bool_and(stage_code IN (2, 3)) AND coalesce(min(shrub_fraction) >= 0.5, FALSE) AND coalesce(avg(gap_fraction) >= 0.2, FALSE) AS ef2,
    coalesce(max(crown_fraction) <= 0.05, FALSE) AND coalesce(min(gap_fraction) >= 0.85, FALSE) AND coalesce(min(ndvi_seasonal_amplitude) >= 0.9, FALSE) AS lc1,
    count(gap_fraction) > 0 AS h_gap, count(crown_cv) > 0 AS h_cv, count(ndvi_trend) > 0 AS h_trend, count(shrub_fraction) > 0 AS h_shrub,
    count(crown_fraction) > 0 AS h_crown, count(ndvi_seasonal_amplitude) > 0 AS h_amp, count(ndvi_mean) > 0 AS h_mean
  FROM (SELECT *, stage_code - lag(stage_code) OVER (PARTITION BY stand_id ORDER BY year) AS step FROM staged) s GROUP BY stand_id),
traj AS (
  SELECT *, CASE WHEN q1 THEN 'Q1' WHEN q2 THEN 'Q2' WHEN q3 THEN 'Q3' WHEN ds2 THEN 'DS2' WHEN ef2 THEN 'EF2' WHEN lc1 THEN 'LC1' END AS trajectory
  FROM preds WHERE dates >= 2)"""


@query(
    "trajectory_assign",
    f"""WITH {JOINED}, {STAGES}, {_PREDS}
SELECT stand_id, trajectory, CASE trajectory WHEN 'Q1' THEN 101 WHEN 'Q2' THEN 102 WHEN 'Q3' THEN 103 WHEN 'DS2' THEN 2 WHEN 'EF2' THEN 7 WHEN 'LC1' THEN 9 ELSE 0 END AS trajectory_code,
       CASE trajectory WHEN 'DS2' THEN 2 WHEN 'Q1' THEN 3 WHEN 'Q2' THEN 3 WHEN 'Q3' THEN 3 WHEN 'EF2' THEN 3 WHEN 'LC1' THEN 3 ELSE 0 END AS n_predicates, n_dates
FROM traj""",
)
def trajectory_assign(spark, sf):
    return trajectories(spark, sf).drop("available")


_HAVE = {
    "gap_fraction": "h_gap", "crown_cv": "h_cv", "ndvi_trend": "h_trend", "shrub_fraction": "h_shrub",
    "crown_fraction": "h_crown", "ndvi_seasonal_amplitude": "h_amp", "ndvi_mean": "h_mean",
}


def _blocked_sql() -> str:
    parts = []
    for name in QUERY_ORDER:
        reasons, seen = [], set()
        for _d, var, _r, _o, value, *_ in QUERY_RULES[name]:
            if value is None and ("t", var) not in seen:
                reasons.append(f"'threshold not set: {var}'")
                seen.add(("t", var))
            if var and ("m", var) not in seen:
                seen.add(("m", var))
                reasons.append(f"CASE WHEN NOT {_HAVE.get(var, 'FALSE')} THEN 'metric not available: {var}' END")
        text = f"concat_ws('; ', {', '.join(reasons)})" if reasons else "''"
        parts.append(f"SELECT stand_id, trajectory, '{name}' AS class, {text} AS r FROM traj")
    return " UNION ALL ".join(parts)


@query(
    "trajectory_blocked",
    f"""WITH {JOINED}, {STAGES}, {_PREDS}
SELECT stand_id, class, CASE WHEN r = '' THEN 'evaluated, conditions not met' ELSE r END AS reason
FROM ({_blocked_sql()}) b WHERE r <> '' OR trajectory IS NULL""",
)
def trajectory_blocked(spark, sf):
    return S.blocking_report(trajectories(spark, sf), rules=QUERY_RULES, order=QUERY_ORDER)


@query(
    "stage_by_site_type",
    f"""WITH {PIXELS}, {HEIGHTS}, {CROWNS}, {CROWN_STATS},
m AS (SELECT h.stand_id, h.year, gap_fraction, crown_cv, CAST(h.stand_id AS INTEGER) % 3 AS site_type FROM heights h LEFT JOIN cstats c ON c.stand_id = h.stand_id AND c.year = h.year),
s AS (SELECT *, (gap_fraction IS NOT NULL)::INT + (crown_cv IS NOT NULL)::INT AS n,
       (coalesce(gap_fraction BETWEEN 0 AND 0.1, FALSE))::INT + (coalesce(crown_cv <= 0.3, FALSE))::INT AS k FROM m)
SELECT stand_id, year, site_type, CASE WHEN site_type = 1 AND n > 0 AND k / n::DOUBLE >= 0.5 THEN 'LSE' END AS stage,
       {s6('CASE WHEN site_type = 1 AND n > 0 THEN k / n::DOUBLE ELSE 0 END', 'stage_score')},
       CASE WHEN site_type <> 1 THEN printf('no stage has an envelope for ''type_%02d''', site_type)
            WHEN n = 0 THEN 'no stage has an envelope for ''type_01''' WHEN k / n::DOUBLE < 0.5 THEN printf('best score %.2f < min_score 0.50', k / n::DOUBLE) END AS stage_reason
FROM s""",
)
def stage_by_site_type(spark, sf):
    m = Z.zone_pixel_metrics(stand_pixels(spark, sf), KEY).select(*KEY, "gap_fraction")
    m = m.join(Z.crown_stats(crowns(spark, sf), KEY).select(*KEY, "crown_cv"), KEY, "left")
    m = m.withColumn("site_type", (F.col("stand_id").cast("int") % 3))
    s = S.classify_stages(m, site_type="site_type")
    return s.select(*KEY, "site_type", "stage", r6("stage_score").alias("stage_score"), "stage_reason")


@query(
    "site_types",
    """WITH v AS (SELECT p_partkey, p_size % 6 AS parmat, p_size % 4 AS tex, p_partkey % 5 AS bed FROM part)
SELECT p_partkey, CASE WHEN parmat = 4 THEN 1 WHEN parmat = 3 AND tex = 1 THEN 4 WHEN bed = 1 THEN 12 WHEN bed = 3 THEN 13 ELSE 0 END AS site_type,
       CASE WHEN parmat = 4 OR (parmat = 3 AND tex = 1) OR bed IN (1, 3) THEN 1.0::DOUBLE END AS match_score FROM v""",
)
def site_types(spark, sf):
    v = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 6).alias("parmat_kind"), (F.col("p_size") % 4).alias("texture_class"), (F.col("p_partkey") % 5).alias("bedrock_kind"))
    return S.assign_site_types(v).select("p_partkey", "site_type", "match_score")


# --- components after an event -----------------------------------------------------
COMP = f"""{PIXELS}, {CELLS},
code AS (
  SELECT stand_id, row, col, CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN r < 5 THEN 3 WHEN p >= 5 THEN 1 ELSE 2 END AS component
  FROM (SELECT stand_id, row, col, max(height) FILTER (year = 1998) AS p, max(height) FILTER (year = 1996) AS r FROM scells GROUP BY ALL) x),
comp AS (SELECT s.*, component FROM scells s JOIN code USING (stand_id, row, col) WHERE component IS NOT NULL)"""


def component_frame(spark, sf):
    cells = stand_cells(spark, sf)
    code = Z.component_code(F.col("_post"), F.col("_ref"), 5.0)
    fixed = (
        cells.groupBy("stand_id", "row", "col")
        .agg(F.max(F.when(F.col("year") == 1998, F.col("height"))).alias("_post"), F.max(F.when(F.col("year") == 1996, F.col("height"))).alias("_ref"))
        .select("stand_id", "row", "col", code.alias("component"))
        .where("component IS NOT NULL")
    )
    return cells.join(fixed, ["stand_id", "row", "col"])


@query(
    "component_series",
    f"""WITH {COMP},
both_levels AS (SELECT stand_id, year, height, component FROM comp UNION ALL SELECT stand_id, year, height, 0 FROM comp)
SELECT stand_id, year, component, count(height) AS n_pixels,
  {s6('CASE WHEN count(height) >= 10 THEN avg(CASE WHEN height >= 5 THEN 1.0 ELSE 0.0 END) END', 'canopy_fraction')},
  {s6('CASE WHEN count(height) >= 10 THEN avg(height) END', 'height_mean')}, {s6('CASE WHEN count(height) >= 10 THEN median(height) END', 'height_median')},
  {s6('CASE WHEN count(height) >= 10 THEN quantile_cont(height, 0.9) END', 'height_p90')}, {s6('CASE WHEN count(height) >= 10 THEN stddev_pop(height) / avg(height) END', 'height_cv')},
  {s6('CASE WHEN count(*) FILTER (height >= 5) >= 10 THEN median(height) FILTER (height >= 5) END', 'canopy_height_median')},
  {s6('CASE WHEN count(*) FILTER (height >= 5) >= 10 THEN stddev_pop(height) FILTER (height >= 5) / avg(height) FILTER (height >= 5) END', 'canopy_height_cv')}
FROM both_levels WHERE height IS NOT NULL GROUP BY ALL""",
)
def component_series(spark, sf):
    s = Z.component_stats(component_frame(spark, sf), KEY, canopy_m=5.0)
    return s.select(*KEY, "component", "n_pixels", *[r6(c).alias(c) for c in ("canopy_fraction", "height_mean", "height_median", "height_p90", "height_cv", "canopy_height_median", "canopy_height_cv")])


@query(
    "variance_parts",
    f"""WITH {COMP},
g AS (SELECT stand_id, year, avg(height) AS mean, var_pop(height) AS total, count(height) AS n FROM comp WHERE height IS NOT NULL GROUP BY ALL),
c AS (SELECT stand_id, year, component, count(height) AS n, avg(height) AS m, var_pop(height) AS v FROM comp WHERE height IS NOT NULL GROUP BY ALL)
SELECT g.stand_id, g.year, {s6('any_value(g.mean)', 'mean')}, {s6('any_value(g.total)', 'total')}, {s6('sqrt(any_value(g.total)) / nullif(any_value(g.mean), 0)', 'cv')},
  {s6('sum(c.n * c.v) FILTER (component = 1) / any_value(g.n)', 'within_residual')}, {s6('sum(c.n * c.v) FILTER (component = 2) / any_value(g.n)', 'within_new_gap')},
  {s6('sum(c.n * c.v) FILTER (component = 3) / any_value(g.n)', 'within_preexisting_gap')}, {s6('sum(c.n * (c.m - g.mean) * (c.m - g.mean)) / any_value(g.n)', 'between')}
FROM g JOIN c ON g.stand_id = c.stand_id AND g.year = c.year GROUP BY g.stand_id, g.year""",
)
def variance_parts(spark, sf):
    v = Z.variance_parts(component_frame(spark, sf), KEY)
    return v.select(*KEY, *[r6(c).alias(c) for c in v.columns if c not in KEY])


# --- fixed windows ------------------------------------------------------------------
GRID_H = """gh AS (SELECT row, col, CASE WHEN row % 17 = 0 THEN NULL ELSE greatest(0, (value + 0.2) * 30) END AS height FROM cells)"""


def grid_heights(spark, sf):
    from sylvaflow.plans.stand_ins import grid

    h = F.when(F.col("row") % 17 == 0, None).otherwise(F.greatest(F.lit(0.0), (F.col("value") + 0.2) * 30))
    return grid(spark, sf).select("row", "col", h.alias("height"))


def _window_cover_sql() -> str:
    from sylvaflow.plans.stand_ins import GRID

    return f"""WITH {GRID}, {GRID_H}, w AS (SELECT unnest([25.0, 50.0]) AS window_m, unnest([8, 16]) AS px),
t AS (SELECT window_m, row // px AS wr, col // px AS wc, height FROM gh, w WHERE row // px < (SELECT count(*) FROM embeddings) // px AND col // px < 64 // px AND height IS NOT NULL)
SELECT CAST(window_m AS DOUBLE) AS window_m, wr, wc, {', '.join(s6(e.split(' AS ')[0], e.split(' AS ')[1]) for e in PIXEL_METRICS.strip().split(chr(10) + '  ')[1:] for e in [e.rstrip(',')])}, count(*) AS n_valid FROM t GROUP BY ALL"""


@query("window_cover", _window_cover_sql())
def window_cover(spark, sf):
    rows = table(spark, sf, "embeddings").count()
    w = Z.window_metrics(grid_heights(spark, sf), [25.0, 50.0], 3.125, rows, 64)
    return w.select("window_m", "wr", "wc", "n_valid", *[r6(c).alias(c) for c in ["gap_fraction", "crown_fraction", *P.HEIGHT_BANDS]])


@query(
    "window_crowns",
    f"""WITH {CROWNS}, p AS (SELECT CAST(floor((1000 - y) / 50) AS INTEGER) AS wr, CAST(floor((x - 100) / 50) AS INTEGER) AS wc, d FROM crowns),
f AS (SELECT CAST(r AS INTEGER) AS wr, CAST(c AS INTEGER) AS wc FROM (SELECT unnest(generate_series(0, 19)) AS r) a, (SELECT unnest(generate_series(0, 19)) AS c) b)
SELECT f.wr, f.wc, count(d) AS crown_count, {s6('CASE WHEN count(d) >= 3 THEN stddev_pop(d) / avg(d) END', 'crown_cv')}, {s6('CASE WHEN count(d) >= 3 THEN quantile_cont(d, 0.9) END', 'crown_p90')},
  {s6('CASE WHEN count(d) >= 3 THEN avg(d) END', 'crown_mean')}
FROM f LEFT JOIN p ON p.wr = f.wr AND p.wc = f.wc GROUP BY f.wr, f.wc""",
)
def window_crowns(spark, sf):
    w = Z.window_crowns(crowns(spark, sf), 50.0, (100.0, 1000.0), (20, 20))
    return w.select("wr", "wc", "crown_count", *[r6(c).alias(c) for c in ("crown_cv", "crown_p90", "crown_mean")])


@query(
    "metric_delta",
    """WITH t AS (SELECT l_returnflag AS f, l_orderkey % 16 AS row, l_partkey % 16 AS col, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT a.row, a.col, round(a.v - b.v, 6) + 0.0 AS delta FROM t a JOIN t b ON a.row = b.row AND a.col = b.col WHERE a.f = 'A' AND b.f = 'R'""",
)
def metric_delta(spark, sf):
    line = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 16).alias("row"), (F.col("l_partkey") % 16).alias("col"), "l_quantity")
    layer = lambda f: line.where(F.col("l_returnflag") == f).groupBy("row", "col").agg(F.avg("l_quantity").alias("value"))
    return Z.metric_delta(layer("A"), layer("R")).select("row", "col", r6("delta").alias("delta"))
