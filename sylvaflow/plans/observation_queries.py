"""Queries on observations of stands."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaflow.functions.columns import r6
from sylvaflow.operators import observations as O
from sylvaflow.plans.catalog import query, s6
from sylvaflow.plans.stand_ins import OBS, observations


@query(
    "obs_gate_counts",
    f"WITH {OBS} SELECT stand_id, cause, count(*) AS n_dropped FROM gated WHERE cause IS NOT NULL GROUP BY ALL",
)
def obs_gate_counts(spark, sf):
    return O.gate_counts(observations(spark, sf))


@query(
    "mask_propagation",
    f"WITH {OBS} SELECT count(*) AS n_rows, count(*) FILTER (ndvi IS NULL AND n_pixels > 0) AS n_bad FROM obs",
)
def mask_propagation(spark, sf):
    return O.mask_propagation_errors(observations(spark, sf))


LEVEL = """level AS (
  SELECT stand_id, year, CASE WHEN count(*) >= 3 THEN avg(ndvi) END AS ndvi_mean,
         count(*) AS n, median(ndvi) AS med
  FROM kept WHERE doy BETWEEN 152 AND 258 GROUP BY stand_id, year)"""


@query(
    "annual_mean",
    f"""WITH {OBS}, {LEVEL}
SELECT stand_id, year, {s6('ndvi_mean', 'ndvi_mean')}, n AS n_obs, {s6('med', 'med')},
       CASE WHEN n < 3 THEN 'n_obs=' || n || ' in DOY 152-258 < min_obs=3' END AS reason
FROM level""",
)
def annual_mean(spark, sf):
    level = O.season_level(O.filter_observations(observations(spark, sf)))
    return level.select(
        "stand_id", "year", r6("ndvi_mean").alias("ndvi_mean"), F.col("sat_ndvi_mean_n_obs").alias("n_obs"),
        r6("sat_ndvi_mean_median").alias("med"), F.col("_why_mean").alias("reason"),
    )


# The oracle fits the centred regressors (2 x 2 system); the condition number is the
# ratio of the extreme roots of the characteristic cubic, found in closed form.
HARMONIC = """ang AS (
  SELECT stand_id, year, doy, ndvi AS y, 2 * pi() * doy / (CASE WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 366 ELSE 365 END) AS w
  FROM kept),
cs AS (SELECT *, cos(w) AS c, sin(w) AS s FROM ang),
ctr AS (SELECT *, c - avg(c) OVER k AS dc, s - avg(s) OVER k AS ds, y - avg(y) OVER k AS dy FROM cs WINDOW k AS (PARTITION BY stand_id, year)),
mom AS (
  SELECT stand_id, year, count(*) AS n, CAST(max(doy) - min(doy) AS DOUBLE) AS span,
         max(CASE WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 366 ELSE 365 END) AS period,
         avg(c) AS mc, avg(s) AS ms, avg(y) AS my,
         sum(dc * dc) AS vcc, sum(dc * ds) AS vcs, sum(ds * ds) AS vss, sum(dc * dy) AS vcy, sum(ds * dy) AS vsy, sum(dy * dy) AS vyy,
         sum(c) AS sc, sum(s) AS ss1, sum(c * c) AS scc, sum(c * s) AS scs, sum(s * s) AS sss
  FROM ctr GROUP BY stand_id, year),
eig AS (
  SELECT *, (n + scc + sss) / 3.0 AS q,
         (n * scc - sc * sc) + (n * sss - ss1 * ss1) + (scc * sss - scs * scs) AS minors,
         n * (scc * sss - scs * scs) - sc * (sc * sss - scs * ss1) + ss1 * (sc * scs - scc * ss1) AS det
  FROM mom),
root AS (
  SELECT *, sqrt(greatest(q * q - minors / 3.0, 0)) AS p,
         (2 * q * q * q - q * minors + det) / 2.0 AS h
  FROM eig),
fit AS (
  SELECT *, CASE WHEN n >= 6 AND span >= 150 THEN sqrt(
           (q + 2 * p * cos(acos(greatest(-1, least(1, h / (p * p * p)))) / 3))
           / (q + 2 * p * cos(acos(greatest(-1, least(1, h / (p * p * p)))) / 3 + 2 * pi() / 3))) END AS cond,
         (vcy * vss - vsy * vcs) / (vcc * vss - vcs * vcs) AS b1,
         (vsy * vcc - vcy * vcs) / (vcc * vss - vcs * vcs) AS b2
  FROM root),
good AS (SELECT *, n >= 6 AND span >= 150 AND cond <= 30 AS ok FROM fit),
amp AS (
  SELECT stand_id, year, n, span, cond, 2 * sqrt(b1 * b1 + b2 * b2) AS amplitude, ok,
         my - b1 * mc - b2 * ms AS b0, sqrt(greatest(0, vyy - b1 * vcy - b2 * vsy) / n) AS rmse,
         1 - (vyy - b1 * vcy - b2 * vsy) / vyy AS r2,
         (CASE WHEN atan2(b2, b1) < 0 THEN atan2(b2, b1) + 2 * pi() ELSE atan2(b2, b1) END) / (2 * pi()) * period AS phase
  FROM good)"""


@query(
    "harmonic_fit",
    f"""WITH {OBS}, {HARMONIC}
SELECT stand_id, year, n AS n_obs, span, {s6('cond', 'cond')},
       {s6('CASE WHEN ok AND amplitude <= 1.5 THEN amplitude END', 'amplitude')},
       {s6('CASE WHEN ok THEN b0 END', 'b0')}, {s6('CASE WHEN ok THEN rmse END', 'rmse')},
       {s6('CASE WHEN ok THEN r2 END', 'r2')}, {s6('CASE WHEN ok THEN phase END', 'phase')},
       CASE WHEN n < 6 THEN 'n_obs=' || n || ' < min_obs=6'
            WHEN span < 150 THEN printf('observations span %.0f days < min_doy_span=150', span)
            WHEN cond > 30 THEN printf('design matrix ill-conditioned (cond=%.1f > max_condition=30)', cond)
            WHEN amplitude > 1.5 THEN printf('fitted amplitude %.2f exceeds max_amplitude=1.5', amplitude) END AS reason
FROM amp""",
)
def harmonic_fit(spark, sf):
    fit = O.harmonic_fit(O.filter_observations(observations(spark, sf)))
    return fit.select(
        "stand_id", "year", F.col("sat_amplitude_n_obs").alias("n_obs"), F.col("sat_amplitude_doy_span").alias("span"),
        r6("sat_amplitude_condition").alias("cond"), r6("ndvi_seasonal_amplitude").alias("amplitude"),
        r6("sat_amplitude_offset").alias("b0"), r6("sat_amplitude_rmse").alias("rmse"),
        r6("sat_amplitude_r2").alias("r2"), r6("sat_amplitude_phase_doy").alias("phase"),
        F.col("_why_amplitude").alias("reason"),
    )


# Years of every stand, then pairs of years inside the trailing window.
TREND = """span AS (SELECT min(year) AS y0, max(year) AS y1 FROM obs),
frame AS (
  SELECT stand_id, CAST(y AS INTEGER) AS year, area_m2
  FROM (SELECT stand_id, median(area_m2) AS area_m2 FROM obs GROUP BY stand_id) a,
       (SELECT unnest(generate_series(y0, y1)) AS y FROM span) b),
usable AS (
  SELECT f.stand_id, f.year, l.year AS x, l.ndvi_mean AS y
  FROM frame f JOIN level l ON l.stand_id = f.stand_id AND l.year BETWEEN f.year - 4 AND f.year AND l.ndvi_mean IS NOT NULL),
many AS (SELECT stand_id, year, count(*) AS k FROM usable GROUP BY stand_id, year),
slopes AS (
  SELECT a.stand_id, a.year, list_sort(list((b.y - a.y) / (b.x - a.x))) AS s
  FROM usable a JOIN usable b ON a.stand_id = b.stand_id AND a.year = b.year AND b.x > a.x GROUP BY a.stand_id, a.year),
trend AS (
  SELECT f.stand_id, f.year, coalesce(m.k, 0) AS k,
         CASE WHEN m.k >= 4 THEN list_median(s) END AS slope,
         CASE WHEN m.k >= 4 THEN s[greatest(CAST(round_even((len(s) - 1.959963984540054 * sqrt(m.k * (m.k - 1) * (2 * m.k + 5) / 18.0)) / 2, 0) AS INTEGER) - 1, 0) + 1] END AS lo,
         CASE WHEN m.k >= 4 THEN s[least(CAST(round_even((len(s) + 1.959963984540054 * sqrt(m.k * (m.k - 1) * (2 * m.k + 5) / 18.0)) / 2, 0) AS INTEGER), len(s) - 1) + 1] END AS hi
  FROM frame f LEFT JOIN many m ON m.stand_id = f.stand_id AND m.year = f.year
  LEFT JOIN slopes p ON p.stand_id = f.stand_id AND p.year = f.year)"""


@query(
    "theil_sen_trend",
    f"""WITH {OBS}, {LEVEL}, {TREND}
SELECT stand_id, year, k AS n_years, {s6('slope', 'slope')}, {s6('lo', 'lo')}, {s6('hi', 'hi')},
       CASE WHEN k < 4 THEN k || ' usable years in ' || (year - 4) || '-' || year || ' < min_years=4' END AS reason
FROM trend""",
)
def theil_sen_trend(spark, sf):
    obs = observations(spark, sf)
    level = O.season_level(O.filter_observations(obs)).select("stand_id", "year", "ndvi_mean")
    trend = O.index_trend(O.stand_years(obs).join(level, ["stand_id", "year"], "left"))
    return trend.select(
        "stand_id", "year", F.col("sat_trend_n_years").cast("long").alias("n_years"), r6("ndvi_trend").alias("slope"),
        r6("sat_trend_slope_lo").alias("lo"), r6("sat_trend_slope_hi").alias("hi"), F.col("_why_trend").alias("reason"),
    )


ANNUAL = """counted AS (
  SELECT stand_id, year, count(*) AS n, string_agg(DISTINCT sensor, ',' ORDER BY sensor) AS mix, min(n_pixels) AS min_px,
         count(DISTINCT sensor) AS n_sensors, avg(CASE WHEN sensor = 'L7' THEN 1.0 ELSE 0.0 END) AS l7,
         count(DISTINCT wrs_path) AS n_paths, median(coverage_fraction) AS med_cover, median(n_pixels) AS med_px
  FROM kept GROUP BY stand_id, year),
raw AS (SELECT stand_id, year, count(*) AS n_raw FROM obs GROUP BY stand_id, year),
dropped AS (
  SELECT stand_id, count(*) FILTER (cause LIKE 'index null%') AS d_null, count(*) FILTER (cause LIKE 'stand coverage%') AS d_cover,
         count(*) FILTER (cause LIKE 'stand area%') AS d_area
  FROM gated GROUP BY stand_id),
annual AS (
  SELECT f.stand_id, f.year, f.area_m2, coalesce(c.n, 0) AS n_obs, coalesce(r.n_raw, 0) AS n_raw, coalesce(c.mix, '') AS mix,
         c.min_px, c.n_sensors, c.l7, c.n_paths, c.med_cover, c.med_px, d.d_null, d.d_cover, d.d_area,
         l.ndvi_mean, CASE WHEN a.ok AND a.amplitude <= 1.5 THEN a.amplitude END AS amplitude, t.slope,
         concat_ws('; ',
           CASE WHEN coalesce(l.n, 0) < 3 THEN 'ndvi_mean: n_obs=' || coalesce(l.n, 0) || ' in DOY 152-258 < min_obs=3' END,
           CASE WHEN coalesce(a.n, 0) < 6 THEN 'ndvi_seasonal_amplitude: n_obs=' || coalesce(a.n, 0) || ' < min_obs=6'
                WHEN a.span < 150 THEN printf('ndvi_seasonal_amplitude: observations span %.0f days < min_doy_span=150', a.span)
                WHEN a.cond > 30 THEN printf('ndvi_seasonal_amplitude: design matrix ill-conditioned (cond=%.1f > max_condition=30)', a.cond)
                WHEN a.amplitude > 1.5 THEN printf('ndvi_seasonal_amplitude: fitted amplitude %.2f exceeds max_amplitude=1.5', a.amplitude) END,
           CASE WHEN t.k < 4 THEN 'ndvi_trend: ' || t.k || ' usable years in ' || (f.year - 4) || '-' || f.year || ' < min_years=4' END) AS why
  FROM frame f JOIN trend t ON t.stand_id = f.stand_id AND t.year = f.year
  LEFT JOIN counted c ON c.stand_id = f.stand_id AND c.year = f.year
  LEFT JOIN raw r ON r.stand_id = f.stand_id AND r.year = f.year
  LEFT JOIN dropped d ON d.stand_id = f.stand_id
  LEFT JOIN level l ON l.stand_id = f.stand_id AND l.year = f.year
  LEFT JOIN amp a ON a.stand_id = f.stand_id AND a.year = f.year)"""


@query(
    "annual_frame",
    f"""WITH {OBS}, {LEVEL}, {HARMONIC}, {TREND}, {ANNUAL}
SELECT stand_id, year, area_m2, n_obs, n_raw, mix, min_px, n_sensors, {s6('l7', 'l7')}, n_paths,
       {s6('med_cover', 'med_cover')}, {s6('med_px', 'med_px')}, d_null, d_cover, d_area,
       {s6('ndvi_mean', 'ndvi_mean')}, {s6('amplitude', 'amplitude')}, {s6('slope', 'slope')}, why
FROM annual""",
)
def annual_frame(spark, sf):
    a = O.annual_frame(observations(spark, sf))
    return a.select(
        "stand_id", "year", "area_m2", F.col("sat_n_observations").alias("n_obs"), F.col("sat_n_observations_raw").alias("n_raw"),
        F.col("sat_sensor_mix").alias("mix"), F.col("sat_min_n_pixels").alias("min_px"),
        F.col("sat_n_sensors").cast("long").alias("n_sensors"), r6("sat_frac_l7").alias("l7"), F.col("sat_n_paths").alias("n_paths"),
        r6("sat_median_coverage_fraction").alias("med_cover"), r6("sat_median_n_pixels").alias("med_px"),
        F.col("sat_dropped_null").alias("d_null"), F.col("sat_dropped_coverage").alias("d_cover"), F.col("sat_dropped_area").alias("d_area"),
        r6("ndvi_mean").alias("ndvi_mean"), r6("ndvi_seasonal_amplitude").alias("amplitude"),
        r6("ndvi_trend").alias("slope"), F.col("satellite_unavailable").alias("why"),
    )
