"""Analytic answers on small observation tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaflow import params as P
from sylvaflow.operators import observations as O
from sylvaflow.operators.ranks import exact_quantiles, robust_stats, several_quantiles


def frame(spark, rows):
    """rows: (stand, image, year, doy, ndvi); the rest passes every gate."""
    df = spark.createDataFrame(rows, "stand_id string, image_id string, year int, doy int, ndvi double")
    return df.withColumns({
        "sensor": F.lit("L8"), "wrs_path": F.lit(21), "n_pixels": F.lit(40), "pixel_weight_sum": F.lit(36.0), "area_m2": F.lit(32400.0), "coverage_fraction": F.lit(1.0),
    })


def wave(doy, period=365.0):
    w = 2 * math.pi * doy / period
    return 0.5 + 0.15 * math.cos(w) + 0.20 * math.sin(w)


def test_harmonic_recovers_a_noiseless_cycle(spark):
    rows = [("a", f"i{d}", 2019, d, wave(d)) for d in range(10, 360, 25)]
    rows += [("leap", f"i{d}", 2020, d, wave(d, 366.0)) for d in range(10, 360, 25)]
    rows += [("flat", f"i{d}", 2019, d, 0.4) for d in range(10, 360, 25)]
    out = {r["stand_id"]: r for r in O.harmonic_fit(frame(spark, rows)).collect()}
    for name in ("a", "leap"):
        assert out[name]["ndvi_seasonal_amplitude"] == pytest.approx(0.5, abs=1e-9)
        assert out[name]["sat_amplitude_r2"] == pytest.approx(1.0, abs=1e-9)
    assert out["flat"]["sat_amplitude_r2"] is None
    assert out["flat"]["ndvi_seasonal_amplitude"] == pytest.approx(0.0, abs=1e-6)


def test_harmonic_guards_name_the_cause(spark):
    rows = [("few", f"i{d}", 2019, d, 0.5) for d in (10, 100, 200)]
    rows += [("narrow", f"i{d}", 2019, d, 0.5) for d in range(190, 200)]
    rows += [("two", f"i{d}", 2019, d, 0.5) for d in (1, 2, 3, 4, 182, 183, 184, 185)]
    rows += [("big", f"i{d}", 2019, d, 4 * math.cos(2 * math.pi * d / 365)) for d in range(5, 360, 20)]
    out = {r["stand_id"]: r for r in O.harmonic_fit(frame(spark, rows)).collect()}
    assert out["few"]["_why_amplitude"] == "n_obs=3 < min_obs=6"
    assert out["narrow"]["_why_amplitude"].startswith("observations span 9 days")
    w = 2 * np.pi * np.array([1, 2, 3, 4, 182, 183, 184, 185]) / 365
    cond = np.linalg.cond(np.column_stack([np.ones(8), np.cos(w), np.sin(w)]))
    assert cond > 30 and f"cond={cond:.1f}" in out["two"]["_why_amplitude"]
    assert "exceeds max_amplitude=1.5" in out["big"]["_why_amplitude"]


def test_trend_ignores_one_bad_year(spark):
    level = [("s", y, 0.60 + 0.01 * (y - 2010) - (0.5 if y == 2012 else 0.0)) for y in range(2010, 2015)]
    level += [("gap", y, None if y in (2011, 2013) else 0.5) for y in range(2010, 2015)]
    df = spark.createDataFrame(level, "stand_id string, year int, ndvi_mean double")
    out = {(r["stand_id"], r["year"]): r for r in O.index_trend(df).collect()}
    assert out["s", 2014]["ndvi_trend"] == pytest.approx(0.01, abs=1e-9)
    assert out["gap", 2014]["_why_trend"] == "3 usable years in 2010-2014 < min_years=4"
    slopes = np.sort([(level[j][2] - level[i][2]) / (j - i) for i in range(5) for j in range(i + 1, 5)])
    reach = 1.959963984540054 * math.sqrt(5 * 4 * 15 / 18)
    lo, hi = max(round((10 - reach) / 2) - 1, 0), min(round((10 + reach) / 2), 9)
    assert out["s", 2014]["sat_trend_slope_lo"] == pytest.approx(slopes[lo])
    assert out["s", 2014]["sat_trend_slope_hi"] == pytest.approx(slopes[hi])


def test_empty_years_keep_a_row_with_reasons(spark):
    rows = [("a", f"i{d}", 2018, d, 0.8) for d in range(150, 250, 10)] + [("a", "x", 2020, 200, None)]
    out = {r["year"]: r for r in O.annual_frame(frame(spark, rows)).collect()}
    assert sorted(out) == [2018, 2019, 2020]
    assert out[2018]["ndvi_mean"] == pytest.approx(0.8)
    assert "ndvi_mean: n_obs=0" in out[2019]["satellite_unavailable"]
    assert out[2020]["sat_n_observations_raw"] == 1 and out[2020]["sat_n_observations"] == 0
    assert out[2018]["sat_dropped_null"] == 1


def test_each_row_is_counted_under_its_first_gate(spark):
    df = frame(spark, [("a", "1", 2019, 1, None), ("a", "2", 2019, 2, 2.0), ("a", "3", 2019, 3, 0.5), ("a", "4", 2019, 4, float("nan"))])
    df = df.withColumn("n_pixels", F.when(F.col("image_id") == "3", 40).otherwise(0))
    out = {r["cause"]: r["n_dropped"] for r in O.gate_counts(df).collect()}
    assert out == {O.gate_causes()["null"]: 2, O.gate_causes()["range"]: 1}


def test_exact_quantiles_of_a_skewed_group(spark):
    rng = np.random.default_rng(0)
    values = {"hot": np.round(rng.normal(size=3000), 2), "cold": rng.normal(size=7), "one": np.array([1.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}, 1 / 16).collect()}
    for k, vs in values.items():
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.93)):
            assert out[k][name] == pytest.approx(np.quantile(vs, p), abs=1e-12)
    two = several_quantiles(df, ["k"], {"m": (F.col("v"), 0.5, 0.1), "n": (F.col("v") * 3, 0.9, 0.5)}).collect()
    for r in two:
        assert r["n"] == pytest.approx(3 * np.quantile(values[r["k"]], 0.9))
    s = robust_stats(df.where("k = 'hot'"), ["k"], "v", 1 / 16, min_rows=200, scale=P.MAD_SCALE).first()
    v = values["hot"]
    assert s["scale"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
