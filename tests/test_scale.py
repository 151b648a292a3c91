"""Steps that grew faster than their input, or held a whole line in a task: results over block borders, and their plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sylvaflow.operators import cells as K


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def column_cells(spark, z: np.ndarray):
    r, c = np.indices(z.shape)
    rows = [("g", 0, int(a), int(b), float(v)) for a, b, v in zip(r.ravel(), c.ravel(), z.ravel())]
    return spark.createDataFrame(rows, "unit string, t int, row int, col int, z double")


def test_distances_are_carried_over_blocks_of_rows(spark):
    z = np.zeros((300, 3))
    z[5, 0] = z[290, 2] = z[129, 1] = z[63, 1] = 1.0
    df = column_cells(spark, z)
    seeds = np.argwhere(z > 0)
    want = {(r, c): float(np.sqrt(((seeds - (r, c)) ** 2).sum(axis=1).min())) for r in range(300) for c in range(3)}
    far = K.distance_to(df, F.col("z") > 0)
    got = {(r.row, r.col): r.distance for r in far.collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and len(got) == len(want)
    near = K.distances(df, {"a": F.col("z") > 0}, 4)
    got = {(r.row, r.col): r.a for r in near.collect()}
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v <= 4} and len(got) == len(want)
    # a frame that ends with the partition is summed anew for every row, and a line of a grid is no task
    assert "unboundedfollowing" not in plan(far) and "window" not in plan(near)


def test_a_cell_that_comes_twice_keeps_its_seed(spark):
    df = column_cells(spark, np.zeros((3, 2)))
    twice = df.unionByName(df.where("row = 1 AND col = 0").withColumn("z", F.lit(1.0)))
    got = sorted((r.row, r.col, round(r.distance, 6)) for r in K.distance_to(twice, F.col("z") > 0).collect())
    assert got == [(0, 0, 1.0), (0, 1, 1.414214), (1, 0, 0.0), (1, 0, 0.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, 1.414214)]


def test_tails_of_large_counts_are_rows(spark, tmp_path):
    from sylvaflow.plans import QUERIES

    part = spark.range(4000).select(F.when(F.col("id") < 3990, 1).otherwise(F.col("id") - 3988).cast("int").alias("p_size"), (F.col("id") % 3).cast("double").alias("p_retailprice"))
    part.unionByName(spark.createDataFrame([(None, 0.0), (None, 1.0)], "p_size int, p_retailprice double")).write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["exact_intervals"](spark, str(tmp_path))
    got = {r.g: (r.n, r.k, r.low_tail, r.high_tail) for r in out.collect()}
    assert got[1] == (3990, 1330, 0.025, 0.025) and got[None] == (2, 1, 0.025, 0.025) and len(got) == 12
    assert {v[2:] for k, v in got.items() if v[0] == 1} == {(1.0, 0.025), (0.025, 1.0)}
    assert "explode" in plan(out)  # not folded inside one expression, where every term counted its factorials again


def test_outlines_meet_objects_before_pairs(spark):
    from sylvaflow.operators import spatial as A

    cols = "minx double, maxx double, miny double, maxy double"
    objects = spark.createDataFrame([(1, 0.0, 5.0, 0.0, 5.0, 1.0), (1, 0.0, 5.0, 0.0, 5.0, 1.0), (2, 30.0, 31.0, 0.0, 1.0, 2.0), (3, 90.0, 91.0, 0.0, 1.0, 3.0)], f"object_id int, {cols}, area_ha double")
    focus = spark.createDataFrame([(7, 0.0, 2.0, 0.0, 2.0), (7, 1.0, 25.0, 0.0, 2.0), (8, 85.0, 99.0, 0.0, 9.0), (8, 85.0, 99.0, 0.0, 9.0)], f"focus_id int, {cols}")
    refined = spark.createDataFrame([(1, 10.0), (1, 10.0), (3, 30.0)], "object_id int, area_ha double")
    out = A.nearby(objects, focus, 10.0, 8.0, refined)
    got = sorted((r.focus_id, r.object_id, r.area_ha, r.geom_src) for r in out.collect())
    assert got == [(7, 1, 10.0, "refined"), (7, 1, 10.0, "refined"), (7, 2, 2.0, "object"), (8, 3, 30.0, "refined")]
    assert set(out.columns) == {"focus_id", *objects.columns, "geom_src"}
    for one in (False, True):
        lines = plan(A.nearby(objects, focus, 10.0, 8.0, refined, one_box=one)).splitlines()
        assert "_tx" in next(x for x in lines if "join" in x)


def test_a_pixel_is_one_row_once_its_candidates_are_folded(spark):
    from sylvaflow.operators import labels as L
    from sylvaflow.plans.label_queries import SMALL_RULE

    at = "window_id string, k int, row int, col int"
    pixels = spark.createDataFrame([("w", 0, r, c, c > 4, c > 4, 0.0, 0.0, 0.0, False, False, (r, c) == (8, 8)) for r in range(9) for c in range(9)], f"{at}, forest_before boolean, forest_after boolean, cover_before double, height_before double, prob double, unstable boolean, never_green boolean, no_data boolean")
    part = lambda r, c, seq, outcome, part, big: ("w", 0, r, c, seq, seq, outcome, part, False, False, False, big, 3)
    rows = [part(2, 2, 1, "intact", "mask", False), part(2, 2, 2, "open", "mask", False), part(6, 2, 3, "loss_full", "extension", True), part(6, 6, 3, "loss_full", "extension", True), part(0, 8, 4, "loss_full", "core", False), part(50, 50, 5, "intact", "mask", False)]
    parts = spark.createDataFrame(rows, f"{at}, cand_id int, seq int, outcome string, part string, crisp boolean, precise boolean, wide_margin boolean, oversize boolean, agent int")
    out = L.interval_reasons(pixels.unionByName(pixels.where("row = 0")), parts, SMALL_RULE)
    got = {(r.row, r.col): (r.reason, r.agent) for r in out.collect()}
    assert len(got) == out.count() == 81
    assert [got[k] for k in ((2, 2), (6, 2), (6, 6), (0, 8), (8, 8), (4, 0))] == [(41, 255), (42, 255), (22, 255), (10, 3), (1, 255), (42, 255)]
    assert "union" not in plan(L.interval_reasons(pixels, parts, SMALL_RULE))  # every layer was a row of every pixel, sorted to find the highest


def test_moving_sums_and_kernels_hold_blocks_of_a_column(spark):
    z = np.random.default_rng(3).normal(size=(600, 4))
    df = column_cells(spark, z).where("row % 50 <> 7")
    rows = [r for r in range(600) if r % 50 != 7]
    smooth = K.smooth_fields(df, {"s": (F.col("z"), F.lit(True), 1.3)})
    sums = K.box_sums(df, {"s": F.col("z")}, 5)
    w = K.kernel(1.3)
    line = lambda x: np.array([sum(w[abs(i - j)] * x[j] for j in range(max(0, i - len(w) + 1), min(len(x), i + len(w)))) for i in range(len(x))])
    field = lambda a: np.apply_along_axis(line, 0, np.apply_along_axis(line, 1, a))
    want = field(z[rows]) / field(np.ones((len(rows), 4)))  # neighbours are the cells next in the column
    got = {(r.row, r.col): r.s for r in smooth.collect()}
    assert len(got) == want.size and all(abs(got[r, c] - want[i, c]) < 1e-9 for i, r in enumerate(rows) for c in range(4))
    got = {(r.row, r.col): r.s for r in sums.collect()}
    square = lambda r, c: sum(z[a, b] for a in range(max(0, r - 2), min(600, r + 3)) if a % 50 != 7 for b in range(max(0, c - 2), min(4, c + 3)))
    assert len(got) == want.size and all(abs(got[r, c] - square(r, c)) < 1e-9 for r in (0, 255, 256, 258, 511, 512, 599) for c in range(4))
    # windows along a column are cut into blocks of rows; kernels need none over cells
    assert "lag(" not in plan(smooth) and all("_b#" in x for x in plan(sums).splitlines() if x.strip().lstrip("+- ").startswith("window") and "row#" in x.split("], [")[-1] and "col#" in x.split("], [")[-2])


def test_tiles_inside_an_outline_give_their_totals(spark):
    from sylvaflow.operators import spatial as A

    rng = np.random.default_rng(9)
    at = np.vstack([rng.uniform(0, 40, (1500, 2)), rng.integers(0, 41, (1500, 2))]).tolist()
    points = spark.createDataFrame([(i, x, y, float(i % 7)) for i, (x, y) in enumerate([*at, *at[:200]])], "i int, x double, y double, d double")
    rings = [("a", [(1.0, 1.0), (39.0, 1.0), (39.0, 39.0), (20.0, 13.0), (1.0, 39.0)]), ("b", [(4.0, 4.0), (36.0, 8.0), (10.0, 30.0)]), ("b", [(8.0, 8.0), (16.0, 8.0), (16.0, 16.0), (8.0, 16.0)]), ("c", [(0.0, 0.0), (40.0, 40.0), (40.0, 0.0), (0.0, 40.0)])]
    polygons = spark.createDataFrame(rings, "zone string, vertices array<struct<x:double,y:double>>")
    want = {r.zone: (r.n, r.d) for r in A.points_in_polygons(points, polygons, 64.0).groupBy("zone").agg(F.count("i").alias("n"), F.sum("d").alias("d")).collect()}
    out = A.polygon_sums(points, polygons, "zone", 2.0, {"n": F.lit(1), "d": F.col("d")})
    assert {r.zone: (r.n, r.d) for r in out.collect()} == want and len(want) == 3
    assert "exists(" in plan(out)  # tiles that no edge touches are not tested point by point


def test_tiles_of_outlines_are_not_sent_to_every_task(spark, tmp_path):
    from sylvaflow.operators import spatial as A

    points = spark.range(400).select((F.col("id") % 20 + 0.5).alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"), F.lit(2.0).alias("d"))
    rings = [(k, [(0.0, 0.0), (10.0 + k, 0.0), (10.0 + k, 12.0), (0.0, 12.0)]) for k in range(5)]
    spark.createDataFrame(rings, "zone int, vertices array<struct<x:double,y:double>>").write.parquet(f"{tmp_path}/rings")
    out = A.polygon_sums(points, spark.read.parquet(f"{tmp_path}/rings"), "zone", 4.0, {"n": F.lit(1), "d": F.col("d")})
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("SortMergeJoin" in x for x in lines) == 2 and not any("Broadcast" in x for x in lines)  # a polygon is small, its tiles are not
    assert {r.zone: (r.n, r.d) for r in out.collect()} == {k: ((10 + k) * 12, (10 + k) * 24.0) for k in range(5)}


def test_window_metrics_are_dealt_by_window_once(spark):
    from sylvaflow.operators import windows as WN

    px = column_cells(spark, np.random.default_rng(2).normal(size=(32, 32))).select("row", "col", (F.col("z") * 5).alias("height"), F.col("z").alias("band"))
    lines = WN.window_table(px, [4.0], 1.0, 32, 32, metrics=["lines"])
    deals = [x for x in lines._jdf.queryExecution().executedPlan().toString().lower().splitlines() if "exchange hashpartitioning" in x]
    assert deals and not any("rho" in x or "row#" in x for x in deals)  # every vote and every line of a window was shuffled


def test_windows_of_several_sizes_are_dealt_once(spark):
    from sylvaflow.operators import windows as WN

    px = column_cells(spark, np.random.default_rng(2).normal(size=(32, 32))).select("row", "col", (F.col("z") * 5).alias("height"), F.col("z").alias("band"))
    asked = ["heights", "edges", "lines"]
    out = WN.window_table(px, [16.0, 32.0], 1.0, 8192, 32, metrics=asked)  # of a grid that is dealt to several tasks
    deals = [x for x in out._jdf.queryExecution().executedPlan().toString().lower().splitlines() if "exchange hashpartitioning" in x]
    assert sum("repartition_by_num" in x for x in deals) == 3 and not any(y in x for x in deals for y in ("_groupingexpression", "rho", "row#", "col#", "normalizenanandzero"))
    assert out.columns[:3] == ["window_m", "wr", "wc"] and "_size" not in out.columns
    want = {(m, r.wr, r.wc): r for m in (16.0, 32.0) for r in WN.window_table(px, [m], 1.0, 8192, 32, metrics=asked).collect()}
    assert {(r.window_m, r.wr, r.wc): r for r in out.collect()} == want and len(want) == 1024 + 256 and want[32.0, 0, 0].n_valid == 1024


def date_cells(spark):
    rows = spark.range(4500).select(F.lit("g").alias("unit"), (F.col("id") % 3).cast("int").alias("t"), F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), (F.col("id") * 7919 % 4499 / 900.0 - 2.5).alias("z"))
    return rows.withColumns({"monitored": F.lit(True), "population": F.col("t") < 2})


def test_scene_of_a_date_goes_to_its_cells(spark, monkeypatch):
    from sylvaflow.operators import ranks as Q

    df = date_cells(spark)
    out = K.scene_z(df, "z", "population", out="s")
    for x in (out, K.scene_z(df, "z", "population", robust=False, out="s"), K.local_z(df, "z", "population", 3, out="s")):
        assert "strategy=broadcast" in plan(x)
    assert {(r.t, r.n, r.s) for r in out.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("s")).collect()} == {(0, 1500, 1500), (1, 1500, 1500), (2, 1500, 0)}
    monkeypatch.setattr(Q, "cut_lineage", lambda x: x)
    assert "strategy=broadcast" in plan(Q.robust_stats(df, K.DATE, "z", 0.25, min_rows=5, scale=1.0))


def test_many_groups_are_joined_by_key(spark, monkeypatch):
    from sylvaflow.operators import ranks as Q

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "unit string, v int")
    groups = spark.createDataFrame([("a", 10), (None, 30)], "unit string, g int")
    for few, hint in ((1000, True), (1, False)):
        monkeypatch.setattr(Q, "FEW_GROUPS", few)
        out = Q.join_groups(rows, groups, ["unit"], "left")
        assert ("strategy=broadcast" in plan(out)) is hint
        assert sorted((r.v, r.g) for r in out.collect()) == [(1, 10), (2, 10), (3, None), (4, None)]
        assert Q.join_groups(rows, groups, ["unit"]).count() == 2 and Q.join_groups(rows, groups, ["unit"], "left_semi").columns == ["unit", "v"]


def test_model_of_a_date_goes_to_its_cells(spark, monkeypatch):
    from sylvaflow.operators import null_model as N

    df = date_cells(spark)
    flags, _fits = N.decide_flags(df, "D2")
    models, fits = N.date_models(df, "z", "monitored")
    for x in (flags, N.loss_probability(df, "z", models, "p"), N.bh_reject(df, "z", models), N.fit_null(df, "z", "monitored")):
        assert "strategy=broadcast" in plan(x)
    assert {(r.t, r.n_cells, r.skipped) for r in fits.collect()} == {(0, 1500, False), (1, 1500, False), (2, 1500, False)}
    assert flags.count() == 4500
    monkeypatch.setattr(N, "cut_lineage", lambda x: x)
    lines = plan(N.date_models(df, "z", "monitored")[0])
    assert lines.count("strategy=broadcast") >= 3


def test_slices_of_edges_are_dealt_by_their_number(spark, monkeypatch):
    from sylvaflow.operators import sweep as U

    ring = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    shapes = [("g", "a", 1, ring(0.0, 0.0, 4.0, 4.0)), ("g", "a", 2, ring(4.0, 0.0, 2.0, 4.0)), ("g", "a", 2, ring(4.0, 0.0, 2.0, 2.0)), ("g", "b", 3, ring(0.0, 1.0, 6.0, 1.0)), ("g", "b", 3, ring(0.0, 1.0, 6.0, 1.0)), ("g", "b", 4, ring(1.0, 0.0, 5.0, 9.0))]
    df = spark.createDataFrame(shapes, "unit string, run string, shape int, vertices array<struct<x: double, y: double>>")
    # shape 2 is its upper half, the rings of shape 3 cancel out
    monkeypatch.setattr(U, "SLICES_A_TASK", 3)
    parts = U.covered_parts(df, ["a", "b"], band=2.0, tile=2.0)
    # the session deals to 4 tasks
    assert "repartition" in parts._jdf.queryExecution().logical().toString().lower() and parts.rdd.getNumPartitions() > 4
    got = {r.run: (r.area, r.in_a, r.in_b) for r in U.union_areas(df, ["a", "b"], band=2.0, tile=2.0).collect()}
    assert got == {"a": (20.0, 20.0, 16.0), "b": (45.0, 16.0, 45.0)}
    assert parts.where("area <= 0").count() == 0
