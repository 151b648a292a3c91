"""Inspection samples, metrics by name, sweeps, polygon runs, ranks, folds and tile evidence against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cells import flood, to_cells

from sylvaflow.operators import annual as AN
from sylvaflow.operators import cells as K
from sylvaflow.operators import components as G
from sylvaflow.operators import inspection as I
from sylvaflow.operators import ranks as R
from sylvaflow.operators import scores as S
from sylvaflow.operators import spatial as A
from sylvaflow.operators import sweep as U
from sylvaflow.operators import windows as WN
from sylvaflow.plans.inspection_queries import band_observations
from sylvaflow.streaming import jobs as J

SF = "/root/testdata/sf0.001"
CELLS = "unit string, t int, row int, col int"


# --- inspection sample ------------------------------------------------------------------------
def test_three_strata_with_their_probabilities(spark):
    rng = np.random.default_rng(2)
    flag = rng.random((3, 40, 40)) < 0.12
    flag[0] = False
    flag[1, 5:9, 5:9] = True
    monitored = np.broadcast_to(rng.random((40, 40)) < 0.8, (3, 40, 40)).copy()
    monitored[0] = False
    rows = [("u", t, r, c, 2000 + t, bool(flag[t, r, c]), bool(monitored[t, r, c]), float(rng.random()), float(rng.random())) for t in range(3) for r in range(40) for c in range(40)]
    cells = spark.createDataFrame(rows, CELLS + ", year int, flag boolean, monitored boolean, z double, probability double")
    years = cells.select("unit", "t", "year").distinct()
    flags = cells.where("flag").select("unit", "t", "row", "col")
    kept = G.interval_detections(flags, [0, 1, 2], least=6, growth=6)
    kept_at = {(r.t, r.row, r.col) for r in kept.collect()}
    rejected = I.rejected_cells(flags, kept)
    ever_kept = {(r, c) for _, r, c in kept_at}
    first = {}
    for t, r, c in zip(*np.nonzero(flag), strict=True):
        if (r, c) not in ever_kept:
            first[r, c] = min(first.get((r, c), 9), t)
    want = {}
    for t in range(3):
        mask = np.zeros((40, 40), bool)
        for (r, c), at in first.items():
            mask[r, c] = at == t
        want |= {(t, *cell): root[0] * (1 << 31) + root[1] for cell, root in flood(mask).items()}
    assert {(r.t, r.row, r.col): r.label for r in rejected.collect()} == want

    objects, near = G.detection_objects(kept, cells, years), G.detection_objects(rejected, cells, years)
    for clear in (0, 1):
        quiet = I.quiet_cells(cells, 0, clear=clear).collect()
        ever = flag.any(axis=0)
        grown = np.array([[ever[max(0, r - clear) : r + clear + 1, max(0, c - clear) : c + clear + 1].any() for c in range(40)] for r in range(40)])
        assert {(q.row, q.col) for q in quiet} == {(int(r), int(c)) for r, c in zip(*np.nonzero(~grown & monitored[1]), strict=True)}
        assert {q.n_dates for q in quiet} == {2} and {q.t for q in quiet} == {1, 2}
    design = {"n_detected": 5, "n_below_mmu": 4, "n_no_detection": 7, "min_per_interval": 1, "seed": 3}
    s = I.inspection_sample(objects, near, I.quiet_cells(cells, 3), years, mmu_ha=4 * 0.036864, cell_m=19.2, design=design).collect()
    assert [r.sample_id for r in sorted(s, key=lambda r: r.sample_id)] == [f"S{k + 1:02d}" for k in range(len(s))]
    by = defaultdict(list)
    for r in s:
        by[r.stratum].append(r)
    n_kept, n_near = objects.count(), near.where(f"area_ha >= {2 * 0.036864}").count()
    assert len(by["detected"]) == min(5, n_kept) and len(by["below_mmu"]) == min(4, n_near) and len(by["no_detection"]) == 7
    assert all(r.n_cells >= 2 and r.object_id is None for r in by["below_mmu"]) and all(r.object_id is None for r in by["no_detection"])
    # the weights of a stratum expand to its frame
    sizes = {(r.interval): r.n_population for r in by["below_mmu"]}
    for interval, n in sizes.items():
        drawn = [r for r in by["below_mmu"] if r.interval == interval]
        assert sum(r.weight for r in drawn) == pytest.approx(n)
    quiet_n = I.quiet_cells(cells, 3).count()
    assert all(r.incl_prob == pytest.approx(7 / quiet_n / 2) and r.n_population == quiet_n for r in by["no_detection"])
    assert all(r.follow_up == (r.onset_year < 2002) for r in s)


# --- yearly metrics by name -----------------------------------------------------------------------
def test_metrics_are_one_scan_and_refusals(spark):
    c = AN.standard_catalogue()
    frame = c.compute(band_observations(spark, SF), ["ndvi_season_mean", "ndvi_spread", "nbr_season_min"])
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Relation [") == 1 and "swir1" not in plan
    with pytest.raises(ValueError, match="twice"):
        c.metric("ndvi_spread", "ndvi")(lambda *a, **k: None)
    with pytest.raises(ValueError, match="twice"):
        c.sensor("L5", {}, 1984)
    with pytest.raises(ValueError, match="asked for twice"):
        c.compute(band_observations(spark, SF), ["ndvi_spread", "ndvi_spread"])
    with pytest.raises(KeyError, match="Unknown metric"):
        c.compute(band_observations(spark, SF), ["nothing"])
    c.sensor("NEW", {"red": "red"}, 1990)
    with pytest.raises(ValueError, match="has no bands"):
        c.index_column("ndvi")


def test_metric_of_another_index_and_service_years(spark):
    rows = [("s", 2000, d, s, 0.1, 0.5, 0.2, 0.3) for d in (160, 170, 180, 190) for s in ("L5", "L8")] + [("s", 2000, 10, "L5", None, 0.5, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "stand_id string, year int, doy int, sensor string, red double, nir double, swir1 double, swir2 double")
    r = AN.standard_catalogue().compute(df, ["ndvi_season_mean", "ndvi_season_contrast"]).first()
    assert r.ndvi_season_mean == pytest.approx(0.4 / 0.6) and r.ndvi_season_contrast is None and r.ndvi_season_contrast_reason == "n_obs=0 out of season < min_obs=2"
    r = AN.standard_catalogue().compute(df, ["ndvi_season_mean"], index="nbr").first()
    assert r.ndvi_season_mean == pytest.approx(0.2 / 0.8)


# --- sweep of shapes ----------------------------------------------------------------------------------
def ring(points):
    return [(float(x), float(y)) for x, y in points]


def shapes_frame(spark, shapes):
    return spark.createDataFrame([("g", run, k, vertices) for k, (run, vertices) in enumerate(shapes)], "unit string, run string, shape long, vertices array<struct<x:double,y:double>>")


def clipped(subject, clip):
    """Intersection of two convex rings (counter-clockwise)."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return []
    return out


def area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2 if points else 0.0


def test_union_of_slanted_shapes(spark):
    rng = random.Random(4)
    for _ in range(3):
        rings = []
        for _ in range(2):
            angle = sorted(rng.random() * 6.283 for _ in range(rng.randrange(3, 7)))
            x, y, r = rng.random() * 4, rng.random() * 4, 2 + rng.random() * 3
            rings.append(ring((x + r * np.cos(a), y + r * np.sin(a)) for a in angle))
        both = area(clipped(rings[0], rings[1]))
        frame = shapes_frame(spark, [("a", rings[0]), ("b", rings[1]), ("c", rings[0]), ("c", rings[1])])
        got = {r.run: r for r in U.union_areas(frame, ["a", "b", "c"], band=1.5, tile=2.0).collect()}
        assert got["a"].area == pytest.approx(area(rings[0])) and got["a"].in_b == pytest.approx(both, abs=1e-9) and got["b"].in_a == pytest.approx(both, abs=1e-9)
        assert got["c"].area == pytest.approx(area(rings[0]) + area(rings[1]) - both) and got["a"].in_c == pytest.approx(area(rings[0]))


def test_union_counts_overlaps_once_and_keeps_holes(spark):
    square = lambda x, y, s: ring([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])
    frame = shapes_frame(spark, [("a", square(0, 0, 10)), ("a", square(0, 0, 10)), ("a", square(5, 5, 10)), ("b", square(2, 2, 2))])
    hole = frame.unionByName(spark.createDataFrame([("g", "b", 9, square(20, 0, 10)), ("g", "b", 9, square(22, 2, 3))], frame.schema))
    got = {r.run: r for r in U.union_overlap(hole, ["a", "b"], band=4.0, tile=3.0).collect()}
    assert got["a"].area == pytest.approx(175) and got["b"].area == pytest.approx(4 + 91) and got["b"].a == pytest.approx(100 * 4 / 95)
    star = ring([(0, 0), (10, 10), (10, 0), (0, 10)])  # crosses itself: two triangles
    assert U.union_areas(shapes_frame(spark, [("a", star)]), ["a"], band=100.0, tile=100.0).first().area == pytest.approx(50)


# --- polygons to cells ---------------------------------------------------------------------------------
def test_runs_of_a_polygon_of_ten_thousand_vertices(spark):
    rng = np.random.default_rng(9)
    n = 10_000
    angle = np.sort(rng.random(n)) * 2 * np.pi
    r = 30 + 18 * rng.random(n)
    xs, ys = 50 + r * np.cos(angle), 50 + r * np.sin(angle)
    inner = ring([(45.0, 45.0), (55.0, 45.0), (55.0, 55.0), (45.0, 55.0)])
    zones = [("star", ring(zip(xs, ys, strict=True))), ("star", inner), ("edge", ring([(-5, -5), (3, -5), (3, 200), (-5, 200)])), ("none", ring([(300, 300), (301, 300), (301, 301)]))]
    df = spark.createDataFrame(zones, "zone string, vertices array<struct<x:double,y:double>>")
    got = defaultdict(set)
    for c in A.zone_cells(df, "zone", 1.0, 100, 100, (0.0, 100.0)).collect():
        got[c.zone].add((c.row, c.col))
    x, y = np.meshgrid(np.arange(100) + 0.5, 100 - (np.arange(100) + 0.5))

    def inside(points):
        odd = np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
        return odd

    star = inside(zones[0][1]) ^ inside(inner)
    assert got["star"] == {(int(a), int(b)) for a, b in zip(*np.nonzero(star), strict=True)} and len(got["star"]) > 3000
    assert got["edge"] == {(r, c) for r in range(100) for c in range(3)} and "none" not in got


def test_tile_cover_is_the_share_of_cells(spark):
    df = spark.createDataFrame([("p", ring([(1, 1), (30, 1), (30, 20), (1, 20)]))], "zone string, vertices array<struct<x:double,y:double>>")
    runs = A.zone_runs(df, "zone", 1.0, 64, 64, (0.0, 64.0))
    cells = A.zone_cells(df, "zone", 1.0, 64, 64, (0.0, 64.0)).groupBy(F.floor(F.col("row") / 16).alias("tr"), F.floor(F.col("col") / 16).alias("tc")).count()
    got = {(r.tr, r.tc): r.cover for r in A.tile_cover(runs, "zone", 16).collect()}
    assert got == {(r.tr, r.tc): r["count"] / 256 for r in cells.collect()}


# --- holes ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("tile", [3, 5, 64])
@pytest.mark.parametrize("touch", [True, False])
def test_holes_do_not_depend_on_tiles(spark, tile, touch):
    rng = np.random.default_rng(11)
    mask = rng.random((24, 22)) < 0.6
    mask[10, :] = False  # a long gap across all tiles
    grid = spark.createDataFrame([("u", 0, r, c, bool(mask[r, c])) for r in range(24) for c in range(22)], CELLS + ", f boolean")
    for largest in (1, 4, 9):
        roots = flood(~mask, False)
        members = defaultdict(list)
        for cell, root in roots.items():
            members[root].append(cell)
        want = {(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)}
        for part in members.values():
            border = any(r in (0, 23) or c in (0, 21) for r, c in part)
            if len(part) <= largest and (touch or not border):
                want |= {(int(r), int(c)) for r, c in part}
        got = G.fill_holes(grid.where("f"), grid, largest, touch_border=touch, tile=tile)
        assert {(r.row, r.col) for r in got.collect()} == want


def test_distances_of_several_masks(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((70, 30)) < 0.01, rng.random((70, 30)) < 0.03
    b[:, :10] = False
    df = to_cells(spark, np.where(a, 1.0, 0.0)[None] + np.where(b, 2.0, 0.0)[None])
    got = {(r.row, r.col): (r.a, r.b) for r in K.distances(df, {"a": F.col("z").isin(1.0, 3.0), "b": F.col("z") >= 2.0}, 5).collect()}
    y, x = np.mgrid[:70, :30]
    for k, mask in enumerate((a, b)):
        near = np.min([np.hypot(y - r, x - c) for r, c in zip(*np.nonzero(mask), strict=True)], axis=0)
        for (r, c), d in np.ndenumerate(near):
            assert got[r, c][k] == (pytest.approx(d) if d <= 5 else None)


# --- ranks and numbers -------------------------------------------------------------------------------------
def test_ranks_of_a_value_held_by_half_and_of_tiny_values(spark):
    rng = random.Random(8)
    values = [0.5] * 3000 + [10 ** -(6 + 6 * rng.random()) for _ in range(2000)] + [rng.random() for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    ranked = R.ordered_counts(df, [], "v", None)
    ordered = sorted(values)
    first = {}
    for i, v in enumerate(ordered):
        first.setdefault(v, i)
    got = {r.v: (r.n_below, r.n, r.n_total) for r in ranked.collect()}
    assert got == {v: (i, ordered.count(v), len(values)) for v, i in first.items()}
    narrow = R.ordered_counts(df.withColumn("k", F.lit("a")), ["k"], "v", 0.25)
    assert {r.v: (r.n_below, r.n, r.n_total) for r in narrow.collect()} == got
    ids = {r.v for r in ranked.withColumn("p", F.spark_partition_id()).select("v").collect()}
    assert len(ids) == len(first)


def test_numbers_follow_the_order(spark):
    rows = [(rng, k) for k, rng in enumerate(random.Random(1).sample(range(10_000), 3000))]
    out = R.numbered(spark.createDataFrame(rows, "v int, k int").repartition(9), "n", "v").collect()
    assert sorted(r.n for r in out) == list(range(1, 3001)) and [r.v for r in sorted(out, key=lambda r: r.n)] == sorted(v for v, _ in rows)
    assert R.numbered(spark.createDataFrame([], "v int"), "n", "v").count() == 0


def test_draws_find_their_value(spark):
    values = [1.0] * 500 + [2.0, 3.0, 3.0, 9.0]
    ranges = R.ordered_counts(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", None)
    draws = spark.range(len(values)).select(F.col("id").alias("i"), F.lit(10).alias("n"))
    got = {r.i: (r.v, r.n) for r in S._in_range(draws, ranges, "v").collect()}
    assert got == {i: (v, 10) for i, v in enumerate(sorted(values))}


# --- windows ---------------------------------------------------------------------------------------------
def test_window_table_refuses_and_keeps_empty_windows(spark):
    px = spark.createDataFrame([(r, c, None if r < 4 else 5.0, float(r * c % 7)) for r in range(9) for c in range(8)], "row int, col int, height double, band double")
    with pytest.raises(ValueError, match="Unknown window metrics"):
        WN.window_table(px, [4.0], 1.0, 9, 8, metrics=["heights", "x"])
    with pytest.raises(ValueError, match="need crowns"):
        WN.window_table(px, [4.0], 1.0, 9, 8)
    got = {(r.window_m, r.wr, r.wc): r for r in WN.window_table(px, [4.0, 8.0, 50.0], 1.0, 9, 8, metrics=["heights", "edges"]).collect()}
    assert set(got) == {(4.0, r, c) for r in (0, 1) for c in (0, 1)} | {(8.0, 0, 0)}
    assert got[4.0, 0, 0].n_valid == 0 and got[4.0, 0, 0].crown_fraction is None and got[8.0, 0, 0].crown_fraction == 1.0 and got[8.0, 0, 0].edge_density > 0


# --- streams ------------------------------------------------------------------------------------------------
def test_evidence_of_batches_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("u", r, c, t, float(v)) for t in range(5) for (r, c), v in np.ndenumerate(rng.normal(size=(9, 11))) if (r * 11 + c + t) % 7]
    rows[3] = (*rows[3][:4], None)
    schema = "unit string, row int, col int, t int, llr double"
    order, results = [[4, 0], [2], [1, 3]], []
    for parts in (order, [[0, 1, 2, 3, 4]]):
        folder, state, out = (str(tmp_path / f"{len(results)}{n}") for n in "abc")
        for part in parts:
            spark.createDataFrame([x for x in rows if x[3] in part], schema).write.mode("append").parquet(folder)
            stream = J.running_evidence(spark.readStream.schema(schema).parquet(folder), 0.05, decay=0.8, side=4)
            J.start_once(stream, lambda b, n, out=out: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), state).awaitTermination()
        force = J.evidence_in_force(spark.read.parquet(out)).collect()
        results.append({(r.row, r.col, r.t): (round(r.prob, 10), r.onset) for r in force})
    assert results[0] == results[1] and len(results[0]) == len(rows)
    for r, c in {(x[1], x[2]) for x in rows}:
        total, start = 0.0, -1
        for _, _, _, t, llr in sorted((x for x in rows if x[1:3] == (r, c)), key=lambda x: x[3]):
            carry = max(0.0, 0.8 * total)
            start = t if carry <= 0 else start
            total = carry + (llr or 0.0)
            assert results[0][r, c, t] == (pytest.approx(1 / (1 + 19 * np.exp(-total))), start if total > 0 else -1)


def test_folds_keep_the_result_and_replays_change_nothing(spark, tmp_path):
    path, keys, order = str(tmp_path / "rows"), ["k"], ["at"]
    sink = J.folding(J.upsert_sink(path, keys, order), path, keys, order, every=3)
    pick = random.Random(2)
    batches = [[(pick.randrange(6), pick.randrange(50), n * 10 + i) for i in range(8)] for n in range(8)]
    best = {}
    for n, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, "k int, at int, v int"), n)
        for k, at, v in rows:
            best[k] = max(best.get(k, (-1, -1, -1)), (at, n, v))
        last = {r.k: r.at for r in J.latest_rows(spark, path, keys, order).collect()}
        assert last == {k: b[0] for k, b in best.items()}
    assert J.folded_upto(spark, path) == 5
    before = sorted(map(tuple, J.latest_rows(spark, path, keys, order).collect()))
    for n in (1, 5, 7):
        sink(spark.createDataFrame(batches[n], "k int, at int, v int"), n)
    J.fold(spark, path, keys, order, 2)
    assert sorted(map(tuple, J.latest_rows(spark, path, keys, order).collect())) == before and J.folded_upto(spark, path) == 5
