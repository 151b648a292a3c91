"""Objects around every box against brute force."""

from __future__ import annotations

import numpy as np

from sylvaflow.operators import spatial as A
from sylvaflow.plans import QUERIES
from sylvaflow.plans.label_queries import boxes

SF = "/root/testdata/sf0.001"


def test_every_box_is_searched_around(spark):
    b = boxes(spark, SF).toPandas().astype(float)
    x0, x1, y0, y1, ids, ha = (b[c].to_numpy() for c in ("minx", "maxx", "miny", "maxy", "object_id", "area_ha"))
    refined = ids % 3 == 0
    want = {}
    for i in range(len(b)):
        near = (x1 >= x0[i] - 300) & (x0 <= x1[i] + 300) & (y1 >= y0[i] - 300) & (y0 <= y1[i] + 300)
        want[int(ids[i])] = (int(near.sum()), int((near & refined).sum()), round(float(np.where(refined, 2 * ha, ha)[near].sum()), 4))
    got = {r.focus_id: (r.n, r.refined, round(float(r.area_ha), 4)) for r in QUERIES["nearby_every_object"](spark, SF).collect()}
    assert len(want) == len(b) and got == want


def test_pairs_are_the_same_with_one_box(spark):
    rng = np.random.default_rng(5)
    low = rng.integers(-6, 6, (60, 2)) * 5.0  # many boxes touch a tile border or the radius
    rows = [(i, x, x + w, y, y + h) for i, ((x, y), (w, h)) in enumerate(zip(low.tolist(), (rng.integers(0, 4, (60, 2)) * 5.0).tolist()))]
    objects = spark.createDataFrame([*rows, *rows[:5]], "object_id int, minx double, maxx double, miny double, maxy double")
    focus = objects.withColumnRenamed("object_id", "focus_id")
    pairs = [sorted((r.focus_id, r.object_id) for r in A.nearby(objects, focus, 10.0, 10.0, one_box=one).collect()) for one in (True, False)]
    want = sorted((f[0], o[0]) for f in rows for o in rows if o[2] >= f[1] - 10 and o[1] <= f[2] + 10 and o[4] >= f[3] - 10 and o[3] <= f[4] + 10)
    assert pairs == [want, want]
