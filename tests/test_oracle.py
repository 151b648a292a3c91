"""Queries against their SQL on the given tables.

By default a spread of queries; SYLVAFLOW_FULL=1 runs every query (about half an hour).
"""

from __future__ import annotations

import os

import pytest
from oracle import connect, difference

from sylvaflow.plans import ORACLES, QUERIES

SF = os.environ.get("SYLVAFLOW_SF", "/root/testdata/sf0.01")
SPREAD = [
    "obs_gate_counts", "harmonic_fit", "theil_sen_trend", "stand_height_metrics", "gap_persistence", "crown_stats", "window_cover", "quad_grid", "item_names", "encodings",
    "decision_filters", "forest_dips", "cell_change_brackets", "onset", "local_z", "smooth_z", "edge_density", "texture_entropy", "null_fit", "components", "mmu_objects",
    "parse_verdicts", "latest_answers", "route_verdicts", "alloc_strata", "keyed_sample", "seed_windows", "sample_weights", "score_curve", "interval_scores", "judged_table",
    "rank_auc", "run_overlap", "interval_reasons", "chip_index", "crowns_in_stand", "review_store", "stream_latest",
    "decide_full", "decide_bracketed", "distance_bins", "assign_blocks", "stored_observations", "batch_units", "stream_dedup", "window_labels", "labelled_sample",
    "inspection_sample", "annual_metrics", "union_overlap", "described_tiles", "grid_blocks", "nearby_objects",
]
NAMES = sorted(ORACLES) if os.environ.get("SYLVAFLOW_FULL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(ORACLES[name])
    message = difference(rows, df.columns, cursor.fetchall(), [c[0] for c in cursor.description])
    assert message is None, message
    assert rows


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
