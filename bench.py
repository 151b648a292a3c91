"""Timings of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sylvaflow.plans import QUERIES
from sylvaflow.session import get_spark

HEADLINE = [
    "obs_gate_counts", "annual_frame", "harmonic_fit", "theil_sen_trend", "stand_height_metrics", "stand_satellite_join", "stage_assign",
    "trajectory_assign", "block_cells", "pool_labels", "cell_change_brackets", "local_z", "smooth_z", "texture_entropy", "edge_density",
    "line_index", "null_fit", "lfdr_prob", "decide_spatial", "components", "mmu_objects", "detection_objects", "run_overlap",
    "route_verdicts", "latest_answers", "score_curve", "rank_auc", "weighted_scores", "audit_items", "chip_index",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    spark = get_spark("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/region.parquet").count()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
