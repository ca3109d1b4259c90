"""Headline queries on the given scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from honeyframe import catalog  # noqa: E402
from honeyframe.session import local_session  # noqa: E402

HEADLINE = (
    "area_mask", "count_runs", "fold_cells", "sample_hexagons", "scan_subframes", "frame_stats", "class_moments",
    "expand_orbit", "align_frames", "orbit_loglik", "baseline_loglik", "assign_cases", "em_models", "score_edits",
    "outlier_filter", "leave_one_out_mean", "route_frames", "knn_candidates", "trace_rings", "nearest_within",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = local_session(cpus, app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
