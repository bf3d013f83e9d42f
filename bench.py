"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from filamet.plans.catalog import QUERIES
from filamet.session import local_session

HEADLINE = [
    "a06_weighted_summary", "d03_weighted_histogram", "d04_ecdf", "d05_wasserstein", "j03_method_agreements", "d07_consensus",
    "d08_equal_image_mixture", "a01_section_statistics", "a03_fiber_level_summary", "a04_hierarchy", "w01_extrema_labels",
    "p12_quality_flags", "p30_midpoint_observation", "j01_nearest_reference", "a22_spearman", "a15_estimator_distances",
    "w03_fragments", "j10_mask_parity", "g01_components", "k04_tidy_measurements",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "filamet-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths before timing
    QUERIES["p01_included"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
