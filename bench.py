"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pixelweave.plans import registry
from pixelweave.session import local_session

HEADLINE = """msd_ensemble track_features linking_stats direction_autocorrelation
zproject normalize_percentile mean_filter gaussian_blur sobel region_properties connected_components
calcium_events nearest_neighbour neighbour_counts duplicate_remove molecular_merge local_density_filter
render_histogram render_gaussian linear_unmix count_summary link_greedy""".split()


def shuffled_mb(spark) -> float:
    """Shuffle bytes written so far by all executors, in MB."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) / 1e6


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus), app="bench")
    queries = registry.queries()
    # start the JVM, the code cache and the Python workers outside the clock
    queries["motion_regimes"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times, moved = {}, {}
    for name in names:
        start, before = time.time(), shuffled_mb(spark)
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        moved[name] = round(shuffled_mb(spark) - before, 1)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "shuffle_mb": moved, "sf": sf.rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
