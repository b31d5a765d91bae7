"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the measured runs per query
(the median counts; one unmeasured run comes first). BENCH_ALL=1 times every query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from areascope.queries import QUERIES
from areascope.session import local_session

HEADLINE = [
    "holdout_index_r2", "weighted_tract_mean", "area_stats_wide", "national_rank",
    "area_deciles", "prefer_year_choice", "pivot_latest", "panel_complete", "share_of_universe",
    "composites_wide", "outer_join_frames", "api_survey", "masked_median", "clear_composite",
    "season_composite", "overview_pyramid", "encoded_map", "measure_distribution",
    "cv_r2_line", "cv_r2_vectors", "compare_six_sets", "residual_vectors",
    "sweep_states_vectors", "sweep_deciles_vectors", "pca_two", "ridge_on_components",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    names = sys.argv[1:] or names
    spark = local_session("areascope-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name].build(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
