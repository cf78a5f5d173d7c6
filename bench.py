"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local cores.
Each query runs twice and the faster run counts; building the query (with all tables it
writes on the way) and running it to the end are both in the time.
"""

from __future__ import annotations

import json
import os
import time

from epitide.plans.registry import QUERIES
from epitide.session import session

HEADLINE = [
    "weekly_counts", "valid_products", "sample_products", "ts_since_first", "available_semi", "season_nmax",
    "state_fold", "prefix_points", "profile_fit_sir", "fit_known_N", "profile_fit_bass", "next_state_pair",
    "grid_search_mle", "log_prefix_mle", "weighted_llh", "replicate_summary", "crossing_report", "stitched_peak",
    "median_over_replicates", "peak_report", "sample_threshold", "ecdf",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cores}]", int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
