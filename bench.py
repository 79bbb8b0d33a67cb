"""Time the headline queries and print one JSON line.

Data comes from $BENCH_SF_DIR, cores from $BENCH_CPUS. Every query is timed from
reading the table to the last result row, including all passes that find out
kinds and counts; the time is the median of $BENCH_RUNS runs after one that warms up.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from fieldnotes import local_session
from fieldnotes.plans.catalog import QUERIES

HEADLINES = (
    "codebook_lineitem", "codebook_orders", "codebook_documents", "describe_numeric_large", "dist_hist_clamped",
    "dist_timeline_year", "dist_categorical_top", "compare_mean", "compare_discrete_label", "compare_large_median",
    "compare_joined_truncated", "rows_page_far", "rows_sorted", "rows_search", "infer_currency", "infer_dates_us",
    "delimited_codebook",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, int(cores), **{"spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).collect()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"), "cores": cores, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
