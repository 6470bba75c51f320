"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1). BENCH_CPUS: threads of the local master (default 8).
Every query runs once to warm up, then RUNS times; its figure is the median, from call to collected result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.plans.queries import QUERIES

RUNS = 3
HEADLINE = ["ols_two_regressors", "ols_robust", "ols_cluster", "cluster_two_way", "fe_one_way", "fe_many_groups_with_singletons", "fe_two_way", "fe_three_way_cluster", "fe_level_and_slope", "iv_just_identified", "iv_fe_cluster", "partial_out"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        QUERIES[name](spark, sf_dir).collect()
        taken = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).collect()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
