"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from seriloom.catalog import load

HEADLINE = [
    "combine_indicators",
    "parallel_guard",
    "weekly_resample",
    "data_type_weekly",
    "resolve_entity",
    "weather_weekly",
    "neighbor_features",
    "quality_screen",
    "train_windows",
    "seasonal_naive_quantiles",
    "random_walk_quantiles",
    "find_peaks",
    "score_horizons",
    "metrics_per_series",
    "score_all_models",
    "pairwise_rwis",
    "experiment_rollup",
    "top_bottom_k",
    "type_aware_baseline",
    "status_map",
    "activity_score",
    "overall_summary",
    "covariate_gate",
    "wis_23",
    "sample_covariates",
    "series_points",
    "country_list",
    "read_partitioned_rounds",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seriloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES

    def run(name: str) -> float:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("weekly_resample")  # start the JVM's code paths before the clock counts
    times = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, best of two runs, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
