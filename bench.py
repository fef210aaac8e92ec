"""Time every registered query; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_ONLY (comma-separated names)
set what is run. Each query is warmed up once; the median of the runs counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

from layerframe.plans.table_queries import QUERIES


def run_once(build, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("layerframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, build in QUERIES.items():
        if only and name not in only:
            continue
        run_once(build, spark, sf_dir)
        times = [run_once(build, spark, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(times), 4)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
