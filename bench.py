"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads and ``BENCH_RUNS`` the timed
runs per query, of which the median counts after one untimed run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rentatlas.plans.catalogue import PERIOD_TABLES  # noqa: E402
from rentatlas.session import required_conf  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "units_filter", "update_lag", "coord_override", "project_to_state_plane",
    "pip_parcels_one", "pip_parcels_one_shuffled", "pip_parcels_all", "pip_zip",
    "latest_per_parcel", "join_starts", "join_completions_fanout", "year_built_override",
    "counts", "sum_muni", "sum_ct_age", "summaries_one_pass", "annual_one_pass",
    "period_end_to_end",
]


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rentatlas-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def warm(name: str) -> float:
        seconds(spark, name, sf_dir)
        return round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)

    with required_conf(spark):
        timings = {name: warm(name) for name in HEADLINE}
        # The ten separate summaries that ``summaries_one_pass`` replaces, warm as the others.
        timings["summaries_ten_passes"] = round(
            sum(timings.get(name) or warm(name) for name in (f"sum_{p.name}" for p in PERIOD_TABLES)),
            3,
        )
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "points_per_sec": round(points / timings["pip_parcels_one_shuffled"]),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
