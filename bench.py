"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from morphotab.plans.measurement_view import measurements  # noqa: E402
from morphotab.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "derive_all",
    "harmonise",
    "kruskal",
    "anova",
    "pearson",
    "boxplot_summary",
    "kde",
    "violin",
    "density2d",
    "histogram",
    "remove_outliers",
    "avg_rank",
    "profile_numeric",
    "bin_thresholds",
    "boxplot_summary_group",
    "outliers",
    "coalesce_rows",
    "read_stat_tree",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("morphotab-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    times = {"measurement_view": timed(lambda: measurements(spark, sf_dir))}
    again = {}
    for name in HEADLINE:

        def run(name=name) -> None:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

        # building the query counts; the first run also compiles the generated code
        times[name], again[name] = timed(run), timed(run)
    out = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "second_run": again,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
