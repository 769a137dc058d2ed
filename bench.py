"""Headline queries, timed to full materialisation; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "T05_top_terms",
    "T04_tf_idf",
    "T10_class_correlation",
    "A02_basic_summaries",
    "A04_six_numbers",
    "A16_radius_counts",
    "J08_cooccurring_pairs",
    "W03_running_total",
    "W12_not_sum_of_previous",
    "TS06_change_point",
    "TS09_trades",
    "TS12_trend_forecast",
    "M01_coefficient_table",
    "M09_agreement",
    "M21_knn_classify",
    "M27_outcome_shares",
    "G03_components",
    "G13_contained_totals",
    "S10_html_fields",
]


def main():
    from pyspark.sql import SparkSession

    from tallyloom.plans import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallyloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["A02_basic_summaries"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in only or HEADLINE:
        start = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
