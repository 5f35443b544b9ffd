"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from terramark.plans.catalog import QUERIES  # noqa: E402

HEADLINE = ["markov_demand", "transition_counts", "accuracy", "area_projection", "neighbour_fraction", "same_class_support", "gradient_slope",
            "suitability_maps", "percentile_normalised", "stratified_sample", "transition_weights", "score_step", "class_summary", "change_maps"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["markov_demand"](spark, folder).collect()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
