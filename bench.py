"""Prints one JSON line: seconds of the headline queries (median of 3 after a warm-up run)."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from trailmark.plans import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ["st_range_count", "st_range_batch", "id_temporal_count", "id_temporal_batch", "grid_count", "knn_k50", "knn_k500",
            "knn_batch", "closest_pairs", "knn_join_per_point", "knn_join_timegap", "st_range_pruned", "id_temporal_pruned", "knn_pruned", "store_range", "layout_time_oid", "layout_z2", "layout_str", "block_index", "seg_meta", "selectivity",
            "pruning_ratio", "adaptive_route", "mbr_shape"]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
