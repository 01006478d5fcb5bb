"""Headline queries on the driver tables: one JSON line with seconds by query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the tables and cores.
Each query runs once to warm up and is then timed; its result is written to nowhere.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from cladeflow.plans.catalogue import QUERIES

HEADLINE = [
    "ogu_counts", "free_lca", "rank_region_split", "readmap_rows", "multi_rank_profile", "gene_match_80", "gene_match_profile", "size_normalised",
    "stratified_counts", "cover_ranges", "profile_cpm", "collapse_map", "collapse_divide", "coverage_percent", "filter_min_percent", "merge_additive",
]


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([\d.]+)", where)
    print(json.dumps({"metric": "seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
