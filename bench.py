"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Each query runs once cold and is timed on the runs after."""

import json
import os
import sys
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")

HEADLINES = ["orphan_posts", "low_outbound_posts", "top_linked_posts", "summary", "broken_links", "pending_suggestions", "document_frequency", "top_terms", "cosine", "extract_links", "internal_links", "incremental_stats", "target_pool"]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    from pyspark.sql import SparkSession

    from linkscope.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINES:
        times = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
