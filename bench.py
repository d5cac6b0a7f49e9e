"""Headline queries, timed; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans.queries import QUERIES  # noqa: E402

NAMES = ("flagship_score", "features_vector", "knn_grid", "kmeans_build", "ivf_exact", "ivf_q16", "grid_quantize", "affine_quantize", "confusion", "dist_l2", "score_requests")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["features_vector"](spark, sf).limit(1000).write.format("noop").mode("overwrite").save()  # starts executors and Python workers; not counted
    for n in NAMES:
        t = time.time()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - t, 3)
    pairs = 500 * 99_500 if sf.rstrip("/").endswith("sf0.1") else None
    extra = {"knn_pairs_per_s": round(pairs / took["knn_grid"])} if pairs else {}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2], **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
