"""Times the headline queries and prints one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ["genre_drift_velocity", "genre_convergence_mean", "knn_topk", "novelty_per_movie", "medoid_per_group", "within_group_distance", "cluster_cosine_stats", "ks_distance", "histogram50", "token_entropy", "clean_funnel", "field_completeness", "preaggregated_optional_joins", "subclass_closure", "pca_explained"]


def main() -> None:
    from pyspark.sql import SparkSession

    from quillon.plans.queries import QUERIES

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().collect()
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
