"""Times the headline queries and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from cohesia.plans import catalogue
from cohesia.runtime import importable

HEADLINE = ("canonical_edges", "oriented_edges", "triangle_count", "edge_support", "trussness", "trussness_h_index", "ktruss_4", "truss_layers", "support_after_removal", "neighbour_intersection_masks")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    catalogue.QUERIES["edge_support"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compile
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
