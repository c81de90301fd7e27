"""Command line: reads an edge list, decomposes it and writes each edge's trussness, with k_max and timings on standard output."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession, functions as F

from cohesia.operators.access import Graph
from cohesia.operators.truss import k_truss, trussness
from cohesia.runtime import importable, materialize, release


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohesia", description=__doc__)
    parser.add_argument("--graph", required=True, help="edge list, text, two ids a line")
    parser.add_argument("--output", required=True, help="folder for the result, Parquet")
    parser.add_argument("--k", type=int, help="only the edges of the k-truss")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    importable(spark)
    began = time.time()
    edges = materialize(Graph.read(spark, options.graph).edges, "edges")
    n, read = edges.count(), time.time()
    found = trussness(edges) if options.k is None else k_truss(edges, options.k)
    found.write.mode("overwrite").parquet(options.output)
    done = time.time()
    written = spark.read.parquet(options.output)
    if options.k is None:
        print(f"k_max {written.agg(F.max('trussness')).first()[0] or 0}")
    print(f"edges {n}, in the result {written.count()}")
    print(f"reading {read - began:.2f} s, decomposition {done - read:.2f} s")
    release(edges)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
