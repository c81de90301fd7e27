"""Connected components of a link table, for links of any number and hubs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohesia.runtime import materialize, release


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``: label is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is two aggregations and
    two equi joins; no neighbour list is ever collected, so a hub costs rows, not a task's memory. Each round's
    table goes to the shared folder. An empty table gives an empty result.
    """
    old = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(old)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = old.unionByName(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "cc")
        release(old)
        old, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return old.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        old.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _mark(table: DataFrame) -> tuple:
    return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
