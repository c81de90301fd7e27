"""Triangles, supports and what derives from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohesia.operators.canonical import degrees, doubled, orient
from cohesia.runtime import materialize, release


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Canonical ``(src, dst)`` as ``(e, src, dst)``; the caller materializes, for the ids are by place."""
    return edges.select(F.monotonically_increasing_id().alias("e"), "src", "dst")


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c, e1, e2, e3)`` once per triangle of canonical ``edges(src, dst, e)``.

    Edges are oriented by (degree, id). Pairs of out-neighbours of one vertex, in that order, are wedges; a wedge is a
    triangle if the edge between its ends exists: two equi joins, both on bounded out-degrees.
    """
    o = orient(edges)
    x = o.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.col("dst_degree").alias("dt"), F.col("e").alias("e1"))
    y = o.select(F.col("src").alias("s"), F.col("dst").alias("u"), F.col("dst_degree").alias("du"), F.col("e").alias("e2"))
    z = o.select(F.col("src").alias("t"), F.col("dst").alias("u"), F.col("e").alias("e3"))
    wedges = x.join(y, "s").where(F.struct("dt", "t") < F.struct("du", "u"))
    found = wedges.join(z, ["t", "u"])
    corners = F.array_sort(F.array("s", "t", "u"))
    return found.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"), "e1", "e2", "e3")


def edge_ids_from_ends(edges: DataFrame) -> DataFrame:
    """Edges with ``e`` as a struct of the ends: an id that needs no table written first."""
    return edges.select("src", "dst", F.struct("src", "dst").alias("e"))


def triangle_list(edges: DataFrame) -> DataFrame:
    return triangles(edge_ids_from_ends(edges)).select("a", "b", "c")


def triangle_count(edges: DataFrame) -> DataFrame:
    return triangle_list(edges).agg(F.count("*").alias("triangles"))


def triangles_per_vertex(edges: DataFrame) -> DataFrame:
    """``(id, triangles)`` of every vertex, zero included."""
    found = triangle_list(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    every = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return every.join(found, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """``(id, degree, triangles, coefficient)``: the share of a vertex's neighbour pairs that are edges; 0 under degree 2."""
    both = triangles_per_vertex(edges).join(degrees(edges), "id")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return both.select("id", "degree", "triangles", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(F.lit(0.0)).alias("coefficient"))


def support(edges: DataFrame) -> DataFrame:
    """``(src, dst, support)`` of every canonical edge: the triangles that hold it.

    The counts meet the edges in one union and aggregation, which combines before the shuffle; there is no join.
    """
    t = triangle_list(edges)
    sides = t.select(F.inline(F.array(*(F.struct(F.col(p).alias("src"), F.col(q).alias("dst"), F.lit(1).alias("n")) for p, q in (("a", "b"), ("a", "c"), ("b", "c"))))))
    return sides.unionByName(edges.select("src", "dst", F.lit(0).alias("n"))).groupBy("src", "dst").agg(F.sum("n").cast("int").alias("support"))


def support_capped(edges: DataFrame, cap: int, slices: int = 4, trace: list[int] | None = None) -> DataFrame:
    """``(src, dst, support)`` with supports of at most ``cap``; an edge is not counted further once it has that many.

    Third corners come in ``slices`` by their hash. In each, an edge meets the neighbours of its end of lower degree, and those that are
    neighbours of the other end too are counted; edges that reach the cap are in no further slice. A neighbour list is written
    once, by slices, and each is read in its own. ``trace`` gets the number of edges that each slice counts for.
    """
    plain = materialize(edges.select("src", "dst"), "edges")
    both = doubled(plain).select(F.col("src").alias("v"), F.col("dst").alias("w"), F.pmod(F.xxhash64("dst"), F.lit(slices)).cast("int").alias("slice"))
    lists = materialize(both, "near", by=["slice"])
    size = degrees(plain)
    for end in ("src", "dst"):
        plain = plain.join(size.select(F.col("id").alias(end), F.col("degree").alias(f"{end}_degree")), end)
    first = F.col("src_degree") <= F.col("dst_degree")
    # an edge whose end has no other neighbour is in no triangle
    ends = plain.select("src", "dst", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("v"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("o"), (F.least("src_degree", "dst_degree") > 1).alias("may"))
    counts = materialize(ends.select("src", "dst", "v", "o", "may", F.lit(0).alias("n")), "counts")
    full = []
    for i in range(slices):
        near = lists.where(F.col("slice") == i).select("v", "w")
        open_ = counts.where("may").where(F.col("n") < cap)
        if trace is not None:
            trace.append(open_.count())
        wedges = open_.select("src", "dst", "v", "o").join(near, "v").where("w <> o").select("src", "dst", "o", "w")
        closed = wedges.join(near.withColumnRenamed("v", "o"), ["o", "w"]).groupBy("src", "dst").agg(F.count("*").alias("more"))
        # edges that are done stay where they are
        full.append(counts.where(~F.col("may") | (F.col("n") >= cap)).select("src", "dst", "n"))
        left = open_.join(closed, ["src", "dst"], "left").select("src", "dst", "v", "o", "may", F.least(F.col("n") + F.coalesce("more", F.lit(0)), F.lit(cap)).cast("int").alias("n"))
        counts = materialize(left, "counts")
    release(plain, lists)
    return reduce(DataFrame.unionByName, full, counts.select("src", "dst", "n")).select("src", "dst", F.col("n").alias("support"))


def support_histogram(edges: DataFrame) -> DataFrame:
    return support(edges).groupBy("support").agg(F.count("*").alias("edges"))


def intersection_masks(edges: DataFrame) -> DataFrame:
    """``(src, dst, w, in_src, in_dst)``: for each edge every vertex next to either end, and next to which.

    Each end's neighbours are joined to the edge and the two lists add up in one aggregation.
    """
    near = doubled(edges.select("src", "dst")).select(F.col("src").alias("v"), F.col("dst").alias("w"))
    of_src = edges.select("src", "dst", F.col("src").alias("v")).join(near, "v").select("src", "dst", "w", F.lit(1).alias("s"), F.lit(0).alias("d"))
    of_dst = edges.select("src", "dst", F.col("dst").alias("v")).join(near, "v").select("src", "dst", "w", F.lit(0).alias("s"), F.lit(1).alias("d"))
    both = of_src.unionByName(of_dst).groupBy("src", "dst", "w").agg(F.max("s").alias("s"), F.max("d").alias("d"))
    return both.select("src", "dst", "w", (F.col("s") == 1).alias("in_src"), (F.col("d") == 1).alias("in_dst"))


def affected_edges(edges: DataFrame, dying: DataFrame) -> DataFrame:
    """Edges, dying ones included, that touch an end of a dying edge."""
    ends = dying.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    hit = edges.join(ends.withColumnRenamed("v", "src"), "src", "left_semi").select("src", "dst")
    more = edges.join(ends.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
    return hit.unionByName(more).distinct()


def out_intersection_masks(edges: DataFrame) -> DataFrame:
    """As :func:`intersection_masks` on the edges oriented by (degree, id): every vertex that either end leads to.

    An end leads to sqrt(2E) vertices at most, which bounds the rows; those that both ends lead to are the triangles.
    """
    o = orient(edges).select("src", "dst")
    near = o.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    of_src = o.select("src", "dst", F.col("src").alias("v")).join(near, "v").select("src", "dst", "w", F.lit(1).alias("s"), F.lit(0).alias("d"))
    of_dst = o.select("src", "dst", F.col("dst").alias("v")).join(near, "v").select("src", "dst", "w", F.lit(0).alias("s"), F.lit(1).alias("d"))
    both = of_src.unionByName(of_dst).groupBy("src", "dst", "w").agg(F.max("s").alias("s"), F.max("d").alias("d"))
    return both.select("src", "dst", "w", (F.col("s") == 1).alias("in_src"), (F.col("d") == 1).alias("in_dst"))
