"""Cleaning and canonical forms of edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohesia.runtime import materialize, release, shuffle_parts


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def canonicalise(edges: DataFrame) -> DataFrame:
    """Loops dropped, ``{a, b}`` in the order a < b, once."""
    return drop_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def multiplicities(edges: DataFrame) -> DataFrame:
    """Canonical edges with ``n``, the rows that gave each."""
    return drop_loops(edges).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("n"))


def first_rows(edges: DataFrame, order: Sequence[str], directed: bool = False) -> DataFrame:
    """For each unordered pair, or each ordered one if ``directed``, its first row by ``order``, as that row is.

    The least row is an aggregate with map-side combine, so a pair that repeats without end is no hot window.
    """
    rest = [c for c in edges.columns if c not in order]
    picked = F.min(F.struct(*order, *rest)).alias("row")
    ends = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    best = drop_loops(edges).groupBy(ends[0].alias("_a"), ends[1].alias("_b")).agg(picked)
    return best.select(*(F.col("row").getField(c).alias(c) for c in edges.columns))


def ascending(edges: DataFrame) -> DataFrame:
    """The rows with src < dst, other columns as they are."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def doubled(edges: DataFrame) -> DataFrame:
    """Both directions of canonical edges with all other columns; needs no shuffle."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    both = F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(*rest, F.inline(both))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree)`` of the vertices of canonical edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def dense_index(rows: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """``rows`` with their place, from 0, in the order given.

    A range partitioning sorts; the sizes of its parts, one number each, give the offsets. No task sees all rows.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    marked = materialize(ordered.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    sizes = marked.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r.p, total))
        total += r.n
    offsets = spark.createDataFrame(starts, "_p long, _start long")
    joined = marked.join(F.broadcast(offsets), F.shiftright("_m", 33) == F.col("_p"))
    return joined.withColumn(name, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_start")


def rank_by_degree(edges: DataFrame) -> DataFrame:
    """``(id, degree, idx)``: dense numbers by ascending degree, ties by id."""
    return dense_index(degrees(edges), "degree", "id")


def orient(edges: DataFrame) -> DataFrame:
    """Edges from the vertex of lower (degree, id) to the higher one, with the latter's degree: ``(src, dst, dst_degree, ...)``.

    No vertex has more than sqrt(2E) edges out then, which bounds the wedges that any join below makes.
    """
    d = degrees(edges)
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    both = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    return both.select(
        F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"),
        F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"),
        F.greatest("ds", "dd").alias("dst_degree"),
        *rest,
    )


def oriented_index(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(id, degree, idx)`` and edges ``(src_idx, dst_idx, edge_id)``, edge ids by (src_idx, dst_idx)."""
    vertices = rank_by_degree(edges)
    a, b = vertices.select(F.col("id").alias("src"), F.col("idx").alias("i")), vertices.select(F.col("id").alias("dst"), F.col("idx").alias("j"))
    renamed = edges.join(a, "src").join(b, "dst").select(F.least("i", "j").alias("src_idx"), F.greatest("i", "j").alias("dst_idx"))
    return vertices, dense_index(renamed, "src_idx", "dst_idx", name="edge_id")


def two_core(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Canonical edges that stay when vertices of degree one are removed until there are none."""
    old, n = materialize(edges, "core"), None
    n = old.count()
    for _ in range(max_rounds):
        inner = degrees(old).where("degree > 1").select("id")
        new = materialize(old.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"), "core")
        release(old)
        left = new.count()
        if left == n:
            return new.select("src", "dst")
        old, n = new, left
    raise RuntimeError("no fixed point")
