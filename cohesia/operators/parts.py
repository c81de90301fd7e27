"""Trussness by parts that are peeled apart and meet in their boundary edges.

An edge with both ends in one part is a core edge, any other a boundary edge. All triangles of a part's core edges have their three
edges in the part or next to it, and no triangle has core edges of two parts. So given values of the boundary edges, a part's core edges
follow from the part alone, and parts are solved side by side, one group of bounded size each. Boundary edges start at their supports,
which no trussness exceeds, and fall to the h-index of what their triangles hold; parts next to one that fell are solved again. All values stay
at or above the trussness and end at a common fix point, which is the trussness of the whole graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cohesia.operators.triangles import triangles, with_edge_ids
from cohesia.runtime import materialize, release

#: Triangles of a part's core edges: three ids each, 48 MB, and about five times that at work.
PART_TRIANGLES = 2_000_000
MAX_ROUNDS = 100_000


def solve_part(tri: np.ndarray, core: np.ndarray, bounds: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and levels (trussness - 2) of the core edges of ``tri``, whose other edges stay at the levels ``bounds``.

    ``core`` has the shape of ``tri``. Peeling: at level l core edges in at most l triangles go, and other edges whose bound is l.
    """
    ids, sides = np.unique(tri, return_inverse=True)
    sides = sides.reshape(tri.shape)
    inner = np.zeros(len(ids), bool)
    inner[sides[core]] = True
    count = np.bincount(sides.ravel(), minlength=len(ids))
    limit = np.array([np.iinfo(np.int64).max if own else bounds[i] for i, own in zip(ids.tolist(), inner.tolist())], np.int64)
    level, alive, l = np.zeros(len(ids), np.int64), np.ones(len(ids), bool), 0
    while (alive & inner).any():
        key = np.where(inner, count, limit)
        l = max(l, int(key[alive].min()))
        dying = alive & (key <= l)
        level[dying] = l
        alive &= ~dying
        dead = dying[sides].any(axis=1)
        count -= np.bincount(sides[dead].ravel(), minlength=len(ids))
        sides = sides[~dead]
    return ids[inner], level[inner]


def _solve(tri: pa.Table, edge: pa.Table) -> pa.Table:
    sides = np.stack([tri[c].to_numpy() for c in ("e1", "e2", "e3")], axis=1) if len(tri) else np.zeros((0, 3), np.int64)
    core = np.stack([tri[c].to_numpy(zero_copy_only=False) for c in ("c1", "c2", "c3")], axis=1) if len(tri) else np.zeros((0, 3), bool)
    ids, level = solve_part(sides, core, dict(zip(edge["e"].to_pylist(), edge["v"].to_pylist())))
    return pa.table({"e": pa.array(ids, pa.int64()), "v": pa.array(level, pa.int32())})


def bounded_parts(found: DataFrame, part: DataFrame, most: int) -> DataFrame:
    """``(id, part)`` with parts as text: those whose core edges are in more than ``most`` of ``found(a, b, c)`` are cut in halves, by a hash of the id, until none are."""
    part = materialize(part.select("id", F.col("part").cast("string").alias("part")), "parts")
    for turn in range(64):
        placed = found.select("a", "b", "c")
        for x in "abc":
            placed = placed.join(part.select(F.col("id").alias(x), F.col("part").alias(f"p_{x}")), x)
        core = F.when((F.col("p_a") == F.col("p_b")) | (F.col("p_a") == F.col("p_c")), F.col("p_a")).when(F.col("p_b") == F.col("p_c"), F.col("p_b"))
        large = materialize(placed.select(core.alias("part")).where("part is not null").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > most).select("part", F.lit(True).alias("large")), "large")
        if not large.limit(1).count():
            release(large)
            return part
        half = F.concat("part", F.lit("."), F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)).cast("string"))
        new = materialize(part.join(large, "part", "left").select("id", F.when(F.col("large"), half).otherwise(F.col("part")).alias("part")), "parts")
        release(part, large)
        part = new
    raise RuntimeError("parts do not get smaller")


def trussness_by_parts(edges: DataFrame, part: DataFrame, most: int = PART_TRIANGLES) -> DataFrame:
    """``(src, dst, trussness)`` of canonical edges, from ``part(id, part)`` of their vertices; any parts give the same result."""
    with_ids = materialize(with_edge_ids(edges), "edges")
    found = materialize(triangles(with_ids), "triangles")
    part = bounded_parts(found, part, most)
    ends = [part.select(F.col("id").alias(x), F.col("part").alias(f"p_{x}")) for x in ("src", "dst")]
    core = materialize(with_ids.join(ends[0], "src").join(ends[1], "dst").where("p_src = p_dst").select("e", F.col("p_src").alias("part")), "core")
    placed = found.select("e1", "e2", "e3")
    for i in (1, 2, 3):
        placed = placed.join(core.select(F.col("e").alias(f"e{i}"), F.col("part").alias(f"p{i}")), f"e{i}", "left")
    flags = [F.col(f"p{i}").isNotNull().alias(f"c{i}") for i in (1, 2, 3)]
    placed = materialize(placed.select("e1", "e2", "e3", *flags, F.coalesce("p1", "p2", "p3").alias("part")), "placed")
    release(found)
    sides = F.array(*(F.struct(F.col(f"e{i}").alias("e"), F.col(f"c{i}").alias("core"), F.col(f"e{j}").alias("f"), F.col(f"e{k}").alias("g")) for i, j, k in ((1, 2, 3), (2, 1, 3), (3, 1, 2))))
    sided = placed.select("part", F.inline(sides))
    outer = materialize(sided.where("not core").select("e", "f", "g"), "outer")
    touched = materialize(sided.where("not core and part is not null").select("part", "e").distinct(), "touched")
    inner = placed.where("part is not null")

    def solved(of: DataFrame, bounds: DataFrame) -> DataFrame:
        near = touched.join(bounds, "e").select("part", "e", "v")
        return of.groupBy("part").cogroup(near.groupBy("part")).applyInArrow(_solve, "e long, v int")

    bounds = materialize(outer.groupBy("e").agg(F.count("*").cast("int").alias("v")), "bounds")
    values = materialize(solved(inner, bounds), "values")
    for _ in range(MAX_ROUNDS):
        every = values.unionByName(bounds)
        f, g = (every.select(F.col("e").alias(x), F.col("v").alias(f"v{x}")) for x in "fg")
        offers = outer.join(f, "f").join(g, "g").groupBy("e", F.least("vf", "vg").alias("o")).agg(F.count("*").alias("n"))
        reach = F.sum("n").over(W.partitionBy("e").orderBy(F.desc("o")))
        index = offers.select("e", F.least("o", reach).alias("h")).groupBy("e").agg(F.max("h").alias("h"))
        new = materialize(bounds.join(index, "e").select("e", F.least("v", "h").cast("int").alias("v"), (F.col("h") < F.col("v")).alias("fell")), "bounds")
        again = materialize(touched.join(new.where("fell").select("e"), "e", "left_semi").select("part").distinct(), "again")
        if not new.where("fell").limit(1).count():
            break
        part_of = core.join(again, "part", "left_semi").select("e")
        fresh = solved(inner.join(again, "part", "left_semi"), new.select("e", "v"))
        replaced = materialize(values.join(part_of, "e", "left_anti").unionByName(fresh), "values")
        release(bounds, values, again)
        bounds, values = new.drop("fell"), replaced
        bounds._cohesia_path = new._cohesia_path
    else:
        raise RuntimeError("no fixed point")
    found = with_ids.join(values.unionByName(bounds.select("e", "v")), "e", "left")
    return found.select("src", "dst", (F.coalesce("v", F.lit(0)) + 2).cast("int").alias("trussness"))
