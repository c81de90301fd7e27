"""Triangles by a grid of tiles: no wedge is ever shuffled.

Vertices are hashed into ``b`` buckets. A tile is a sorted choice of three buckets, repeats allowed; an edge goes to each tile that
has the buckets of its ends, ``b`` of them. All edges of a triangle meet in the tile of its corners' buckets, where neighbour lists are
merged. The shuffle moves b rows an edge, however many wedges there are, and b follows from the edges between any two buckets, which are
counted, and from what one tile may hold. A tile is a partition; its triangles leave it in steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cohesia.operators.canonical import orient
from cohesia.runtime import counted, materialize

#: Edges of one tile: two ids each, and about ten times that at work.
TILE_EDGES = 1_000_000
#: By how much a tile may exceed that before the grid is made finer.
TILE_SLACK = 1.5
_STEP = 1 << 20


def buckets_for(edges: int, most: int = TILE_EDGES) -> int:
    """The fewest buckets at which a tile of three different ones has ``most`` edges or less: three of its bucket pairs, each one of b * b / 2."""
    return max(1, math.ceil(math.sqrt(6 * edges / most)))


def _bucket(end: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(end), F.lit(buckets)).cast("int")


def largest_tile(oriented: DataFrame, buckets: int) -> int:
    """How many edges the largest tile gets; the driver sees a count for each pair of buckets."""
    i, j = _bucket("src", buckets), _bucket("dst", buckets)
    between = np.zeros((buckets, buckets), np.int64)
    for r in oriented.groupBy(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).agg(F.count("*").alias("n")).collect():
        between[r.i, r.j] = between[r.j, r.i] = r.n
    most, inside = 0, between.diagonal()
    two = between - np.diag(inside)
    for x in range(buckets):
        twice = two[x] + inside[x]  # tiles x, x, y
        apart = two[x][:, None] + two[x][None, :] + two  # tiles x, y, z
        np.fill_diagonal(apart, 0)
        apart[x, :] = apart[:, x] = 0
        most = max(most, int(twice.max()), int(apart.max()))
    return most


def buckets_that_fit(oriented: DataFrame, edges: int, least: int = 1, most: int = TILE_EDGES) -> int:
    """At least ``least`` buckets, and so many that no tile has over ``TILE_SLACK`` times ``most`` edges.

    Edges of a vertex of very high degree share one of their buckets, so tiles are counted, not estimated from the mean. The end is where
    the mean is one edge; even a star's tiles have about the root of its edges then.
    """
    buckets, end = max(least, buckets_for(edges, most)), buckets_for(edges, 1)
    while buckets < end and (largest := largest_tile(oriented, buckets)) > TILE_SLACK * most:
        buckets = min(end, max(buckets + 1, math.ceil(buckets * math.sqrt(largest / most))))
    return buckets


def _merges(s: np.ndarray, t: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """``(s, t, u)`` of all triangles of the oriented edges between vertices 0 to n - 1, s before t before u in the orientation, in steps of bounded size."""
    order = np.lexsort((t, s))
    s, t = s[order], t[order]
    key = s * n + t
    first = np.searchsorted(s, np.arange(n + 1))
    degree = np.diff(first)
    # of an edge's two ends the one with fewer neighbours is walked, each neighbour looked up among those of the other
    walk_t = degree[t] <= degree[s]
    walked, other = np.where(walk_t, t, s), np.where(walk_t, s, t)
    upto = np.concatenate([[0], np.cumsum(degree[walked])])
    start = 0
    while start < len(s):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + _STEP, side="right")) - 1)
        m = degree[walked[start:end]]
        edge = np.repeat(np.arange(start, end), m)
        u = t[np.repeat(first[walked[start:end]] - (upto[start:end] - upto[start]), m) + np.arange(len(edge))]
        wanted = other[edge] * n + u
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        hit = key[at] == wanted
        yield np.stack([s[edge[hit]], t[edge[hit]], u[hit]], axis=1)
        start = end


def merged(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """``(s, t, u)`` of all triangles of the oriented edges, s before t before u in the orientation."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return ids[np.concatenate([np.zeros((0, 3), np.int64), *_merges(ends[: len(src)], ends[len(src) :], len(ids))])]


def _tile(cells: pa.Table) -> Iterator[pa.RecordBatch]:
    """The triangles of one tile; a tile also sees some whose corners use fewer of its buckets, which belong to another one."""
    both = [np.concatenate([cells[x].to_numpy(), cells[y].to_numpy()]) for x, y in (("src", "dst"), ("i", "j"))]
    ids, at, ends = np.unique(both[0], return_index=True, return_inverse=True)
    bucket, own = both[1][at], cells["tile"][0].as_py()
    del both, at
    for tri in _merges(ends[: len(cells)], ends[len(cells) :], len(ids)):
        tri = np.sort(ids[tri[_number(*np.sort(bucket[tri], axis=1).T.astype(np.int64)) == own]], axis=1)
        if len(tri):
            yield pa.RecordBatch.from_arrays([pa.array(tri[:, i], pa.int64()) for i in range(3)], names=list("abc"))


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triangles of a partition's tiles, of which there is one."""
    if not (held := list(batches)):
        return
    cells = pa.Table.from_batches(held)
    tiles = np.unique(cells["tile"].to_numpy())
    for tile in tiles:
        yield from _tile(cells if len(tiles) == 1 else cells.filter(pc.equal(cells["tile"], int(tile))))


def _number(x, y, z):
    """The place, from 0, of buckets x <= y <= z among all such choices; of numbers, arrays or columns."""
    return z * (z + 1) * (z + 2) / 6 + y * (y + 1) / 2 + x


def tiled(edges: DataFrame, buckets: int) -> DataFrame:
    """``(tile, src, dst, i, j)``: each oriented edge once in every tile that it belongs to, with its ends' buckets."""
    return _tiled(orient(edges.select("src", "dst")), buckets)


def _tiled(oriented: DataFrame, buckets: int) -> DataFrame:
    o = oriented.select(F.col("src").cast("long"), F.col("dst").cast("long"), _bucket("src", buckets).alias("i"), _bucket("dst", buckets).alias("j"))
    third = o.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("k"))
    low, high = F.least("i", "j", "k"), F.greatest("i", "j", "k")
    middle = F.col("i") + F.col("j") + F.col("k") - low - high
    return third.select(_number(low, middle, high).cast("int").alias("tile"), "src", "dst", "i", "j")


def triangle_list_tiled(edges: DataFrame, buckets: int | None = None, most: int = TILE_EDGES) -> DataFrame:
    """``(a, b, c)`` once per triangle of canonical edges, a < b < c; ``buckets`` is the fewest, there are more where a tile would hold too much."""
    oriented, n = counted(orient(edges.select("src", "dst")).select("src", "dst"), lambda df: materialize(df, "oriented"))
    buckets = buckets_that_fit(oriented, n, buckets or 1, most)
    tiles = _tiled(oriented, buckets).repartitionById(buckets * (buckets + 1) * (buckets + 2) // 6, "tile")
    return tiles.mapInArrow(_partition, "a long, b long, c long")
