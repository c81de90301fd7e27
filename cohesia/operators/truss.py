"""Truss decomposition and k-truss search.

Triangles are listed once and stored with their edges' ids; every method works on that table. While it is large, rounds
are DataFrame plans whose tables go to the shared folder. Once no more than ``local_below`` triangles are left, a number
that is checked, one task finishes them in a few array operations per level. Both give the same result.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window as W, functions as F

from cohesia.operators.canonical import doubled
from cohesia.operators.triangles import support, triangles, with_edge_ids
from cohesia.runtime import Grown, counted, materialize, release

#: Triangles that one task may finish: three ids each, 48 MB, and about five times that at work.
LOCAL_BELOW = 2_000_000
MAX_ROUNDS = 100_000


@dataclass
class Listed:
    """Canonical edges with ids, and the ids of each triangle's edges; both are tables in the shared folder."""

    edges: DataFrame
    triangles: DataFrame
    n_triangles: int

    @classmethod
    def of(cls, edges: DataFrame) -> Listed:
        with_ids = materialize(with_edge_ids(edges), "edges")
        found = materialize(triangles(with_ids).select("e1", "e2", "e3"), "triangles")
        return cls(with_ids, found, found.count())

    def labelled(self, values: DataFrame, name: str, otherwise: int) -> DataFrame:
        """``(src, dst, name)`` for all edges from ``values(e, name)``."""
        joined = self.edges.join(values, "e", "left")
        return joined.select("src", "dst", F.coalesce(name, F.lit(otherwise)).cast("int").alias(name))


_SIDES = ("e1", "e2", "e3")


def _counts(tri: DataFrame) -> DataFrame:
    """``(e, s)``: in how many of ``tri`` each edge is."""
    return tri.select(F.explode(F.array(*_SIDES)).alias("e")).groupBy("e").agg(F.count("*").cast("int").alias("s"))


def peel_arrays(tri: np.ndarray, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edge ids and their levels (trussness - 2) of an array of triangles, by peeling; with ``stop``, edges that outlast level ``stop`` get ``stop + 1``."""
    ids, sides = np.unique(tri, return_inverse=True)
    sides = sides.reshape(tri.shape)
    count = np.bincount(sides.ravel(), minlength=len(ids))
    level = np.zeros(len(ids), np.int64)
    alive, l = np.ones(len(ids), bool), 0
    while alive.any():
        l = max(l, int(count[alive].min()))
        if stop is not None and l > stop:
            level[alive] = stop + 1
            break
        dying = alive & (count <= l)
        level[dying] = l
        alive &= ~dying
        dead = dying[sides].any(axis=1)
        count -= np.bincount(sides[dead].ravel(), minlength=len(ids))
        sides = sides[~dead]
    return ids, level


def _finish(stop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(i).to_numpy() for i in range(3)], axis=1) for b in batches]
        ids, level = peel_arrays(np.concatenate([np.zeros((0, 3), np.int64), *parts]), stop)
        yield pa.record_batch([pa.array(ids), pa.array((level + 2).astype(np.int32))], ["e", "trussness"])

    return run


def _in_one_task(tri: DataFrame, stop: int | None = None) -> DataFrame:
    return tri.coalesce(1).mapInArrow(_finish(stop), "e long, trussness int")


def trussness(edges: DataFrame, local_below: int = LOCAL_BELOW) -> DataFrame:
    """``(src, dst, trussness)`` of every canonical edge; 2 for those in no triangle."""
    g = Listed.of(edges)
    found = _in_one_task(g.triangles) if g.n_triangles <= local_below else _by_h_index(g)
    return g.labelled(found, "trussness", 2)


def trussness_h_index(edges: DataFrame) -> DataFrame:
    g = Listed.of(edges)
    return g.labelled(_by_h_index(g), "trussness", 2)


def _by_h_index(g: Listed, compact: float = 0.25, trace: list[tuple[int, int]] | None = None) -> DataFrame:
    """Local fix point (Sariyuce, Seshadhri, Pinar, 2018): an edge's value becomes the h-index of what its triangles hold.

    A triangle offers an edge the least value of its other two. Offers are counted per value before they are ranked, so
    an edge in very many triangles is ranked over few rows.

    A round in which more than ``compact`` times all edges fell is followed by one that looks at all of them and writes all values. Otherwise the
    next one looks only at edges that can change: those in a triangle with an edge that fell below their own value. What falls then goes to
    a log; all values are written again when the log holds more than ``compact`` times their number. Both kinds of rounds give the same values.
    ``trace`` gets each round's numbers of edges looked at and of edges that fell.
    """
    spark = g.edges.sparkSession
    turns = ((0, 1, 2), (1, 0, 2), (2, 0, 1))
    rows = F.array(*(F.struct(F.col(_SIDES[i]).alias("e"), F.col(_SIDES[j]).alias("f"), F.col(_SIDES[k]).alias("g")) for i, j, k in turns))
    incident = materialize(g.triangles.select(F.inline(rows)), "incident")
    values, n = counted(_counts(g.triangles).withColumnRenamed("s", "v"), lambda t: materialize(t, "values"))
    now, active, n_active, logged, log = values, None, n, 0, None
    for _ in range(MAX_ROUNDS):
        looked = incident if active is None else incident.join(active, "e", "left_semi")
        f, h, own = (now.select(F.col("e").alias(a), F.col("v").alias(b)) for a, b in (("f", "vf"), ("g", "vg"), ("e", "v")))
        offers = looked.join(f, "f").join(h, "g").select("e", F.least("vf", "vg").alias("o")).groupBy("e", "o").agg(F.count("*").alias("n"))
        reach = F.sum("n").over(W.partitionBy("e").orderBy(F.desc("o")))
        indexed = offers.select("e", F.least("o", reach).cast("int").alias("h")).groupBy("e").agg(F.max("h").alias("h"))
        both = own.join(indexed, "e")
        if active is None:
            old = values
            fell = both.select("e", F.least("v", "h").alias("v"), (F.col("h") < F.col("v")).alias("fell"))
            values, n_fallen = counted(fell, lambda t: materialize(t, "values"), F.col("fell"))
            now, fallen, logged, log = values.select("e", "v"), values.where("fell").select("e", "v"), 0, Grown(spark, "e long, v int", "fallen")
            release(old)
        else:
            _, n_fallen = counted(both.where("h < v").select("e", F.col("h").alias("v")), log.append)
            fallen = log.last()
            now = values.select("e", "v").join(log.table().groupBy("e").agg(F.min("v").alias("low")), "e", "left").select("e", F.least("v", "low").alias("v"))
            logged += n_fallen
        if trace is not None:
            trace.append((n_active, n_fallen))
        release(active)
        if not n_fallen:
            break
        if logged > compact * n:
            # what fell last is still read from the old log, which goes with the caller's tables
            values = materialize(now, "values")
            now, logged, log = values, 0, Grown(spark, "e long, v int", "fallen")
        active, n_active = None, n
        if n_fallen <= compact * n:
            beside = F.array(F.struct(F.col("f").alias("e"), "v"), F.struct(F.col("g").alias("e"), "v"))
            reached = incident.join(fallen, "e").select(F.inline(beside)).groupBy("e").agg(F.min("v").alias("w"))
            active, n_active = counted(now.join(reached, "e").where("v > w").select("e"), lambda t: materialize(t, "active"))
    else:
        raise RuntimeError("no fixed point")
    release(incident)
    return now.select("e", (F.col("v") + 2).cast("int").alias("trussness"))


def trussness_peel(edges: DataFrame, local_below: int = 0, stop: int | None = None) -> DataFrame:
    """Level by level: the level jumps to the least support, its edges die at once, and dead triangles lower the rest.

    Dead edges go to one table, round by round, so the plan stays as small as it was. With ``stop``, peeling ends once that
    trussness is done, and edges that outlast it get ``stop + 1``.
    """
    g = Listed.of(edges)
    return g.labelled(_by_peeling(g, local_below, stop), "trussness", 2)


def _by_peeling(g: Listed, local_below: int = 0, stop: int | None = None) -> DataFrame:
    tri, counts = g.triangles, materialize(_counts(g.triangles), "counts")
    dead, l, n = Grown(g.edges.sparkSession, "e long, trussness int", "dead"), 0, g.n_triangles
    while n > local_below:
        l = max(l, counts.agg(F.min("s")).first()[0])
        if stop is not None and l + 2 > stop:
            break
        old = tri, counts
        tri, counts, dying, n = _round(tri, counts, l)
        dead.append(dying)
        release(dying, *(t for t in old if t is not g.triangles))
    # edges left, in triangles or in none, last at least as long as the level reached
    if n > local_below:
        dead.append(counts.select("e", F.lit(stop + 1).alias("trussness")))
    else:
        rest = counts.select("e").join(_in_one_task(tri, None if stop is None else stop - 2), "e", "left")
        dead.append(rest.select("e", F.greatest(F.coalesce("trussness", F.lit(0)), F.lit(l + 2)).cast("int").alias("trussness")))
    return dead.table()


def _marked(tri: DataFrame, dying: DataFrame) -> DataFrame:
    """The triangles with ``d1``, ``d2``, ``d3``: which of their edges are in ``dying(e)``."""
    for i, side in enumerate(_SIDES, 1):
        gone = dying.select(F.col("e").alias(f"_{i}"))
        tri = tri.join(gone, F.col(side) == F.col(f"_{i}"), "left").withColumn(f"d{i}", F.col(f"_{i}").isNotNull()).drop(f"_{i}")
    return tri


_DESTROYED, _SURVIVING = "d1 or d2 or d3", "not (d1 or d2 or d3)"


def _lowered(counts: DataFrame, marked: DataFrame) -> DataFrame:
    """``counts(e, s)`` of surviving edges less the destroyed triangles: each lowers each of its surviving edges once."""
    sides = F.array(*(F.when(~F.col(f"d{i}"), F.col(side)) for i, side in enumerate(_SIDES, 1)))
    lost = marked.where(_DESTROYED).select(F.explode(sides).alias("e")).where("e is not null").select("e", F.lit(-1).alias("s"))
    return counts.select("e", "s").unionByName(lost).groupBy("e").agg(F.sum("s").cast("int").alias("s"))


def trussness_frontier(edges: DataFrame, window: int = 16) -> DataFrame:
    """``(src, dst, trussness)`` by peeling that stores edges, not triangles.

    Dying edges enumerate their triangles again, from the neighbour lists of the edges that were left when the present window of
    ``window`` levels began. A triangle counts for the least of its dying edges. Only edges within the window are a table that rounds read and
    write; for the others a log of what they lost is kept, and an edge whose support falls into the window enters it. When a window is
    done, edges, supports and neighbour lists are written once, without the dead.
    """
    spark = edges.sparkSession
    with_ids = materialize(with_edge_ids(edges), "edges")
    counted = support(edges).join(with_ids, ["src", "dst"]).select("e", "src", "dst", F.col("support").alias("s"))
    alive, dead, l = materialize(counted.where("s > 0"), "alive"), Grown(spark, "e long, trussness int", "dead"), 0
    while True:
        least = alive.agg(F.min("s")).first()[0]
        if least is None:
            break
        l = max(l, least)
        alive, l = _window(alive, dead, l, l + window)
    found = with_ids.join(dead.table(), "e", "left")
    return found.select("src", "dst", F.coalesce("trussness", F.lit(2)).alias("trussness"))


def _window(alive: DataFrame, dead: Grown, l: int, high: int) -> tuple[DataFrame, int]:
    """Peels ``alive(e, src, dst, s)`` of levels ``l`` up to ``high``, not included: what is left, and the level reached."""
    spark = alive.sparkSession
    near = materialize(doubled(alive).select(F.col("src").alias("v"), F.col("dst").alias("w"), "e", "s"), "near")
    gone, lost = Grown(spark, "e long", "gone"), Grown(spark, "e long, src long, dst long, s int, n int", "lost")
    hot, n_gone = materialize(alive.where(F.col("s") < high), "hot"), 0
    while True:
        least = hot.agg(F.min("s")).first()[0]
        if least is None:
            break
        l = max(l, least)
        dying = materialize(hot.where(F.col("s") <= l).select("e", "src", "dst"), "dying")
        dead.append(dying.select("e", F.lit(l + 2).alias("trussness")))
        before = gone.table() if n_gone else None
        losses = materialize(_losses(dying, near, before), "losses")
        lost.append(losses)
        gone.append(dying.select("e"))
        n_gone += 1
        left = hot.join(dying.select("e"), "e", "left_anti")
        less = left.join(losses.select("e", "n"), "e", "left").select("e", "src", "dst", (F.col("s") - F.coalesce("n", F.lit(0))).cast("int").alias("s"))
        # of the log only edges that lost a triangle now can have fallen into the window
        now = lost.table().join(losses.select("e"), "e", "left_semi").groupBy("e", "src", "dst").agg((F.max("s") - F.sum("n")).cast("int").alias("s"), F.max("s").alias("first"))
        fallen = now.where((F.col("s") < high) & (F.col("first") >= high)).join(left.select("e"), "e", "left_anti").select("e", "src", "dst", "s")
        new = materialize(less.unionByName(fallen), "hot")
        release(hot, dying, losses)
        hot = new
    release(near, hot)
    sums = lost.table().groupBy("e").agg(F.sum("n").alias("n"))
    rest = alive.join(gone.table(), "e", "left_anti").join(sums, "e", "left")
    out = materialize(rest.select("e", "src", "dst", (F.col("s") - F.coalesce("n", F.lit(0))).cast("int").alias("s")), "alive")
    release(alive)
    return out, l


def _losses(dying: DataFrame, near: DataFrame, gone: DataFrame | None) -> DataFrame:
    """``(e, src, dst, s, n)``: how many triangles each edge that stays loses with ``dying``, among edges not yet ``gone``; s as ``near`` has it."""
    first = near.select(F.col("v").alias("src"), F.col("w"), F.col("e").alias("f"), F.col("s").alias("sf"))
    second = near.select(F.col("v").alias("dst"), F.col("w"), F.col("e").alias("g"), F.col("s").alias("sg"))
    found = dying.join(first, "src").where("w <> dst").join(second, ["dst", "w"])
    for side in "fg":
        if gone is not None:
            found = found.join(gone.withColumnRenamed("e", side), side, "left_anti")
        also = dying.select(F.col("e").alias(side), F.lit(True).alias(f"{side}_dies"))
        found = found.join(also, side, "left")
    own = found.where("(f_dies is null or e < f) and (g_dies is null or e < g)")
    stays = F.array(
        F.when(F.col("f_dies").isNull(), F.struct(F.col("f").alias("e"), F.least("src", "w").alias("src"), F.greatest("src", "w").alias("dst"), F.col("sf").alias("s"))),
        F.when(F.col("g_dies").isNull(), F.struct(F.col("g").alias("e"), F.least("dst", "w").alias("src"), F.greatest("dst", "w").alias("dst"), F.col("sg").alias("s"))),
    )
    rows = own.select(F.explode(stays).alias("x")).where("x is not null").select("x.*")
    return rows.groupBy("e", "src", "dst", "s").agg(F.count("*").cast("int").alias("n"))


def support_after_removal(edges: DataFrame, limit: int) -> DataFrame:
    """``(src, dst, support)`` of the edges that stay when all with support of at most ``limit`` go at once.

    Triangles are listed once; those that lose an edge are destroyed, and only they lower counts.
    """
    g = Listed.of(edges)
    counts = materialize(_counts(g.triangles), "counts")
    stay = counts.where(F.col("s") > limit)
    left = _lowered(stay, _marked(g.triangles, counts.where(F.col("s") <= limit)))
    if limit >= 0:  # edges in no triangle go too
        return g.edges.join(left, "e").select("src", "dst", F.col("s").alias("support"))
    return g.labelled(left, "s", 0).withColumnRenamed("s", "support")


def _round(tri: DataFrame, counts: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Remove the edges of at most ``level``: (triangles left, counts of the edges left, edges removed, number of triangles left)."""
    dying = materialize(counts.where(F.col("s") <= level).select("e", F.lit(level + 2).alias("trussness")), "dying")
    marked = materialize(_marked(tri, dying), "marked")
    left = materialize(marked.where(_SURVIVING).select(*_SIDES), "triangles")
    again = materialize(_lowered(counts.where(F.col("s") > level), marked), "counts")
    release(marked)
    return left, again, dying, left.count()


def _within_truss(g: Listed, k: int, local_below: int) -> tuple[DataFrame, int]:
    """Triangles, and their number, that hold all of the k-truss: its own, or some more where no more than ``local_below`` are left."""
    tri, n, before = g.triangles, g.n_triangles, None
    while n > local_below and n != before:
        before = n
        weak = materialize(_counts(tri).where(F.col("s") < k - 2).select("e"), "dying")
        old = tri
        for side in _SIDES:
            tri = tri.join(weak.withColumnRenamed("e", side), side, "left_anti")
        tri = materialize(tri.select(*_SIDES), "triangles")
        release(weak, old if old is not g.triangles else None)
        n = tri.count()
    return tri, n


def k_truss(edges: DataFrame, k: int, local_below: int = LOCAL_BELOW) -> DataFrame:
    """``(src, dst)`` of the k-truss: the largest set of edges of which each closes k - 2 triangles within the set."""
    if k <= 2:
        return edges.select("src", "dst")
    g = Listed.of(edges)
    tri, n = g.triangles, g.n_triangles
    if k > 3:
        tri, n = _within_truss(g, k, local_below)
        if n <= local_below:
            kept = _in_one_task(tri, k - 3).where(F.col("trussness") >= k).select("e")
            return g.edges.join(kept, "e", "left_semi").select("src", "dst")
    # an edge of the 3-truss is one in any triangle: no round is needed
    kept = tri.select(F.explode(F.array(*_SIDES)).alias("e")).distinct()
    return g.edges.join(kept, "e", "left_semi").select("src", "dst")


def k_max(edges: DataFrame) -> DataFrame:
    return trussness(edges).agg(F.max("trussness").alias("kmax"))


def layers(edges: DataFrame, with_empty: bool = False) -> DataFrame:
    """``(trussness, edges, start, end)``: each level's edges, and its place among edges in the order of their levels.

    Edges in no triangle, of trussness 2, are in no layer. With ``with_empty``, levels without edges have rows too.
    """
    sizes = trussness(edges).where("trussness > 2").groupBy("trussness").agg(F.count("*").alias("edges"))
    if with_empty:
        top = sizes.agg(F.max("trussness").alias("top")).where("top is not null")
        every = top.select(F.explode(F.sequence(F.lit(3), "top")).alias("trussness"))
        sizes = every.join(sizes, "trussness", "left").select("trussness", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))
    end = F.sum("edges").over(W.orderBy("trussness"))
    return sizes.select("trussness", "edges", (end - F.col("edges")).alias("start"), end.alias("end"))


def trussness_between(edges: DataFrame, low: int | None = None, high: int | None = None, local_below: int = LOCAL_BELOW) -> DataFrame:
    """Edges whose trussness is from ``low`` to ``high``, both included.

    Nothing else is decomposed: the edges from ``low`` on are those of that truss, inside which trussness is the same as in
    the whole graph, and peeling stops after ``high``.
    """
    if low is not None and low > 2:
        edges = materialize(k_truss(edges, low, local_below), "truss")
    if high is None:
        found = trussness(edges, local_below)
    else:
        g = Listed.of(edges)
        one = g.n_triangles <= local_below
        found = g.labelled(_in_one_task(g.triangles, high - 2) if one else _by_peeling(g, local_below, high), "trussness", 2)
        found = found.where(F.col("trussness") <= high)
    return found if low is None else found.where(F.col("trussness") >= low)


def trussness_by_ranges(edges: DataFrame, starts: Sequence[int], local_below: int = LOCAL_BELOW, times: list[tuple[float, float]] | None = None) -> DataFrame:
    """``(src, dst, trussness)`` by ranges that are decomposed side by side, as jobs of one session that run at the same time.

    A range begins at each of ``starts`` and ends before the next one; the first also has what is below. Triangles are listed once. Each
    range takes those of its own truss, inside which trussness is the same as in the whole graph, and peels up to its last level.
    ``times`` gets the seconds at which each range began and ended.
    """
    g = Listed.of(edges)
    lows = [None, *sorted({s for s in starts if s > 2})]
    highs = [s - 1 for s in lows[1:]] + [None]

    def one(low: int | None, high: int | None) -> DataFrame:
        began = time.monotonic()
        tri, n = (g.triangles, g.n_triangles) if low is None or low <= 3 else _within_truss(g, low, local_below)
        within = Listed(g.edges, tri, n)
        found = _in_one_task(tri, None if high is None else high - 2) if n <= local_below else _by_peeling(within, 0, high)
        kept = found if high is None else found.where(F.col("trussness") <= high)
        out = materialize(kept if low is None else kept.where(F.col("trussness") >= low), "range")
        if times is not None:
            times.append((began, time.monotonic()))
        return out

    with ThreadPoolExecutor(len(lows)) as pool:
        # a thread has its own copy of the context, so its tables are deleted with the caller's
        begun = [pool.submit(copy_context().run, inheritable_thread_target(edges.sparkSession)(one), low, high) for low, high in zip(lows, highs)]
        found = [x.result() for x in begun]
    return g.labelled(reduce(DataFrame.unionByName, found), "trussness", 2)
