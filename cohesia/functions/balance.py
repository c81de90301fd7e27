"""Splitting work: levels by edges or by triangles, equal-cost batches, greedy and round-robin groups."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohesia.operators.access import prefix_sums
from cohesia.operators.canonical import dense_index, doubled
from cohesia.runtime import materialize, release


def _levels(supports: DataFrame) -> DataFrame:
    """``(l, below, mass, edges, total)`` for each l that is one above a support: edges below l, their supports' sum, and both over all."""
    bins = supports.groupBy("support").agg(F.count("*").alias("n"))
    upto, everything = W.orderBy("support"), W.orderBy("support").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mass = F.col("support") * F.col("n")
    return bins.select(
        (F.col("support") + 1).cast("long").alias("l"),
        F.sum("n").over(upto).alias("below"),
        F.sum(mass).over(upto).alias("mass"),
        F.sum("n").over(everything).alias("edges"),
        F.sum(mass).over(everything).alias("total"),
    )


def _first_level(levels: DataFrame, reached: Column) -> DataFrame:
    """``(level)``: the least l at which ``reached`` holds, 1 if no edge is needed; no row for a graph without edges."""
    return levels.where(reached).agg(F.min("l").alias("level")).where("level is not null")


def split_by_edges(supports: DataFrame, share: float = 0.5) -> DataFrame:
    """The least level below which at least ``share`` of the edges are."""
    return _first_level(_levels(supports), F.col("below") >= share * F.col("edges"))


def split_by_nonzero_edges(supports: DataFrame, share: float = 0.5) -> DataFrame:
    return split_by_edges(supports.where("support > 0"), share)


def split_by_triangles(supports: DataFrame, share: float = 0.5) -> DataFrame:
    """The least level below which the supports add up to at least ``share`` of all."""
    return _first_level(_levels(supports), F.col("mass") >= share * F.col("total"))


def split_by_cost(supports: DataFrame, overhead: float = 0.3) -> DataFrame:
    """The least level l with (1 + overhead * E / edges from l on) * mass below l >= all mass; l beyond all edges always holds."""
    rest = F.col("edges") - F.col("below")
    cost = F.when(rest > 0, (1 + overhead * F.col("edges") / rest) * F.col("mass") >= F.col("total")).otherwise(True)
    return _first_level(_levels(supports), cost)


def split_by_relative_cost(supports: DataFrame) -> DataFrame:
    """As :func:`split_by_cost`, with the edges below l over those from l on as the factor."""
    rest = F.col("edges") - F.col("below")
    cost = F.when(rest > 0, (1 + F.col("below") / rest) * F.col("mass") >= F.col("total")).otherwise(True)
    return _first_level(_levels(supports), cost)


def split_for_parts(supports: DataFrame, parts: int) -> DataFrame:
    """``(part, level)``: where each part but the last ends, increasing. The first one ends where two thirds of the edges are below,
    each further one where a third more than before are, at 2 at least; one that does not exceed the one before is that plus 2.
    """
    levels = _levels(supports)
    needs, row = [], levels.agg(F.max("edges")).first()
    need = (row[0] or 0) // 3 * 2
    for _ in range(parts - 1):
        needs.append(min(need, row[0] or 0))
        need += need // 3
    if not needs or not row[0]:
        return supports.sparkSession.createDataFrame([], "part long, level long")
    found = levels.agg(*(F.min(F.when(F.col("below") >= n, F.col("l"))).alias(f"l{i}") for i, n in enumerate(needs)))
    ends = [F.greatest(F.col("l0"), F.lit(2))]
    for i in range(1, len(needs)):
        ends.append(F.when(F.col(f"l{i}") > ends[-1], F.col(f"l{i}")).otherwise(ends[-1] + 2))
    return found.select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("part"), e.cast("long").alias("level")) for i, e in enumerate(ends)))))


def _ends(found: Sequence[int]) -> list[int]:
    """Levels at which parts end, from the levels found: the first is 2 at least, one that does not exceed the one before is that plus 2."""
    out: list[int] = []
    for l in found:
        out.append(max(l, 2) if not out else l if l > out[-1] else out[-1] + 2)
    return out


def _as_parts(supports: DataFrame, found: Sequence[int]) -> DataFrame:
    return supports.sparkSession.createDataFrame(list(enumerate(_ends(found))), "part long, level long")


def split_nonzero_for_parts(supports: DataFrame, parts: int) -> DataFrame:
    """``(part, level)`` over edges in triangles: the first part takes two thirds of them, each further one a third of that number
    than the one before, out of the edges from its start on; all of those where there are fewer.
    """
    levels = materialize(_levels(supports.where("support > 0")), "levels")
    edges = levels.agg(F.max("edges")).first()[0] or 0
    need, taken, found = edges // 3 * 2, 0, []
    for _ in range(parts - 1 if edges else 0):
        # one row a part: the level, and what is below it
        row = levels.where(F.col("below") >= min(taken + need, edges)).orderBy("l").select("l", "below").first()
        found.append(row["l"])
        taken, need = max(taken, row["below"]), need // 3
    release(levels)
    return _as_parts(supports, found)


def split_by_triangles_for_parts(supports: DataFrame, parts: int) -> DataFrame:
    """``(part, level)``: below the first level supports add up to a part's share of all, below each further one to twice as much as before, or to all."""
    levels = materialize(_levels(supports), "levels")
    total = levels.agg(F.max("total")).first()[0]
    if total is None or parts < 2:
        return _as_parts(supports, [])
    needs = [min(total // parts * 2**i, total) for i in range(parts - 1)]
    row = levels.agg(*(F.min(F.when(F.col("mass") >= n, F.col("l"))).alias(str(i)) for i, n in enumerate(needs))).first()
    release(levels)
    return _as_parts(supports, list(row))


def equal_cost_batches(rows: DataFrame, place: str, cost: str, batch: int) -> DataFrame:
    """``(place, cost, batch)``: rows in the order of a dense number, a new batch for each ``batch`` of cost before."""
    sums = prefix_sums(rows.select(place, F.col(cost).alias("_size"), cost), place, "_size")
    return sums.select(place, cost, F.floor(F.col("start") / batch).cast("long").alias("batch"))


def round_robin(ranked: DataFrame, parts: int, place: str = "idx") -> DataFrame:
    """``ranked`` with ``part``: by the dense number of the descending order, in turn."""
    return ranked.withColumn("part", (F.col(place) % parts).cast("long"))


def lightest_first(weights: Sequence[float], parts: int) -> list[int]:
    """Greedy groups: the heaviest item left goes to the lightest group, ties to the lower one. At most as many groups as items."""
    parts = max(1, min(parts, len(weights)))
    groups = [(0, p) for p in range(parts)]
    out = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        load, p = heapq.heappop(groups)
        out[i] = p
        heapq.heappush(groups, (load + weights[i], p))
    return out


#: The greedy order is sequential; more items than this are an error, not a driver that runs out of memory.
LPT_ITEMS = 1_000_000


def lpt_partition(items: DataFrame, key: str, weight: str, parts: int) -> DataFrame:
    """``(key, weight, part)`` by :func:`lightest_first`; meant for partitions or blocks, of which there are few."""
    rows = items.select(key, weight).orderBy(key).limit(LPT_ITEMS + 1).collect()
    if len(rows) > LPT_ITEMS:
        raise ValueError(f"more than {LPT_ITEMS} items; group them first")
    found = lightest_first([r[weight] for r in rows], parts)
    kinds = dict(items.dtypes)
    return items.sparkSession.createDataFrame([(r[key], r[weight], p) for r, p in zip(rows, found)], f"{key} {kinds[key]}, {weight} {kinds[weight]}, part long")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(id, label)`` by label propagation: in each round a vertex takes the most frequent label among its neighbours and itself,
    the least of several. It ends when no label changes, or after ``rounds``.
    """
    near = doubled(edges.select("src", "dst"))
    labels = materialize(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(rounds):
        heard = near.join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label").unionByName(labels.select("id", "label"))
        votes = heard.groupBy("id", "label").agg(F.count("*").alias("n"))
        found = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("best")).select("id", (-F.col("best.m")).alias("label"))
        new = materialize(found, "labels")
        same = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count() == 0
        release(labels)
        labels = new
        if same:
            break
    return labels


def community_partition(edges: DataFrame, parts: int, rounds: int = 5) -> DataFrame:
    """``(src, dst, part)`` with a halo: an edge is in the parts of both its ends, communities whole in one part.

    Communities are dealt to parts by their number of vertices, largest first (ties by label), forth and back, so parts come
    out alike unless one community outweighs the rest.
    """
    labels = communities(edges, rounds)
    sizes = dense_index(labels.groupBy("label").agg(F.count("*").alias("n")), F.desc("n"), F.col("label"), name="rank")
    turn = F.col("rank") % (2 * parts)
    dealt = sizes.select("label", F.when(turn < parts, turn).otherwise(2 * parts - 1 - turn).cast("long").alias("part"))
    part = labels.join(dealt, "label").select("id", "part")
    placed = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("id")).join(part, "id")
    return placed.select("src", "dst", "part").distinct()
