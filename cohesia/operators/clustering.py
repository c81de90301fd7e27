"""Communities by modularity, and parts made of them.

Moves are rounds of joins. A round tosses a coin for each community: vertices only leave communities that give and only enter such that take, so
no two swap places. Gains of single moves need not add up if several vertices enter one community; a round is therefore kept only
if modularity, which is counted, has grown. Otherwise each community gives and takes the best one only; such moves touch different
communities, so their gains do add up. Modularity never falls, whatever the graph. A level's communities become the vertices of the next
level's weighted graph.

Communities are then linked by average weight: in each round those that are each other's best partner merge, up to a size that keeps parts alike, until
no two are left that may. No matrix of communities is formed, and nothing but sums reaches the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from cohesia.operators.canonical import dense_index, doubled
from cohesia.runtime import Grown, counted, materialize, release

#: A level ends, and so do levels, when modularity grows by less.
LEAST_GAIN = 0.01
#: A linked community has at most this share of a part's mean number of vertices.
SLACK = 0.25


def weighted(edges: DataFrame) -> DataFrame:
    """``(u, v, w)``: both directions of canonical edges, of weight one."""
    return doubled(edges.select("src", "dst")).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).cast("long").alias("w"))


def _start(near: DataFrame) -> DataFrame:
    """``(id, label, k)``: each vertex a community of its own, with its weighted degree."""
    return near.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("label"), "k")


def _inner(near: DataFrame, state: DataFrame) -> DataFrame:
    ends = [state.select(F.col("id").alias(x), F.col("label").alias(f"of_{x}")) for x in "uv"]
    return near.join(ends[0], "u").join(ends[1], "v").where("of_u = of_v")


def modularity(near: DataFrame, state: DataFrame) -> float:
    """Of the communities ``state(id, label, k)`` in the graph ``near(u, v, w)``: the share of weight inside, less what degrees alone give."""
    inside = _inner(near, state).agg(F.sum("w").cast("double").alias("inside"))
    sums = state.groupBy("label").agg(F.sum("k").cast("double").alias("tot")).agg(F.sum("tot").alias("total"), F.sum(F.col("tot") * F.col("tot")).alias("squares"))
    inside, total, squares = inside.crossJoin(F.broadcast(sums)).first()  # one row each
    return (inside or 0.0) / total - squares / total**2 if total else 0.0


def best_moves(near: DataFrame, state: DataFrame) -> DataFrame:
    """``(id, label, to, gain)``: for each vertex the community next to it that it gains most by entering, ties to the lesser label, where that is a gain.

    gain is the growth of modularity times half the squared total weight: with w the weights from the vertex to a community and
    tot the degrees of a community without the vertex, total * w - k * tot of the new one less the same of the old one.
    """
    total = near.agg(F.sum("w").cast("double").alias("total"))
    sums = state.groupBy("label").agg(F.sum("k").alias("tot"))
    links = near.where("u <> v").join(state.select(F.col("id").alias("v"), F.col("label").alias("to")), "v").groupBy(F.col("u").alias("id"), "to").agg(F.sum("w").alias("w"))
    own = state.join(sums, "label").select("id", "label", "k", (F.col("tot") - F.col("k")).alias("rest"))
    met = links.join(own, "id").join(sums.select(F.col("label").alias("to"), "tot"), "to").crossJoin(F.broadcast(total))
    other, k = F.col("to") != F.col("label"), F.col("k").cast("double")
    value = F.col("total") * F.col("w") - k * F.col("tot")
    found = met.groupBy("id", "label").agg(
        F.max(F.when(other, F.struct(value.alias("value"), (-F.col("to")).alias("minus")))).alias("best"),
        F.max(F.col("total") * F.when(~other, F.col("w")).otherwise(0) - k * F.col("rest")).alias("stay"),
    )
    return found.select("id", "label", (-F.col("best.minus")).alias("to"), (F.col("best.value") - F.col("stay")).alias("gain")).where("gain > 0")


def _coin(label: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(label, F.lit(turn)), F.lit(2))


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    joined = state.join(moves.select("id", "to"), "id", "left")
    return materialize(joined.select("id", F.coalesce("to", "label").alias("label"), "k"), "communities")


def _single(moves: DataFrame) -> DataFrame:
    """Of each community that gives, and then of each that takes, the best move."""
    for end in ("label", "to"):
        moves = moves.groupBy(end).agg(F.max_by(F.struct("id", "label", "to", "gain"), F.struct("gain", (-F.col("id")).alias("m"))).alias("best")).select("best.*")
    return moves


def _level(near: DataFrame, least_gain: float) -> tuple[DataFrame, list[float]]:
    """The communities after one level's rounds, and modularity after each round that was kept."""
    state = materialize(_start(near), "communities")
    reached, idle = [modularity(near, state)], 0
    for turn in count():  # two rounds that gain less than ``least_gain`` end it, and no modularity is above 1
        moves = materialize(best_moves(near, state), "moves")
        crossing = moves.where((_coin(F.col("label"), turn) == 1) & (_coin(F.col("to"), turn) == 0))
        new = _moved(state, crossing)
        q = modularity(near, new)
        if q <= reached[-1]:
            release(new)
            new = _moved(state, _single(crossing))
            q = modularity(near, new)
        release(moves)
        if q <= reached[-1]:  # no move is left, or the coin let none pass
            release(new)
            idle += 1
        else:
            release(state)
            idle = 0 if q - reached[-1] >= least_gain else idle + 1
            state = new
            reached.append(q)
        if idle >= 2:
            break
    return state, reached


def communities(edges: DataFrame, least_gain: float = LEAST_GAIN, trace: list[list[float]] | None = None) -> DataFrame:
    """``(id, label)`` of the vertices of canonical edges; label is a vertex of the community. ``trace`` gets each level's modularity after each round."""
    near, labels = materialize(weighted(edges), "weighted"), None
    while True:
        state, reached = _level(near, least_gain)
        if trace is not None:
            trace.append(reached)
        own = state.select("id", "label")
        labels, old = materialize(own if labels is None else _named(labels, own.select(F.col("id").alias("label"), F.col("label").alias("to"))), "labels"), labels
        ends = [own.select(F.col("id").alias(x), F.col("label").alias(f"of_{x}")) for x in "uv"]
        upper = near.join(ends[0], "u").join(ends[1], "v").groupBy(F.col("of_u").alias("u"), F.col("of_v").alias("v")).agg(F.sum("w").alias("w"))
        upper, lower = materialize(upper, "weighted"), near
        near = upper
        release(old, lower, state)
        if len(reached) < 2 or reached[-1] - reached[0] < least_gain:
            break
    release(near)
    return labels


def _named(labels: DataFrame, names: DataFrame) -> DataFrame:
    return labels.join(names, "label").select("id", F.col("to").alias("label"))


def _pairs(edges: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``(a, b, w, n_a, n_b)``, a < b: communities with edges between them, their number and the sizes, of at most ``most`` vertices together."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    ends = [labels.select(F.col("id").alias(x), F.col("label").alias(y)) for x, y in (("src", "a"), ("dst", "b"))]
    between = edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("w"))
    for end in "ab":
        between = between.join(sizes.select(F.col("label").alias(end), F.col("n").alias(f"n_{end}")), end)
    return between.where(F.col("n_a") + F.col("n_b") <= most).select("a", "b", "w", "n_a", "n_b")


def _merges(pairs: DataFrame) -> DataFrame:
    """``(a, b, n)``: the pairs that are the best of both their ends. Ties go by a hash of the pair, else a chain of ties would merge one pair a round."""
    scored = pairs.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), (F.col("w") / (F.col("n_a") * F.col("n_b"))).alias("score"), F.xxhash64("a", "b").alias("toss"))
    best = scored.select(F.struct("score", "toss", "a", "b", "n").alias("best"), F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.max("best").alias("best"))
    return best.select("best.a", "best.b", "best.n").groupBy("a", "b").agg(F.max("n").alias("n"), F.count("*").alias("ends")).where("ends = 2").select("a", "b", "n")


def _contracted(pairs: DataFrame, changed: DataFrame, most: int) -> DataFrame:
    """The pairs after communities became ``to`` of ``n`` vertices. A pair over ``most`` never comes back, since communities only grow."""
    for end in "ab":
        now = changed.select(F.col("label").alias(end), F.col("to").alias("to"), F.col("n").alias("n"))
        rest = [c for c in pairs.columns if c not in (end, f"n_{end}")]
        pairs = pairs.join(now, end, "left").select(*rest, F.coalesce("to", end).alias(end), F.coalesce("n", f"n_{end}").alias(f"n_{end}"))
    left = pairs.where((F.col("a") != F.col("b")) & (F.col("n_a") + F.col("n_b") <= most))
    swap = F.col("a") > F.col("b")
    keys = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("n_a", "n_b"), ("n_b", "n_a"))]
    return left.select(*keys, "w").groupBy("a", "b", "n_a", "n_b").agg(F.sum("w").alias("w")).select("a", "b", "w", "n_a", "n_b")


def linked(edges: DataFrame, labels: DataFrame, most: int, trace: list[int] | None = None) -> DataFrame:
    """``(id, label)`` with communities merged by average linkage as long as two that prefer each other have at most ``most`` vertices together.

    While a pair is left, the first of all in the order of preference is the best of both its ends, so each round merges some and the rounds
    end by themselves. Only pairs of communities are written again, not edges. ``trace`` gets the number of merges of each round.
    """
    pairs, kind = materialize(_pairs(edges, labels, most), "pairs"), dict(labels.dtypes)["label"]
    log = Grown(edges.sparkSession, f"a {kind}, b {kind}, n long", "merges")
    while True:
        _, n = counted(_merges(pairs), log.append)
        if trace is not None:
            trace.append(n)
        if not n:
            break
        changed = log.last().select(F.explode(F.array("a", "b")).alias("label"), F.col("a").alias("to"), "n")
        kept = materialize(_contracted(pairs, changed, most), "pairs")
        release(pairs)
        pairs = kept
    # a community goes into another one once at most, so all merges are a forest; each round doubles the way up
    names, n = materialize(log.table().select(F.col("b").alias("label"), F.col("a").alias("to")), "names"), 1
    while n:
        above = names.select(F.col("label").alias("to"), F.col("to").alias("next"))
        jumped = names.select("label", "to").join(above, "to", "left").select("label", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("jumped"))
        below, (names, n) = names, counted(jumped, lambda df: materialize(df, "names"), F.col("jumped"))
        release(below)
    out = materialize(labels.join(names.drop("jumped"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    release(pairs, labels, names)
    return out


def vertex_parts(edges: DataFrame, parts: int, least_gain: float = LEAST_GAIN) -> DataFrame:
    """``(id, part)``: linked communities dealt to ``parts`` by size, largest first, forth and back.

    Communities of more than ``SLACK`` of a part's mean number of vertices, rounded up, are cut into such pieces. Dealt in that order two
    parts differ by one piece at most, so a part has at most 1 + ``SLACK`` times the mean, and one vertex more for rounding.
    """
    labels = communities(edges, least_gain)
    most = max(1, -(-int(labels.count() * SLACK) // parts))
    labels = linked(edges, labels, most)
    places = dense_index(labels, "label", "id", name="place")
    starts = places.groupBy("label").agg(F.min("place").alias("first"))
    cut = materialize(places.join(starts, "label").select("id", "label", F.floor((F.col("place") - F.col("first")) / most).alias("piece")), "pieces")
    sizes = dense_index(cut.groupBy("label", "piece").agg(F.count("*").alias("n")), F.desc("n"), F.col("label"), F.col("piece"), name="rank")
    turn = F.col("rank") % (2 * parts)
    dealt = sizes.select("label", "piece", F.when(turn < parts, turn).otherwise(2 * parts - 1 - turn).cast("long").alias("part"))
    return cut.join(dealt, ["label", "piece"]).select("id", "part")


def with_halo(edges: DataFrame, part: DataFrame) -> DataFrame:
    """``(src, dst, part)``: an edge is in the parts of both its ends."""
    placed = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("id")).join(part, "id")
    return placed.select("src", "dst", "part").distinct()
