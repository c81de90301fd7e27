"""Pairs of texts by exact shingle similarity: a prefix-filter join over distinct word shingles.

Two sets at Jaccard similarity t or more share at least t times the larger one's elements. So if all sets are sorted by
one order, the first ``n - ceil(t * n) + 1`` elements of both meet. Only these are posted; texts that meet on a posting
list and whose sizes allow it are candidates, and the full sets decide. The order puts shingles of many texts last: a
passage that stands in many texts then rarely opens a posting list.

Full sets only move for candidates that a bound leaves: with the hashes cut into cells of equal width, of which a text has one for
about ``PER_CELL`` of its shingles, two texts share at most the sum over cells of the lesser count.

A pair that reaches t also meets on the list of its first common element in the order, and can share no more than what comes
from there on in either text. Texts of one list are paired only where that is enough.

Of a group of near copies not all pairs are needed, only links that connect the same texts. Each list's texts are first
compared with the least of them; then lists that still hold texts of several components are paired across components.
So every pair at t or more is either connected already or compared.

A passage that makes up most of very many short texts is on a list as long as their number. The order spares that list its square:
a text posted under a common element is posted under all of its own, rare ones, which come before. So texts that share a rare element
meet on a short list, and the long one only has to connect texts that share common elements alone. Let h be a text's common
elements and r the number of its rare ones. Of the texts with the same h the one with the least r is their hub: two of them at t or more
each reach t with the hub, by these numbers, so all that do are linked to it without being read. For texts of different h, a partner
can be replaced by its hub, whose r is no larger. So a long list pairs hubs, and the texts that their own hub does not hold, with hubs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from cohesia.llm.components import connected_components
from cohesia.llm.text import LOWER, byte_rows, word_blocks
from cohesia.runtime import materialize, release, sweep

#: Texts on a posting list from which its shingle goes last in the order, the most such shingles, and the share of texts, one in so
#: many, on which lists are counted for that. Any order gives the same pairs.
COMMON, MAX_COMMON, COUNTED = 64, 1_000_000, 8
#: The most ids of candidates that are broadcast (some 60 bytes each in a task); more meet the texts by shuffle.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a task remembers, and posting rows that it holds.
_REMEMBERED, _FLUSH = 300_000, 1 << 20
_SLACK = 1e-9
#: Shingles per cell; cells are a power of two.
PER_CELL = 4


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = xxh64_intdigest(word, 7)
        return found


def shingles(data: bytes | None, size: int, words: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of runs of ``size`` words, sorted; of a shorter text that has words, the one of all its words."""
    found = [np.fromiter(map(words.__getitem__, block), np.uint64, len(block)) for block in word_blocks(data or b"", LOWER)]
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if len(hashes) == 0:
        return np.zeros(0, np.int64)
    width = min(size, len(hashes))
    mixed = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed >> np.uint64(29))
        mixed = mixed + hashes[k : len(hashes) - width + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((mixed ^ (mixed >> np.uint64(32))).view(np.int64))


def ordered(found: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """A sorted set with its common elements last, and the number of the others."""
    if not len(common):
        return found, len(found)
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    often = common[at] == found
    return np.concatenate([found[~often], found[often]]), int(len(found) - often.sum())


def prefix_length(n: int, similarity: float) -> int:
    """How many elements of a set of ``n`` any set at ``similarity`` or more meets in its own prefix."""
    return n - math.ceil(similarity * n - _SLACK) + 1


def cells(found: np.ndarray) -> np.ndarray:
    """How many of a sorted set's hashes each cell holds, in a byte; empty where a cell would hold more, which even hashes don't do."""
    bits = max(2, (len(found) // PER_CELL).bit_length())
    counts = np.bincount((found >> (64 - bits)) + (1 << (bits - 1)), minlength=1 << bits)
    return counts.astype(np.int8) if counts.max() <= 127 else np.zeros(0, np.int8)


def most_shared(x: Column, y: Column) -> Column:
    """The most elements that two sets can share, from their cells; of the one with more cells, so many add up to one of the other's. Null without cells."""

    def folded(c: Column, to: Column) -> Column:
        each = (F.size(c) / F.size(to)).cast("int")
        total = lambda i: F.aggregate(F.slice(c, i * each + 1, each), F.lit(0), lambda t, v: t + v)
        return F.when(each <= 1, F.transform(c, lambda v: v.cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), F.size(to) - 1), total))

    shared = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda m, n: F.least(m, n)), F.lit(0), lambda total, n: total + n)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared)


def _prefixes(size: int, similarity: float, common):
    """Two kinds of rows: each element of a text's prefix, with key; and one for the text, with cells, its rare elements, and, where its prefix has common ones, a digest of all of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, often = _Words(), common.value
        held: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            lengths = [len(x[3]) for x in held]
            h, n, own = (np.array([x[i] for x in held], np.int64) for i in range(3))
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths] or [np.zeros(0, np.int32)])
            posted = [np.repeat(h, lengths), np.repeat(n, lengths), np.repeat(own, lengths), np.concatenate([x[3] for x in held] or [np.zeros(0, np.int64)]), at]
            yield pa.record_batch([*map(pa.array, posted), pa.nulls(len(at), _CELLS), pa.nulls(len(at), pa.int64())], _POSTED)
            shapes = pa.array([cells(np.sort(x[4])) for x in held], _CELLS)
            digests = pa.array([xxh64_intdigest(x[4][x[2] :].tobytes(), 11) - (1 << 63) if len(x[3]) > x[2] else None for x in held], pa.int64())
            yield pa.record_batch([pa.array(h), pa.array(n), pa.array(own), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int32()), shapes, digests], _POSTED)
            held.clear()

        for batch in batches:
            rows = 0
            for h, data in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
                found, own = ordered(shingles(data, size, words), often)
                if len(found):
                    held.append((h, len(found), own, found[: prefix_length(len(found), similarity)], found))
                    rows += len(found)
                if rows >= _FLUSH:
                    yield from out()
                    rows = 0
            yield from out()

    return run


_CELLS, _POSTED = pa.list_(pa.int8()), ["h", "n", "own", "key", "at", "cells", "alike"]


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for h, data in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
                found = shingles(data, size, words)
                yield pa.record_batch([pa.array([h], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["h", "s"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)``, a table, whose texts reach ``similarity``."""
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "asked")
    wanted = texts.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "h", "left_semi")
    sets = wanted.mapInArrow(_sets(size), "h long, s array<long>").dropDuplicates(["h"])
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = materialize(both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - _SLACK).select("a", "b"), "similar")
    release(pairs, asked)
    return out


def similar_links(texts: DataFrame, names: DataFrame, links: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that together with ``links(a, b)`` connect all texts at ``similarity`` or more.

    ``texts(h, text)`` may repeat rows; ``names(h, node)`` gives the node of each text. A text without words links nowhere.
    """
    spark = texts.sparkSession

    def post(of: DataFrame, common: np.ndarray, similarity: float) -> DataFrame:
        return of.mapInArrow(_prefixes(size, similarity, spark.sparkContext.broadcast(common)), "h long, n long, own long, key long, at int, cells array<tinyint>, alike long")

    # at a similarity of 0 the prefix is the whole set
    some = post(texts.where(F.pmod("h", F.lit(COUNTED)) == 0), np.zeros(0, np.int64), 0.0).where("key is not null").groupBy("key").agg(F.count("*").alias("size"))
    common = some.where(F.col("size") * COUNTED >= COMMON).orderBy(F.desc("size"), "key").limit(MAX_COMMON).select("key").toArrow()["key"].to_numpy()
    written = materialize(post(texts, np.sort(common), similarity), "prefixes")
    shapes = materialize(written.where("cells is not null").groupBy("h").agg(*(F.any_value(c).alias(c) for c in ("n", "own", "cells", "alike"))), "shapes")
    posted = written.where("key is not null")
    lists = materialize(posted.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("last")).where("least < last").select("key", "least"), "lists")
    near = materialize(posted.select("key", "h", "n", (F.col("n") - F.col("at")).alias("rest"), (F.col("at") >= F.col("own")).alias("often")).join(lists.hint("shuffle_hash"), "key"), "shared")
    release(written, lists)
    sweep(spark)

    alike = shapes.where("alike is not null").select("h", "n", "own", "alike")
    hubs = alike.groupBy("alike").agg(F.min(F.struct("own", "h")).alias("hub"))
    reaches = F.col("n") - F.col("own") >= F.lit(similarity) * (F.col("n") + F.col("hub.own")) - _SLACK
    role = F.when(F.col("h") == F.col("hub.h"), "hub").when(reaches, "held").otherwise("left")
    roles = materialize(alike.join(hubs, "alike").select("h", F.col("hub.h").alias("hub"), role.alias("role")), "roles")

    def named(pairs: DataFrame) -> DataFrame:
        ends = [names.select(F.col("h").alias(end), F.col("node").alias(f"node_{end}")) for end in "ab"]
        return pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).where("a <> b").distinct()

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and then cells don't rule out."""
        needed = F.lit(similarity) / (1 + F.lit(similarity)) * (F.col("n_a") + F.col("n_b")) - _SLACK
        for end in "ab":
            pairs = pairs.join(shapes.select(F.col("h").alias(end), F.col("n").alias(f"n_{end}")), end)
        pairs = materialize(pairs.where(F.least("n_a", "n_b") >= needed), "sized")
        met = pairs
        for end in "ab":
            met = met.join(shapes.select(F.col("h").alias(end), F.col("cells").alias(f"cells_{end}")), end)
        out = materialize(met.where(F.coalesce(most_shared(F.col("cells_a"), F.col("cells_b")) >= needed, F.lit(True))).select("a", "b"), "possible")
        release(pairs)
        return out

    stars = possible(near.where("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b")).distinct())
    held = roles.where("role = 'held'").select(F.col("hub").alias("a"), F.col("h").alias("b"))
    first = materialize(named(_verified(stars, texts, size, similarity).unionByName(held)), "first")
    sweep(spark)

    labels = connected_components(links.unionByName(first).distinct())
    label = names.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("h", F.coalesce("label", "node").alias("label"))
    units = near.select("key", "h", "n", "rest", "often").join(label, "h").join(roles.select("h", "role"), "h", "left").where("not often or role <> 'held'")
    several = units.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_ = materialize(units.join(several, "key", "left_semi").select("key", "h", "n", "rest", "label", (F.col("often") & (F.col("role") == "left")).alias("lone")).distinct(), "open")
    left, right = (open_.select("key", F.col("h").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "rest", "label", "lone"))) for end in "ab")
    enough = F.least("rest_a", "rest_b") >= F.lit(similarity) / (1 + F.lit(similarity)) * (F.col("n_a") + F.col("n_b")) - _SLACK
    # of a common element's list, texts that no hub holds meet hubs only
    apart = (F.col("label_a") != F.col("label_b")) & ~F.col("lone_b") & (F.col("lone_a") | (F.col("label_a") < F.col("label_b")))
    rest = possible(left.join(right, "key").where(apart & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    second = named(_verified(rest, texts, size, similarity))
    out = materialize(first.unionByName(second).distinct(), "links")
    release(near, open_, shapes, roles, first)
    sweep(spark)
    return out
