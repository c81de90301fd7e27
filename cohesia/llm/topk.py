"""Exact top-k inner-product search by Fagin's threshold algorithm.

Every shard of at most ``SHARD`` vectors has one list per dimension, sorted by component. A query walks each
list from the end that its own component favours. Vectors met on any list are scored in full. The bound for
vectors not met yet is the query's product with the components at the current depth; the walk ends once the kth
best score is above it. The depth doubles from round to round, so that a round is a few array operations for a
whole block of queries. The kth score carries over from one shard of a task to the next and ends later walks sooner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cohesia.runtime import materialize

SHARD, FIRST_DEPTH = 8192, 32
#: Queries that are broadcast at a time; their vectors of 64 components take 2 MB.
QUERY_BLOCK = 4096


class Shard:
    """Vectors of doubles where these hold every inner product exactly, else of Python's integers; the walk is the same."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.up = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.scored = 0

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int, top: np.ndarray, top_ids: np.ndarray) -> None:
        """Merge this shard's rows into each query's best ``top`` scores and ``top_ids``, in place. A query never meets the rows that equal its own."""
        n, dims = self.vectors.shape
        seen = np.zeros((len(queries), n), bool)
        live, done, depth = np.arange(len(queries)), 0, min(FIRST_DEPTH, n)
        while len(live):
            signs = np.sign(queries[live].astype(float))
            bound = np.zeros(len(live), queries.dtype)
            fresh = np.zeros((len(live), n), bool)
            for j in range(dims):
                for sign, walk in ((1, self.up[::-1, j][done:depth]), (-1, self.up[done:depth, j])):
                    on = np.flatnonzero(signs[:, j] == sign)
                    if len(on) and len(walk):
                        fresh[np.ix_(on, walk)] = True
                        bound[on] += queries[live[on], j] * self.vectors[walk[-1], j]
            if depth == n:
                fresh[:] = True  # also rows of a query that has no list to walk
            fresh &= ~seen[live]
            rows = np.flatnonzero(fresh.any(axis=0))
            if len(rows):
                scores = queries[live] @ self.vectors[rows].T
                scores[~fresh[:, rows]] = -np.inf
                at, row = np.nonzero(q_ids[live][:, None] == self.ids[rows][None, :])
                own = (queries[live[at]] == self.vectors[rows[row]]).all(axis=1)
                scores[at[own], row[own]] = -np.inf
                self._merge(live, rows, scores, k, top, top_ids)
                seen[live] |= fresh
                self.scored += int(fresh.sum())
            # a row not met yet can tie with the bound and have the smaller id: only a bound below the kth score ends the walk
            live = live[~(bound < top[live, k - 1]).astype(bool)] if depth < n else live[:0]
            done, depth = depth, min(depth * 2, n)

    def _merge(self, live, rows, scores, k, top, top_ids) -> None:
        for at, q in enumerate(live):
            row = scores[at]
            better = np.flatnonzero((row >= top[q, k - 1]) & (row != -np.inf))
            if len(better):
                all_scores = np.concatenate([top[q], row[better]])
                all_ids = np.concatenate([top_ids[q], self.ids[rows[better]]])
                if all_scores.dtype == object:
                    best = np.array(sorted(range(len(all_ids)), key=lambda i: (-all_scores[i], all_ids[i]))[:k])
                else:
                    best = np.lexsort((all_ids, -all_scores))[:k]
                top[q], top_ids[q] = all_scores[best], all_ids[best]


def _exact(most: float, most_of_queries: float, dims: int) -> bool:
    """Whether double arithmetic holds every partial sum of an inner product exactly."""
    return most * most_of_queries * max(1, dims) < 2.0**53


def _whole(vectors: np.ndarray) -> np.ndarray:
    out = np.empty(vectors.shape, object)
    out.ravel()[:] = [int(x) for x in vectors.ravel()]
    return out


def _order(score: int) -> str:
    """A string that sorts as the integer does, whatever its size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{digits.translate(_NINES)}"


_NINES = str.maketrans("0123456789", "9876543210")
_BEST = "q long, query_id long, copies long, vec_id long, score long, place string"


def _row(q: int, query_id: int, copies: int, vec_id: int, score: int) -> tuple:
    return q, query_id, copies, vec_id, max(-(2**63), min(2**63 - 1, score)), _order(score)


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}
        for dims, (first, q_ids, copies, queries) in block.value.items():
            empty = np.full((len(q_ids), k), -np.inf)
            state[dims] = [first, q_ids, copies, queries, float(np.abs(queries).max(initial=1.0)), empty, np.full((len(q_ids), k), np.iinfo(np.int64).max)]
        for ids, vectors in _shards(batches):
            dims = vectors.shape[1]
            if dims not in state:
                continue
            first, q_ids, copies, queries, most, top, top_ids = state[dims]
            if queries.dtype != object and not _exact(float(np.abs(vectors).max(initial=0.0)), most, dims):
                queries, top = _whole(queries), top.astype(object)
                top[top != -np.inf] = [int(x) for x in top[top != -np.inf]]
                state[dims][3], state[dims][5] = queries, top
            shard = Shard(ids, vectors if queries.dtype != object else _whole(vectors))
            for at in range(0, len(q_ids), 256):
                part = slice(at, at + 256)
                shard.search(q_ids[part], queries[part], k, top[part], top_ids[part])
        for first, q_ids, copies, _, _, top, top_ids in state.values():
            at, rank = np.nonzero(top != -np.inf)
            found = [_row(first + int(i), int(q_ids[i]), int(copies[i]), int(top_ids[i, r]), int(top[i, r])) for i, r in zip(at, rank)]
            kinds = (*[pa.int64()] * 5, pa.string())
            yield pa.record_batch([pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)], [c.split()[0] for c in _BEST.split(", ")])

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of one length, at most SHARD at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SHARD):
            part = batch.slice(start, SHARD)
            ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
            lengths = np.diff(np.asarray(lists.offsets))
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
            for dims in np.unique(lengths):
                on = np.flatnonzero(lengths == dims)
                yield ids[on], flat[offsets[on][:, None] + np.arange(dims)]


def quantize(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` with v = floor(256 * component) as doubles, without vectors that are null, empty or hold nulls or non-finite components."""
    usable = F.coalesce((F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), _floor(F.col(vec_col)).alias("v"))


def _floor(vec):
    """floor() to double: the built-in floor gives a long, which huge components exceed."""

    def one(x):
        y = x.cast("double") * 256
        return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vec, one)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of each query row with all rows but itself.

    Queries are the rows whose id is divisible by ``every``. Rows are what counts, not ids: a row whose id repeats is a query
    of its own and a candidate of the others, and so is each of several equal rows. Ties go to the smaller vec_id. A vector
    that is null, empty, or holds a null or non-finite component takes no part, nor does a row without an id; vectors of
    different lengths don't meet. Components of any size are ranked exactly; a score beyond 64 bits is then given as the end
    of the range. Equal queries are searched once, in blocks of ``QUERY_BLOCK`` at most on average, each broadcast and
    matched with all rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = quantize(vectors, id_col, vec_col)
    queries = materialize(rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = []
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).collect()
        by_dims: dict[int, list] = {}
        for r in mine:
            by_dims.setdefault(len(r.v), []).append(r)
        packed, again, first = {}, [], 0
        for d, rs in by_dims.items():
            packed[d] = (first, np.array([r.vec_id for r in rs], np.int64), np.array([r.copies for r in rs], np.int64), np.array([r.v for r in rs]))
            # of equal rows each meets the others, with the square of the vector as the score
            again += [_row(first + i, r.vec_id, r.copies, r.vec_id, sum(int(x) ** 2 for x in r.v)) for i, r in enumerate(rs) for _ in range(min(r.copies - 1, k))]
            first += len(rs)
        best = rows.mapInArrow(_search(spark.sparkContext.broadcast(packed), k), _BEST)
        if again:
            best = best.unionByName(spark.createDataFrame(again, _BEST))
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("place"), "vec_id"))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        found.append(best if blocks == 1 else materialize(best, "topk"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
