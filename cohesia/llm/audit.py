"""Which filter removes what, over every order of filters.

A document's filters fail or pass whatever their order, so it is one of 32 masks. A table of 32 masks by 120 orders says at
which step a mask is removed first; tasks look their documents' masks up in it and add up removals by part, order, step and
label with ``np.bincount``. Only these arrays, a few thousand numbers for each part and task, are added up over tasks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohesia.llm.text import byte_rows, word_blocks
from cohesia.runtime import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: A document has to have that many words, that many distinct ones of 100, and no more capitals of 100 code points.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
_CAPITALS, _INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Parts that a task counts at a time.
_PARTS = 256


def first_failures() -> np.ndarray:
    """By mask and order: the step, from 1, at which a filter of the mask comes first; 0 for the mask without failures."""
    table = np.zeros((1 << len(FILTERS), len(ORDERS)), np.int64)
    for k, order in enumerate(ORDERS):
        for step, name in reversed(list(enumerate(order, 1))):
            table[(np.arange(len(table)) >> FILTERS.index(name)) & 1 == 1, k] = step
    return table


def judge(data: bytes) -> int:
    """The mask of the failing filters A to D of one text."""
    words, seen = 0, set()
    for block in word_blocks(data):
        words += len(block)
        seen.update(block)
    capitals, points = len(data) - len(data.translate(None, _CAPITALS)), len(data.translate(None, _INNER))
    marked = len(data.translate(None, MARKS)) < len(data)
    return (words < MIN_WORDS) | (100 * len(seen) < MIN_DISTINCT * words) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | marked << 3


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, digest)`` for each row of ``docs``: filters A to D, and the digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for data in byte_rows(batch.column(2)):
                masks.append(judge(data))
                digests.append(hashlib.sha256(data).digest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, good, toxic)``: all five filters as bits, A the lowest, and what the labels say.

    E fails a row whose text some row of smaller id has; a null id is larger than all others, and rows of one id don't fail each
    other. A null text is empty, a null part the empty one. A row is good or toxic if any label row of its id says so.
    """
    found = materialize(judged(docs, id_col, text_col, part_col), "judged")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    repeated = F.coalesce(F.col("least") < F.col("doc_id"), F.col("doc_id").isNull() & F.col("least").isNotNull())
    both = found.join(first.hint("shuffle_hash"), "digest", "left").join(said, "doc_id", "left")
    mask = F.col("mask") + F.when(repeated, 16).otherwise(0)
    return both.select("doc_id", "part", mask.cast("int").alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


_STEPS = len(FILTERS) + 1
_CELLS = len(ORDERS) * _STEPS
#: Places in a part's array: removals of all, good and toxic documents by order and step, then documents by mask.
_KINDS, _LENGTH = 3, 3 * _CELLS + 32


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = first_failures() + np.arange(len(ORDERS)) * _STEPS
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(_LENGTH, np.int64))

    def out() -> pa.RecordBatch:
        rows = pa.array(list(sums.values()), pa.list_(pa.int64()))
        names = pa.array(list(sums), pa.string())
        sums.clear()
        return pa.record_batch([names, rows], ["part", "sums"])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        code, mask = parts.indices.to_numpy(), batch.column(1).to_numpy()
        labels = [None, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)]
        for p, name in enumerate(parts.dictionary.to_pylist()):
            here = code == p
            for kind, label in enumerate(labels):
                count = np.bincount(mask[here if label is None else here & label], minlength=32)
                removed = np.bincount(table.ravel(), weights=np.repeat(count, len(ORDERS)), minlength=_CELLS)
                sums[name][kind * _CELLS : (kind + 1) * _CELLS] += removed.astype(np.int64)
                if label is None:
                    sums[name][_KINDS * _CELLS :] += count
        if len(sums) >= _PARTS:
            yield out()
    yield out()


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _report(cells: pa.Table) -> pa.Table:
    """One part's array as its 600 rows."""
    part, sums = cells["part"][0].as_py(), np.zeros(_LENGTH, np.int64)
    sums[cells["at"].to_numpy()] = cells["n"].to_numpy()
    removed, good, toxic = (sums[k * _CELLS : (k + 1) * _CELLS].reshape(len(ORDERS), _STEPS)[:, 1:] for k in range(_KINDS))
    by_mask = sums[_KINDS * _CELLS :]
    which = np.array([[FILTERS.index(name) for name in order] for order in ORDERS])
    fails = np.array([by_mask[(np.arange(32) >> f) & 1 == 1].sum() for f in range(len(FILTERS))])
    alone = by_mask[1 << np.arange(len(FILTERS))]
    shapley = np.bincount(which.ravel(), weights=removed.ravel()).astype(np.int64)
    values = (by_mask.sum() - removed.cumsum(axis=1), removed, fails[which] - removed, alone[which], good, toxic, shapley[which])
    names = pa.array(np.repeat(np.array(ORDERS, object), len(FILTERS)), pa.string())
    steps = pa.array(np.tile(np.arange(1, _STEPS, dtype=np.int32), len(ORDERS)))
    return pa.table([pa.array([part] * len(names), pa.string()), names, steps, *(pa.array(v.ravel()) for v in values)], ["part", "filter_order", "step", *_COUNTS])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for each part, all 120
    orders and each of their five steps, zeros included; counts are of documents of the part.

    See :func:`masks` for nulls, repeated ids and labels. Columns besides id, text and part are not read. An empty table has no part and gives no row.
    """
    partial = masks(docs, labels, id_col, text_col, part_col).select("part", "mask", "good", "toxic").mapInArrow(_partial, "part string, sums array<long>")
    sums = partial.select("part", F.posexplode("sums").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n")).where("n > 0 or at = 0")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return sums.groupBy("part").applyInArrow(_report, schema)

