"""Importance resampling towards a target: hashed n-gram features, log gains, Gumbel noise and the highest scores.

Identical texts are collapsed first by grouping whole texts, so a text with a million copies has its features hashed once.
Feature counts of the corpus multiply each text's counts by its copies. Weights belong to texts and are joined back to the
rows by the digest of the text; only then comes the noise, which belongs to the row.

A run of n + 1 words has the checksum of the run of n words carried on, so all runs of a text cost one checksum call each. What
the driver holds is one count per bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohesia.llm.text import LOWER_WORDS, byte_rows, word_blocks
from cohesia.operators.canonical import dense_index
from cohesia.runtime import materialize, release

BUCKETS, LONGEST, SHARE, MIN_WORDS, SEED = 10_000, 3, (5, 100), 20, "42"
#: Feature rows that a task sends at a time.
_FLUSH = 1 << 20


def features(data: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of each run of 1 to ``longest`` words, repeats included, in no order."""
    found, tail, n = [], [], 0
    for words in word_blocks(data, LOWER_WORDS):
        n += len(words)
        words = tail + words
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        for size in range(1, longest + 1):
            if size > 1:
                sums = list(map(crc32, spaced[size - 1 :], sums))
            found.append(np.array(sums[max(0, len(tail) - size + 1) :], np.uint32))
        tail = words[1 - longest :] if longest > 1 else []
    return n, (np.concatenate(found) % np.uint32(buckets) if found else np.zeros(0, np.uint32))


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


_FEATURES = "digest binary, copies long, n_words long, n_features long, buckets binary"


def text_features(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``(digest, copies, n_words, n_features, buckets)`` for each distinct text of ``texts(text)``, a table."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "copies", "n_words", "n_features", "buckets"])

        for batch in batches:
            held, rows = [], 0
            for data, copies in zip(byte_rows(batch.column(0)), batch.column(1).to_pylist()):
                n, found = features(data, buckets, longest)
                held.append((hashlib.sha256(data).digest(), copies, n, len(found), found.astype(kind).tobytes()))
                rows += len(found)
                if rows >= _FLUSH:
                    yield out()
                    held, rows = [], 0
            yield out()

    return materialize(texts.groupBy("text").agg(F.count("*").alias("copies")).mapInArrow(run, _FEATURES), "features")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows: counts of distinct texts times their copies, added up in each task, then over tasks."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += np.bincount(np.frombuffer(data.as_py(), kind), minlength=buckets) * copies
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = found.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def log_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 * ln of how much likelier it is in the target), with one added to each count."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + float(n)) / ((s + 1.0) * (t_all + float(n)))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weights(found: DataFrame, gains: np.ndarray, buckets: int) -> DataFrame:
    kind, shared = _kind(buckets), found.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(shared.value[np.frombuffer(data.as_py(), kind)].sum()) for data in batch.column(3)]
            yield pa.record_batch([*batch.columns[:3], pa.array(sums, pa.int64())], ["digest", "n_words", "n_features", "weight"])

    return found.select("digest", "n_words", "n_features", "buckets").mapInArrow(run, "digest binary, n_words long, n_features long, weight long")


def noise(seed: str, doc_id: Column) -> Column:
    """floor(1000 * Gumbel noise) of an id, from a digest; a null id draws as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_digest, n_words, n_features, weight, score, rank.

    weight is the sum over the text's features of the log gain of their bucket, score that plus noise by ``seed`` and the
    id. Of the rows with at least ``min_words`` words the ``share`` of highest score is drawn, ties by id, a null id last,
    then by the text's digest; rank counts them from 1 and is null elsewhere. A null text has no words, like an empty one, and
    weight 0; rows that repeat an id draw the same noise and each count. An empty table gives an empty result; without target
    texts every gain still follows from the counts. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = text_features(docs.select(text.alias("text")), buckets, longest)
    wanted = text_features(target.select(F.coalesce(F.col(target_col).cast("string"), F.lit("")).alias("text")), buckets, longest)
    gains = log_gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    release(wanted)
    weights = _weights(found, gains, buckets).withColumnRenamed("digest", "text_digest")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_digest"))
    scored = rows.join(weights.hint("shuffle_hash"), "text_digest").withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    scored = materialize(scored.select("doc_id", "text_digest", "n_words", "n_features", "weight", "score"), "scored")
    release(found)
    open_ = scored.where(F.col("n_words") >= min_words)
    n_drawn = share[0] * open_.count() // share[1]
    ranked = dense_index(open_, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("text_digest"), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < n_drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`importance` draws, all columns as they are. Of rows alike in id and text as many stay as were drawn."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    drawn = importance(docs, target, **options).where("rank is not null").groupBy("doc_id", "text_digest").agg(F.count("*").alias("_n"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_i"), F.unhex(F.sha2(text, 256)).alias("_h"))
    same = F.col("_i").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_digest"))
    kept = rows.join(materialize(drawn, "drawn").hint("shuffle_hash"), same)
    nth = F.row_number().over(W.partitionBy("doc_id", "text_digest").orderBy(F.xxhash64(F.to_json("_row"))))
    return kept.withColumn("_nth", nth).where("_nth <= _n").select("_row.*")
