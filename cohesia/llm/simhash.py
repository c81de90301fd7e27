"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight bytes position by
position. The index posts each distinct fingerprint under the values of four byte positions; six such position
sets meet every pair that shares six bytes. Fingerprints on one posting list are paired, the pair's shared
positional bytes are tallied, pairs with six or more stay, and the bit distance verifies them.

A list longer than ``max_list`` (thousands of near copies of one text) is not paired. Its fingerprints go under
the 65 values at one bit or less from them: two fingerprints are at two bits or less exactly if they meet under such
a value, at most 65 fingerprints do, and linking each to the least of them loses no component. So no list is cut
and nothing grows with a list's square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from cohesia.llm.components import connected_components
from cohesia.llm.similar import similar_links
from cohesia.llm.text import LOWER, byte_rows, word_blocks
from cohesia.runtime import materialize, release

SHINGLE, SEED, MAX_BITS, MIN_SHARED_BYTES = 3, 42, 2, 6


def simhash(data: bytes | None) -> int:
    """The fingerprint of one text, as a signed 64-bit integer. A text without words, or null, has zero."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data or b"", LOWER):
        words = tail + words
        if len(words) >= SHINGLE:
            hashes = [xxh64_intdigest(b" ".join(t), SEED) for t in zip(words, words[1:], words[2:])]
            counts += _bits(hashes)
            total += len(hashes)
            tail = words[1 - SHINGLE :]
        else:
            tail = words
    if not total:
        if not tail:
            return 0
        counts, total = _bits([xxh64_intdigest(b" ".join(tail), SEED)]), 1
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of ``hashes`` have each bit set."""
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` for each row of ``docs``; text_hash tells apart rows that repeat an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([simhash(x) for x in byte_rows(batch.column(2))], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), found], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _position_sets() -> list[int]:
    """Masks of four byte positions each: every two of the four 16-bit groups. Two damaged bytes leave one set whole."""
    return [(0xFFFF << 16 * a) | (0xFFFF << 16 * b) for a, b in combinations(range(4), 2)]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x)


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally: in how many of the eight byte positions two fingerprints agree."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(_signed(0xFF << 8 * i)) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def links(distinct: DataFrame, max_list: int = 64) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``distinct(fp)`` that connect all pairs at two bits or less."""
    keys = F.array(*(F.col("fp").bitwiseAND(_signed(m)) for m in _position_sets()))
    posted = distinct.select("fp", F.posexplode(keys).alias("positions", "octets"))
    lists = posted.groupBy("positions", "octets").agg(F.count("*").alias("n")).where("n > 1")
    posted = materialize(posted.join(lists, ["positions", "octets"]), "postings")

    short = posted.where(F.col("n") <= max_list)
    left = short.select("positions", "octets", F.col("fp").alias("a"))
    right = short.select("positions", "octets", F.col("fp").alias("b"))
    pairs = left.join(right, ["positions", "octets"]).where("a < b")
    pairs = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= MIN_SHARED_BYTES)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")

    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_signed(1 << i)) for i in range(64)))
    hubs = posted.where(F.col("n") > max_list).select("fp").distinct().select("fp", F.explode(near).alias("hub"))
    met = hubs.groupBy("hub").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    out = materialize(pairs.unionByName(stars).distinct(), "links")
    release(posted)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, similar_shingle: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fingerprint, component_id, keeper.

    fingerprint is in 16 lower-case hex digits. component_id is the least doc_id that links reach. keeper is true for
    one row key (doc_id, text_hash) of each class: the least, a null id last. A null or empty text has fingerprint zero and
    links like any other. A row without doc_id never names its class: component_id is null where no row of the class has
    an id. Rows repeating an id are judged each by its own text. An
    empty table gives an empty result. Other columns are not read. With ``similarity``, texts whose sets of distinct
    runs of ``similar_shingle`` words have at least that Jaccard similarity link too, whatever their fingerprints.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fp")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")  # rows without an id come last
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("first")), "fps")
    linked = links(distinct.select("fp"))
    if similarity is not None:
        names = materialize(prints.select(F.col("text_hash").alias("h"), F.col("fp").alias("node")).distinct(), "names")
        texts = docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
        linked = linked.unionByName(similar_links(texts, names, linked, similar_shingle, similarity))
    labels = connected_components(linked)
    labelled = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    named_by = labelled.groupBy("label").agg(F.min("first").alias("least"))
    by_print = labelled.join(named_by, "label").select("fp", "least")
    same = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return prints.join(by_print, "fp").select(
        "doc_id",
        "text_hash",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        same.alias("keeper"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, similar_shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate class (see :func:`classes`), all columns as they are.

    The row with the least (doc_id, hash of the text) stays, a null id last; of rows that repeat both, one.
    """
    found = materialize(classes(docs, id_col, text_col, similarity, similar_shingle).where("keeper").select("doc_id", "text_hash"), "keep")
    repeats = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
    keys = found.distinct().select(F.col("doc_id").alias("_k1"), F.col("text_hash").alias("_k2")).hint("shuffle_hash")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(F.col(text_col)).alias("_h"))
    kept = rows.join(keys, F.col("_i").eqNullSafe(F.col("_k1")) & (F.col("_h") == F.col("_k2")), "left_semi")
    if repeats:
        kept = kept.dropDuplicates(["_i", "_h"])
    return kept.select("_row.*")
