"""Quality classifier: an interpolated modified Kneser-Ney model over the bytes of trusted text.

The n-grams are of bytes, ``ORDER`` long: such a model knows the spelling of a language, its table stops growing with the
corpus, and a gram is a 40-bit number. One pass counts grams per task and Spark adds the counts up. Joins of the
count tables, sharded by gram and by context, give each gram that occurs anywhere its full probability, so
scoring is one look-up a byte. A text passes if its perplexity is at most a quantile, for its language, over
trusted texts that were kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cohesia.llm.text import byte_rows
from cohesia.runtime import materialize

ORDER, QUANTILE, HELD_OUT = 5, 0.99, 5
#: Grams that a task holds before it passes their counts on, and bytes of text taken at a time.
_HELD, _CHUNK = 1 << 22, 1 << 22
#: The most grams whose probabilities are broadcast (up to 64 bytes each in the table); more are joined by shuffle.
BROADCAST_GRAMS = 4_000_000
#: The most trusted ids that are broadcast.
BROADCAST_IDS = 4_000_000


def grams(data: bytes) -> np.ndarray:
    """The gram that ends at each byte; before the text stand zero bytes."""
    padded = np.zeros(len(data) + ORDER - 1, np.int64)
    padded[ORDER - 1 :] = np.frombuffer(data, np.uint8)
    codes = padded[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        codes |= padded[ORDER - 1 - k : len(padded) - k] << (8 * k)
    return codes


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    for at in range(0, len(data), _CHUNK):
        lead = min(at, ORDER - 1)
        yield grams(data[at - lead : at + _CHUNK])[lead:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, counted) to (g, c): c is how often gram g is in counted texts; grams of other texts come with zero."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
    held = 0

    def merged() -> None:
        nonlocal keys, counts, held
        found = [(keys, counts)]
        for counted, parts in waiting.items():
            if parts:
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                found.append((k, n * counted))
            parts.clear()
        keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)
        held = 0

    for batch in batches:
        for data, counted in zip(byte_rows(batch.column(0)), batch.column(1).to_pylist()):
            for codes in _pieces(data or b""):
                waiting[bool(counted)].append(codes)
                held += len(codes)
                if held >= _HELD:
                    merged()
                    if len(keys) >= _HELD:
                        yield pa.record_batch([pa.array(keys), pa.array(counts)], ["g", "c"])
                        keys, counts = keys[:0], counts[:0]
    merged()
    yield pa.record_batch([pa.array(keys), pa.array(counts)], ["g", "c"])


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from its counts of counts; 0.5, 1 and 1.5 where those are too few."""
    n = {r.c: r.n for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not all(n.get(i) for i in (1, 2, 3, 4)):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3))


def probabilities(counted: DataFrame) -> DataFrame:
    """``(g, logp)`` for every gram of ``counted(g, c)``: interpolated modified Kneser-Ney, from the grams with c > 0.

    The highest order uses counts, each lower one the number of distinct bytes before a gram. An order whose context was
    never counted passes the lower order's probability on; below single bytes all are alike.
    """
    tables = {ORDER: materialize(counted.where("c > 0"), "kn")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialize(tables[k + 1].groupBy(_suffix(k).alias("g")).agg(F.count("*").alias("c")), "kn")
    asked = {ORDER: counted.select("g")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(_suffix(k).alias("g")).distinct()
    known = None
    for k in range(1, ORDER + 1):
        d = _discounts(tables[k])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = tables[k].groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), F.sum(off).alias("taken"))
        rows = asked[k].withColumn("h", F.shiftright("g", 8)).join(context, "h", "left").join(tables[k], "g", "left")
        if known is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.withColumn("s", _suffix(k - 1)).join(known.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
        own = F.coalesce(F.col("c") - off, F.lit(0.0)) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(own + F.col("taken") / F.col("total") * F.col("lower"))
        known = materialize(rows.select("g", p.alias("p")), "kn")
    return known.select("g", F.log("p").alias("logp"))


def _suffix(k: int):
    return F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))


class GramTable:
    """Open addressing in two arrays, filled and read by whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one place, the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.values[at]
        missed = np.flatnonzero(self.keys[at] != keys)
        while len(missed):
            at[missed] = (at[missed] + 1) & (len(self.keys) - 1)
            found = self.keys[at[missed]]
            out[missed] = self.values[at[missed]]
            missed = missed[(found != keys[missed]) & (found != -1)]
        return out


def _scorer(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in byte_rows(batch.column(2)):
                total = sum(float(table.value.get(codes).sum(dtype=np.float64)) for codes in _pieces(data)) if data else None
                found.append(None if total is None else -total / len(data))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.float64()), batch.column(3)], ["doc_id", "lang", "entropy", "trusted"])

    return run


def _joined_scores(rows: DataFrame, logp: DataFrame) -> DataFrame:
    """The scores by a shuffle join: each text's distinct grams with their counts meet the sharded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
                for codes in _pieces(data or b""):
                    k, n = np.unique(codes, return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(k), row)), pa.array(k), pa.array(n.astype(np.int64))], ["row", "g", "n"])

    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    counts = rows.select("row", "text").mapInArrow(run, "row long, g long, n long")
    sums = counts.join(logp, "g").groupBy("row").agg((-F.sum(F.col("logp") * F.col("n")) / F.sum("n")).alias("entropy"))
    return rows.join(sums, "row", "left").select("doc_id", "lang", "entropy", "trusted")


def _quantiles(scored: DataFrame, quantile: float) -> DataFrame:
    """``(for, limit)``: per language, and with ``for`` null in an array of one for all, the exact quantile in steps of 0.001."""
    bins = scored.where("entropy is not null").select(F.explode(F.array(F.array("lang"), F.array().cast("array<string>"))).alias("of"), F.ceil(F.col("entropy") * 1000).alias("bin"))
    bins = bins.groupBy("of", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("of").orderBy("bin"))
    total = F.sum("n").over(W.partitionBy("of"))
    bins = bins.select("of", "bin", (upto >= quantile * total).alias("reached"))
    return bins.where("reached").groupBy("of").agg((F.min("bin") / 1000).alias("limit"))


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, broadcast_grams: int = BROADCAST_GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, perplexity (a byte), threshold, keep.

    Trusted texts are those whose id ``labels(doc_id, quality)`` gives quality 1 and never 0. One in ``HELD_OUT`` of
    them, by a hash of the id, is left out of the counts and sets the thresholds: the ``quantile`` of their perplexities in
    the row's language, or over all where the language (null is one) has none. A null or empty text has no perplexity
    and isn't kept; without any held-out text all other rows are. Rows that repeat are judged each.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").cast("long").alias("t"))
    known = materialize(known, "trusted")
    few = known.count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known) if few else known, F.col("doc_id") == F.col("t"), "left").withColumn("trusted", F.col("t").isNotNull()).drop("t")
    held_out = F.col("trusted") & (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)
    counts = rows.select("text", (F.col("trusted") & ~held_out).alias("counted")).mapInArrow(_count, "g long, c long")
    counted = materialize(counts.groupBy("g").agg(F.sum("c").alias("c")), "grams")
    logp = probabilities(counted)
    if counted.count() <= broadcast_grams:
        known_grams = logp.toArrow()
        table = GramTable(known_grams["g"].to_numpy(), known_grams["logp"].to_numpy())
        shared = docs.sparkSession.sparkContext.broadcast(table)
        scored = rows.select("doc_id", "lang", "text", held_out.alias("trusted")).mapInArrow(_scorer(shared), "doc_id long, lang string, entropy double, trusted boolean")
    else:
        scored = _joined_scores(rows.select("doc_id", "lang", "text", held_out.alias("trusted")), logp)
    scored = materialize(scored, "scored")
    limits = materialize(_quantiles(scored.where("trusted"), quantile), "limits")
    everywhere = limits.where(F.size("of") == 0).select(F.col("limit").alias("any"))
    everywhere = everywhere.first()
    own = limits.where(F.size("of") == 1).select(F.col("of")[0].alias("l"), "limit")
    found = scored.join(own, F.col("lang").eqNullSafe(F.col("l")), "left")
    limit = F.coalesce("limit", F.lit(everywhere[0] if everywhere else float("inf")).cast("double"))
    keep = F.coalesce(F.col("entropy") <= limit, F.lit(False))
    return found.select("doc_id", "lang", F.exp("entropy").alias("perplexity"), F.exp(limit).alias("threshold"), keep.alias("keep"))
