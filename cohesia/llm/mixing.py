"""Mixing sources to target weights by Pareto order sampling.

Inside a source a document is expected the more often the longer it is: expected copies are one level of the source times
the number of binary digits of the document's words, up to the limit, and the level is such that expected words
meet the source's target. The whole part of the expectation is certain. What is left of it is the inclusion probability of
one more copy: documents are ranked by random odds over inclusion odds, and the first ones are taken while their words fit into
what the certain copies leave of the target. So the sample's size is fixed in words, as targets are. A long document that doesn't fit
ends that, and may leave more than a small part of the target: from the longest that fits to the shortest, the next documents of the ranking fill the rest. A document
with as many binary digits as the rest takes at least half of it, so one of each number of digits is enough. If the shortest
document left would then miss the target by less than it is missed without it, it is taken too.

The random number is a digest of the id, so reruns agree. The cut is found by two histograms of the ranking and a sort
of the one bin that holds it; documents that have no chance of another copy are not ranked. So no source, however
large, is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohesia.operators.canonical import dense_index
from cohesia.runtime import materialize

WEIGHTS, MAX_REPEATS, SEED = (5, 2, 1), 3, "mix-1"
_BITS = 10
#: The next documents of the ranking that may fill the rest, for each source and number of binary digits.
FILLERS = 8
#: The share of its target that a source may lack, or have too much, before other documents than the ranking's first fill it. Filling
#: prefers what fits, so it changes inclusion; sources of many documents don't need it.
TOLERANCE = 0.02
#: The most rows (sources, or sources and numbers of digits; some 100 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``.

    Sources by code point, null last, have ``weights`` in turn and share the total size. A target stops at
    ``max_repeats`` times its source's size and the excess goes to the others by weight: all that are not stopped get one
    level times their weight. Each round stops the sources that the level of the round before would take over their limit.
    """
    totals = dense_index(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.asc_nulls_last("source"), name="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = materialize(totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("cap")), "sources")
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        everything, caps, left, n = ranked.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == stopped or not left:
            break
        level, stopped = (everything - (caps or 0)) / left, n
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def expected_copies(sizes: DataFrame, targets: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, digits, source_size, target, whole, part, fill)``, a row for each source and number of binary digits of a size.

    whole and part add up to the expected copies of each such document; fill is what the certain copies leave of the target.
    A source has at most 63 rows. The level is found from above: documents of the most digits are the first at the limit.
    """
    classes = sizes.where("size > 0").groupBy("source", "digits").agg(F.sum("size").alias("words"))
    classes = classes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    above = W.partitionBy("source").orderBy(F.desc("digits")).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("source").orderBy("digits")
    capped = F.coalesce(F.sum("words").over(above), F.lit(0)) * max_repeats
    level = (F.col("target") - capped) / F.sum(F.col("words") * F.col("digits")).over(upto)
    tried = classes.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("digits") <= max_repeats, F.struct("digits", "level"))
    limit = F.lit(float(max_repeats))
    copies = F.least(F.coalesce(F.max(fits).over(W.partitionBy("source"))["level"] * F.col("digits"), limit), limit)
    copies = F.when(F.col("target") < F.col("source_size") * max_repeats, copies).otherwise(limit)
    whole = F.floor(copies).cast("long")
    found = tried.select("source", "digits", "source_size", "target", "words", whole.alias("whole"), (copies - whole).alias("part"))
    fill = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source"))
    return found.select("source", "digits", "source_size", "target", "whole", "part", fill.alias("fill"))


def _joined(rows: DataFrame, small: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    small = small.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in small.columns))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rows.join(F.broadcast(small) if few else small, on, "left").drop(*(f"_{k}" for k in keys))


def _cut(bins: DataFrame, digit: str) -> DataFrame:
    """For each source the bin that its fill ends in, and the words before it; sources that no bin cuts are left out."""
    sums = bins.groupBy("source", "fill", "before", digit).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy(digit)) + F.col("before")
    cut = sums.withColumn("upto", upto).where((F.col("upto") - F.col("words") <= F.col("fill")) & (F.col("fill") < F.col("upto")))
    return cut.select("source", (F.col("upto") - F.col("words")).alias(f"{digit}_before"), F.col(digit).alias(f"{digit}_cut"))


def sample(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, source, size, source_size, target, copies, taken.

    size is the number of words (null: 0), target that of the row's source, copies how often the mix takes it, at most
    ``max_repeats``, and taken copies times size. A null source is a source of its own, the last. A text without words
    adds nothing to a mix and is never taken. Rows that repeat an id have the same random number; ties go by id, then
    by hash of the text. A row without an id draws by its text. An empty table gives an empty result.
    """
    digest = _digest(seed, id_col, text_col)
    draw = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / float(1 << 48)
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        draw.alias("u"),
    )
    sizes = sizes.withColumn("row", F.monotonically_increasing_id())
    sizes = materialize(sizes.withColumn("digits", F.when(F.col("size") > 0, F.length(F.bin("size")))), "sizes")
    targets = materialize(source_targets(sizes.select("source", "size"), weights, max_repeats), "targets")
    expected = materialize(expected_copies(sizes, targets, max_repeats), "expected")
    few = max(targets.count(), expected.count()) <= BROADCAST_ROWS
    odds = F.col("u") / (1 - F.col("u")) * ((1 - F.col("part")) / F.col("part"))
    bucket = F.floor(F.col("odds") / (1 + F.col("odds")) * (1 << 2 * _BITS))
    open_ = F.col("part") > 0
    rows = _joined(_joined(sizes, expected.drop("source_size", "target"), ["source", "digits"], few), targets, ["source"], few)
    rows = rows.withColumn("odds", F.when(open_, odds)).withColumn("bucket", bucket)
    rows = rows.withColumn("hi", F.shiftright("bucket", _BITS)).withColumn("lo", F.col("bucket") % (1 << _BITS))
    first = materialize(_cut(rows.where(open_).withColumn("before", F.lit(0).cast("long")), "hi"), "cut")
    rows = _joined(rows, first, ["source"], few)
    inner = rows.where(open_ & (F.col("hi") == F.col("hi_cut"))).withColumn("before", F.col("hi_before"))
    second = materialize(_cut(inner, "lo"), "cut")
    rows = _joined(rows, second, ["source"], few)

    at_cut = F.coalesce((F.col("hi") == F.col("hi_cut")) & (F.col("lo") == F.col("lo_cut")), F.lit(False))
    # a fill that no bin cuts is more than all words that may be added
    under = F.coalesce((F.col("hi") < F.col("hi_cut")) | ((F.col("hi") == F.col("hi_cut")) & (F.col("lo") < F.col("lo_cut"))), F.lit(True))
    sure = rows.where(~at_cut).withColumn("more", F.coalesce(open_ & under, F.lit(False)).cast("int"))
    ahead = F.sum("size").over(W.partitionBy("source").orderBy("odds", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1))
    before = F.coalesce(ahead, F.lit(0)) + F.col("lo_before")
    most = F.least(F.col("fill") + F.col("size") / 2, F.col("fill") + TOLERANCE * F.col("target"))
    cut = rows.where(at_cut).withColumn("more", (before + F.col("size") <= most).cast("int"))
    names = ["row", "doc_id", "text_hash", "source", "size", "digits", "source_size", "target", "whole", "fill", "odds", "more"]
    dealt = materialize(sure.select(*names).unionByName(cut.select(*names)), "dealt")
    for fillers in (_fillers, _nearest):
        found = materialize(fillers(dealt), "fillers")
        chosen = (F.broadcast(found) if few else found).select("row", F.lit(1).alias("filler"))
        dealt = dealt.join(chosen, "row", "left").withColumn("more", F.coalesce("filler", "more")).drop("filler")
    both = dealt.withColumn("copies", (F.coalesce("whole", F.lit(0)) + F.col("more")).cast("int"))
    return both.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _later(dealt: DataFrame) -> DataFrame:
    """The documents that may have another copy and don't, of sources that lack more words than they may: ``rest``, beyond ``enough``."""
    open_ = dealt.where("odds is not null")
    got = open_.groupBy("source", "fill", "target").agg(F.sum(F.col("size") * F.col("more")).alias("got"))
    rest = got.select(F.col("source").alias("of"), (F.col("fill") - F.col("got")).alias("rest"), (TOLERANCE * F.col("target")).alias("enough")).where("rest > enough")
    return open_.where("more = 0").join(rest, F.col("source").eqNullSafe(F.col("of")))


def _nearest(dealt: DataFrame) -> DataFrame:
    """``(row)`` of each source's shortest document left, where that exceeds the target by less than the target is missed now."""
    close = _later(dealt).where(F.col("size") < 2 * F.col("rest"))
    return close.groupBy("source").agg(F.min(F.struct("size", "odds", "doc_id", "text_hash", "row")).alias("least")).select("least.row")


def _fillers(dealt: DataFrame) -> DataFrame:
    """``(row)`` of the documents that fill what the first ones of the ranking leave of each source."""
    later = _later(dealt).where(F.col("size") <= F.col("rest"))
    nth = F.row_number().over(W.partitionBy("source", "digits").orderBy("odds", "doc_id", "text_hash"))
    next_ = later.withColumn("nth", nth).where(F.col("nth") <= FILLERS)
    order = F.struct((-F.col("digits")).alias("shorter"), "nth", "size", "row")
    groups = next_.groupBy("source", "rest", "enough").agg(F.array_sort(F.collect_list(order)).alias("next"))
    start = F.struct(F.col("rest").alias("rest"), F.col("enough").alias("enough"), F.array().cast("array<bigint>").alias("rows"))

    def take(state: Column, x: Column) -> Column:
        fits = (x["size"] <= state["rest"]) & (state["rest"] > state["enough"])
        left = F.when(fits, state["rest"] - x["size"]).otherwise(state["rest"])
        return F.struct(left.alias("rest"), state["enough"].alias("enough"), F.when(fits, F.array_append(state["rows"], x["row"])).otherwise(state["rows"]).alias("rows"))

    return groups.select(F.explode(F.aggregate("next", start, take)["rows"]).alias("row"))


def _digest(seed: str, id_col: str, text_col: str) -> Column:
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))


def mix(docs: DataFrame, copy_col: str = "copy", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``copy_col`` counting from 1.

    All columns of ``docs`` stay; where one has the name ``copy_col``, the count is named with underscores before it.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    while copy_col in docs.columns:
        copy_col = "_" + copy_col
    found = materialize(sample(docs, **options).where("copies > 0").groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies")), "mix")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(F.col(text_col)).alias("_h"))
    same = F.col("_i").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash"))
    taken = rows.join(found.hint("shuffle_hash"), same)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select("_row.*", F.col("_copy").alias(copy_col))
