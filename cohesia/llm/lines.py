"""Line dedup: a suffix array over line ids by distributed prefix doubling, and its longest-common-prefix intervals.

Lines get 128-bit ids. A line that occurs once ends every repeated run, so only runs of lines that occur again take
part. Doubling keeps, for each place, an order-preserving rank of the 2^k lines that start there; the next
rank is that of the pair (rank here, rank 2^k lines on). Ranks come from a range-partitioned sort of the distinct
pairs, so a frequent line is one row of that sort.

A repeated run counts if it has ``min_words`` words. Such runs are exactly the unions of shortest such runs, starting or
ending at each line, and a shortest run of m lines is a longest-common-prefix interval of the suffix array at depth m:
it is known by the ranks of its first and of its last 2^k lines, 2^k <= m < 2^(k+1). Doubling therefore stops at the
longest shortest run. In each interval the first place keeps its lines; at every other place the run is a later copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohesia.runtime import materialize, release, shuffle_parts

MIN_WORDS = 25
_LAST = (1 << 63) - 1
_DOC = ["doc", "digest"]


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.col(text_col)).alias("digest")]


def line_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, digest, pos, a, b, words)``: each line of each text with its id (a, b) and its number of words."""
    lines = docs.select(*_keys(id_col, text_col), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+"))
    out = materialize(lines.select(*_DOC, "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("2"), "line").alias("b"), words.alias("words")), "lines")
    again = out.where("pos = 0").groupBy(*_DOC).count().where("count > 1").limit(1).count()
    return out.dropDuplicates([*_DOC, "pos"]) if again else out


def segments(lines: DataFrame, min_words: int) -> DataFrame:
    """Maximal runs of lines that each occur again, with ``min_words`` in all: adds seg, first, end (exclusive), upto and total words."""
    # as a table of its own, so that the join reads two plain shuffles and a frequent line's rows can be split
    often = materialize(lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "often")
    rows = lines.join(often, ["a", "b"])
    rows = rows.withColumn("seg", F.col("pos") - F.row_number().over(W.partitionBy(*_DOC).orderBy("pos")))
    seg = W.partitionBy(*_DOC, "seg")
    return rows.select(
        *_DOC, "pos", "a", "b", "words", "seg",
        F.min("pos").over(seg).alias("first"),
        (F.max("pos").over(seg) + 1).alias("end"),
        F.sum("words").over(seg.orderBy("pos")).alias("upto"),
        F.sum("words").over(seg).alias("total"),
    ).where(F.col("total") >= min_words)


def shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """``(doc, digest, start, m)``: for each line the shortest runs of ``min_words`` that start, and that end, with it.

    Both are a merge of line boundaries with wanted boundaries in the order of words so far: at each wanted one, the
    running least boundary met is the answer. For runs that end with a line, positions are negated.
    """
    before = F.col("upto") - F.col("words")

    def event(back: bool, key: Column, wanted: bool, place: Column) -> Column:
        return F.struct(F.lit(back).alias("back"), key.cast("long").alias("key"), F.lit(wanted).alias("wanted"), place.cast("long").alias("place"))

    opening, none = F.col("pos") == F.col("first"), F.array().cast("array<struct<back:boolean,key:bigint,wanted:boolean,place:bigint>>")
    events = F.concat(
        F.array(event(False, -before, False, F.col("pos")), event(True, F.col("upto"), False, -F.col("pos"))),
        F.when(opening, F.array(event(False, -F.col("total"), False, F.col("end")), event(True, F.lit(0), False, 1 - F.col("first")))).otherwise(none),
        F.when(before + min_words <= F.col("total"), F.array(event(False, -(before + min_words), True, F.col("pos")))).otherwise(none),
        F.when(F.col("upto") >= min_words, F.array(event(True, F.col("upto") - min_words, True, F.col("pos")))).otherwise(none),
    )
    merged = rows.select(*_DOC, "seg", F.inline(events))
    order = W.partitionBy(*_DOC, "seg", "back").orderBy("key", "wanted").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = merged.withColumn("met", F.min(F.when(~F.col("wanted"), F.col("place"))).over(order)).where("wanted")
    start = F.when(F.col("back"), 1 - F.col("met")).otherwise(F.col("place"))
    end = F.when(F.col("back"), F.col("place") + 1).otherwise(F.col("met"))
    return found.select(*_DOC, start.cast("int").alias("start"), (end - start).cast("int").alias("m")).distinct()


def _ranks(pairs: DataFrame) -> DataFrame:
    """``(a, b, r)`` for the distinct pairs, r in the order of (a, b)."""
    n = shuffle_parts(pairs.sparkSession)
    ordered = pairs.select("a", "b").distinct().repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b")
    return materialize(ordered.withColumn("r", F.monotonically_increasing_id()), "ranks")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, digest, start, end)`` of every shortest run that is a later copy of another one."""
    rows = materialize(segments(lines, min_words), "segments")
    wanted = materialize(shortest_runs(rows, min_words), "runs")
    deepest = wanted.agg(F.max("m")).first()[0] or 0
    ranks = _ranks(rows)
    state = materialize(rows.join(ranks, ["a", "b"]).select(*_DOC, "pos", "first", "end", "r"), "state")
    release(ranks)
    found, k = [], 0
    while 1 << k <= deepest:
        width = 1 << k
        mine = wanted.where((F.col("m") >= width) & (F.col("m") < 2 * width))
        here = state.select(*_DOC, F.col("pos").alias("start"), F.col("r").alias("ra"))
        there = state.select(*_DOC, F.col("pos").alias("tail"), F.col("r").alias("rb"))
        named = mine.join(here, [*_DOC, "start"]).withColumn("tail", F.col("start") + F.col("m") - width).join(there, [*_DOC, "tail"])
        found.append(materialize(named.select(*_DOC, "start", "m", "ra", "rb"), "named"))
        k += 1
        if 1 << k <= deepest:
            on = W.partitionBy(*_DOC).orderBy("pos").rangeBetween(width, width)
            second = F.when(F.col("pos") + width < F.col("end"), F.max("r").over(on)).otherwise(F.lit(-1).cast("long"))
            pairs = materialize(state.where(F.col("end") - F.col("first") >= 2 * width).select(*_DOC, "pos", "first", "end", F.col("r").alias("a"), second.alias("b")), "pairs")
            ranks, old = _ranks(pairs), state
            state = materialize(pairs.join(ranks, ["a", "b"]).select(*_DOC, "pos", "first", "end", "r"), "state")
            release(ranks, old, pairs)
    release(state, rows, wanted)
    if not found:
        return lines.sparkSession.createDataFrame([], "doc long, digest long, start int, end int")
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    interval = ["m", "ra", "rb"]
    place = F.struct(*_DOC, "start")
    shared = materialize(runs.groupBy(*interval).agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1"), "intervals")
    later = runs.join(shared, interval).where(place != F.col("least"))
    return later.select(*_DOC, "start", (F.col("start") + F.col("m")).alias("end"))


def removal_spans(runs: DataFrame) -> DataFrame:
    """``(doc, digest, spans)``: the maximal runs of lines to delete, as an array of (start, end), end exclusive."""
    before = F.max("end").over(W.partitionBy(*_DOC).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    opened = runs.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("new").over(W.partitionBy(*_DOC).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy(*_DOC, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _with_spans(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``(_row, _text, spans, _lines)`` for each row of ``docs``; _lines is null where nothing goes."""
    spans = materialize(removal_spans(repeated_runs(line_ids(docs, id_col, text_col), min_words)), "spans")
    doc, digest = _keys(id_col, text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).cast("string").alias("_text"), doc.alias("_doc"), digest.alias("_digest"))
    joined = rows.join(spans.hint("shuffle_hash"), (F.col("_doc") == F.col("doc")) & (F.col("_digest") == F.col("digest")), "left")
    return joined.select("_row", "_text", "spans", F.when(F.col("spans").isNotNull(), F.split("_text", "\n", -1)).alias("_lines"))


def _kept() -> Column:
    """The text without its spans: what lies between them, joined. Spans are sorted and apart, so each line is copied once."""
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.size("_lines")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 1, b - a))
    return F.when(F.col("spans").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(pieces), "\n"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with the later copies of repeated line runs of ``min_words`` deleted; all rows and columns stay.

    The first copy, by doc_id (null last), then place, stays. A text that loses all lines becomes empty; a null text
    stays null. Rows that repeat id and text are one document and fare alike. ``count_col`` is recounted where the
    text changed.
    """
    found = _with_spans(docs, min_words, id_col, text_col).withColumn("_kept", _kept())
    columns = []
    for f in docs.schema.fields:
        old = F.col("_row").getField(f.name)
        if f.name == text_col:
            old = F.col("_kept")
        elif f.name == count_col:
            old = F.when(F.col("spans").isNull(), old).otherwise(F.length("_kept").cast(f.dataType))
        columns.append(old.alias(f.name))
    return found.select(columns)


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed and the SHA-256 of what is kept (null: 0, 0 and null)."""
    found = _with_spans(docs, min_words, id_col, text_col)
    gone = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("_row").getField(id_col).cast("long").alias("doc_id"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(F.split("_text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(_kept().cast("binary"), 256).alias("kept_sha256"),
    )
