"""Benchmark decontamination: an FM-index per shard of documents, searched backward for the windows of test items.

A window is ``WINDOW`` consecutive words of an item, or all words of a shorter item. Words outside the items'
vocabulary can be in no occurrence, so each maximal run of vocabulary words is a text of its own in the index and
runs shorter than the shortest window are left out; both are exact. Occurrences are located through sampled
suffix positions and the spans they cover are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohesia.llm.fmindex import FMIndex
from cohesia.llm.text import LOWER_WORDS, byte_rows, word_blocks
from cohesia.runtime import materialize, release

WINDOW = 10
#: Words of documents in one shard.
SHARD_WORDS = 1 << 20
#: Memory of the items that are broadcast at a time, at ``WORD_BYTES`` a word and its own bytes; windows in one piece of an item.
BLOCK_BYTES, WORD_BYTES, PIECE = 64 << 20, 200, 1 << 14
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Windows:
    """The windows of a block of items: distinct phrases by length, and for each phrase the items that have it."""

    def __init__(self, pieces: Iterable[tuple[int | None, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        numbers: dict[int | None, int] = {None: -1}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, words in pieces:
            if item not in numbers:
                numbers[item] = len(self.items)
                self.items.append(str(item))
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
                windows = np.lib.stride_tricks.sliding_window_view(ids, min(WINDOW, len(ids)))
                found.setdefault(windows.shape[1], []).append((windows, np.full(len(windows), numbers[item])))
        #: by length: phrases, where the items of each begin in the last, numbers of items
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(found):
            phrases, which = np.unique(np.concatenate([w for w, _ in found[n]]), axis=0, return_inverse=True)
            pairs = np.stack([which.ravel(), np.concatenate([o for _, o in found[n]])], axis=1)
            pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
            self.by_length[n] = (phrases, np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1)), pairs[:, 1])
        self.shortest = min(self.by_length, default=0)


def search_shard(runs: list[np.ndarray], windows: Windows) -> Iterator[tuple[int, int, int, list[int]]]:
    """(run, first word, one past the last word, numbers of items) of every occurrence of a window in ``runs`` of word numbers."""
    if not runs:
        return
    lengths = np.array([len(r) + 1 for r in runs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    symbols = np.concatenate([x for r in runs for x in (r, _END)])
    # the alphabet is what occurs here, renumbered, so that the wavelet tree is only as deep as the shard needs
    used = np.unique(np.concatenate([_END, symbols]))
    index = FMIndex(np.searchsorted(used, symbols), len(used))
    for n, (phrases, first, items) in windows.by_length.items():
        local = np.searchsorted(used, phrases).clip(max=len(used) - 1)
        there = np.flatnonzero((used[local] == phrases).all(axis=1))
        low, high = index.find(local[there])
        for p in np.flatnonzero(high > low):
            mine = items[first[there[p]] : first[there[p] + 1]].tolist()
            for place in range(low[p], high[p], 1 << 16):
                for position in index.locate(np.arange(place, min(high[p], place + (1 << 16)))):
                    run = int(np.searchsorted(starts, position, side="right")) - 1
                    at = int(position - starts[run])
                    yield run, at, at + n, mine


_END = np.zeros(1, np.int64)


class _Doc:
    __slots__ = ("n_words", "spans", "items")

    def __init__(self):
        self.n_words, self.spans, self.items = 0, [], set()


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def scan(texts: list[bytes | None], windows: Windows) -> list[_Doc]:
    """Word count, merged spans of hit words and found items of each text."""
    docs, runs, owners, held = [], [], [], 0

    def search() -> None:
        nonlocal held
        for run, start, end, items in search_shard(runs, windows):
            doc, at = owners[run]
            docs[doc].spans.append((at + start, at + end))
            docs[doc].items.update(items)
        runs.clear()
        owners.clear()
        held = 0

    for data in texts:
        doc = _Doc()
        docs.append(doc)
        tail = np.zeros(0, np.int64)  # a run that goes on in the next block
        for words in word_blocks(data or b"", LOWER_WORDS):
            ids = np.concatenate([tail, np.fromiter(map(windows.vocabulary.get, words, _ZEROS), np.int64, len(words))])
            first = doc.n_words - len(tail)
            doc.n_words += len(words)
            cuts = np.flatnonzero(ids == 0)
            edges = np.concatenate([[-1], cuts, [len(ids)]])
            sizes = np.diff(edges) - 1
            for k in np.flatnonzero(sizes[:-1] >= max(1, windows.shortest)):
                runs.append(ids[edges[k] + 1 : edges[k + 1]])
                owners.append((len(docs) - 1, first + int(edges[k]) + 1))
                held += len(runs[-1])
            tail = ids[edges[-2] + 1 :]
            if held >= SHARD_WORDS:
                search()
        if len(tail) >= max(1, windows.shortest):
            runs.append(tail)
            owners.append((len(docs) - 1, doc.n_words - len(tail)))
            held += len(tail)
            if held >= SHARD_WORDS:
                search()
    search()
    for doc in docs:
        doc.spans = _merge(doc.spans)
        doc.items = {windows.items[i] for i in doc.items}
    return docs


class _Zeros:
    """Endless zeros, the default for words outside the vocabulary."""

    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` without the words of ``spans`` and what stands between them; one space joins what is left."""
    cuts, at, starts, ends = [], -1, {s for s, _ in spans}, {e - 1 for _, e in spans}
    for at, m in enumerate(_WORD.finditer(data)):
        if at in starts:
            cuts.append([m.start(), m.end()])
        if at in ends:
            cuts[-1][1] = m.end()
    out, done = [], 0
    for start, end in cuts:
        left = data[done:start].rstrip(b" ")
        out.append(left.lstrip(b" ") if done else left)
        done = end
    return b" ".join(filter(None, [*out, data[done:].lstrip(b" ")])) if cuts else data


def _scanner(windows, cut: bool):
    """Rows of (key, text) or of an earlier block's result; with ``cut``, the spans also go from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(byte_rows(batch.column(1)))
            found = scan(texts, windows.value)
            if batch.num_columns > 2:
                for doc, starts, ends, items in zip(found, *(batch.column(i).to_pylist() for i in (3, 4, 5))):
                    doc.spans, doc.items = _merge([*doc.spans, *zip(starts, ends)]), doc.items | set(items)
            left = batch.column(1)
            if cut and any(d.spans for d in found):
                clean = [t if t is None or not d.spans else remove_spans(t, d.spans) for t, d in zip(texts, found)]
                left = pa.array([None if t is None else t.decode() for t in clean], pa.string())
            columns = [
                pa.array([d.n_words for d in found], pa.int64()),
                pa.array([[s for s, _ in d.spans] for d in found], pa.list_(pa.int64())),
                pa.array([[e for _, e in d.spans] for d in found], pa.list_(pa.int64())),
                pa.array([sorted(d.items) for d in found], pa.list_(pa.string())),
            ]
            yield pa.record_batch([batch.column(0), left, *columns], ["key", "text", "n_words", "starts", "ends", "items"])

    return run


def item_pieces(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, words, cost)``: the words of each item in pieces of ``PIECE`` windows at most; a window lies whole in one piece."""
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    rows = items.select(F.col(id_col).cast("long").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)), F.lit(PIECE))
    pieces = rows.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at") + 1, F.lit(PIECE + WINDOW - 1)).alias("words"))
    return pieces.select("item", "words", (F.size("words") * WORD_BYTES + F.octet_length(F.array_join("words", ""))).cast("long").alias("cost"))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[Windows, bool]]:
    """The windows of the items in blocks, each brought to the driver by itself and with whether it is the last; one block at least.

    A block takes twice ``BLOCK_BYTES`` at most, or one piece.
    """
    pieces = materialize(item_pieces(items, id_col, text_col).withColumn("piece", F.monotonically_increasing_id()), "items")
    total, largest = pieces.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.coalesce(F.max("cost"), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK_BYTES))
    while blocks > 1 and pieces.groupBy(_block(blocks).alias("b")).agg(F.sum("cost").alias("c")).agg(F.max("c")).first()[0] > max(2 * BLOCK_BYTES, largest):
        blocks *= 2
    for b in range(blocks):
        rows = pieces.where(_block(blocks) == b).select("item", "words").collect()
        yield Windows((r.item, [w.encode() for w in r.words]) for r in rows), b == blocks - 1
    release(pieces)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("piece"), F.lit(blocks))


def _scanned(rows: DataFrame, items: DataFrame, item_col: str, item_text: str, cut: bool = False) -> DataFrame:
    """``(key, text, n_words, starts, ends, items)`` for ``rows(key, text)``.

    All blocks of items search the text as it came; the pass of the last one cuts, so blocks don't change the result.
    What earlier blocks found is a table in the shared folder.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["key"]]).add("text", "string").add("n_words", "long").add("starts", longs).add("ends", longs).add("items", T.ArrayType(T.StringType()))
    for windows, last in item_blocks(items, item_col, item_text):
        found = rows.mapInArrow(_scanner(rows.sparkSession.sparkContext.broadcast(windows), cut and last), schema)
        if not last:
            found = materialize(found, "scanned")
            release(rows)
        rows = found
    return rows


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, text, n_words, starts, ends, items)`` for each row of ``docs``: merged spans of hit words, in words, and found items.

    Null or wordless texts have no words and no spans. Items that are null or without words have no windows; an item
    without an id marks words but is not listed. Rows that repeat are judged each, by their own text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return _scanned(rows, items, item_col, item_text).withColumnRenamed("key", "doc_id")


def report(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = contamination(docs, items, **names)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def removed(docs: DataFrame, items: DataFrame, text_col: str = "text", count_col: str = "n_chars", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the hit spans cut out of the texts, all rows and columns kept.

    Spans are those of the text as it came, over all items, and go in one cut; a space joins what stood before and after
    one. Words that only the cut brings together were no passage of the text and stay, whatever they spell. Texts
    without hits stay byte for byte, a null text stays null, and a text that loses all its words keeps what stood
    around them. ``count_col``, where there is one, is recounted for texts that change.
    """
    rows = docs.select(F.struct("*").alias("key"), F.col(text_col).cast("string").alias("text"))
    found = _scanned(rows, items, item_col, item_text, cut=True)
    columns = []
    for f in docs.schema.fields:
        old = F.col("key").getField(f.name)
        if f.name == text_col:
            old = F.col("text")
        elif f.name == count_col:
            old = F.when(F.size("starts") > 0, F.length("text").cast(f.dataType)).otherwise(old)
        columns.append(old.alias(f.name))
    return found.select(columns)
