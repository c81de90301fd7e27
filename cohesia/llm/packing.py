"""Vector best-fit packing of token sequences.

An item's length fixes all that it takes of a bin: its tokens, one document, and the square of its length as the cost of attention.
So items of one length are alike, and bins with the same residuals are too. The decreasing best-fit order is therefore
planned over one count per length: a run of bins that are alike takes items as one step, and the plan is a list of runs whose
size follows the bin's capacity, not the number of documents. Each item then finds its bin and place by its rank among the items of its
length, in a lookup.

Each length goes to the bins that have the least weighted norm of the residuals left after it, or the largest weighted dot product
of residuals and item, among those where all three residuals hold it; new bins take the rest.

Texts are tokenised whole. A text falls into stretches, of one pre-token each or a few, at places where the vocabulary's byte-level
pre-tokenizer ends a token whatever is around. A block of texts is split at once; each distinct stretch of it is looked up once, and a
worker remembers the ids of those that it has met, in the tasks after too.
"""

from __future__ import annotations

import json
import re
import string
import struct
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohesia.operators.canonical import dense_index
from cohesia.runtime import materialize, release

TOKENS, END = 1024, 2
#: What a byte is part of. Characters whose kind isn't known here are no white space (``_OTHER``), or maybe are (``_UNSURE``).
_SPACE, _LINE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER, _UNSURE = range(8)
_ASCII = {" ": _SPACE, "\t\n\r": _LINE, string.ascii_letters: _LETTER, string.digits: _DIGIT, string.punctuation: _MARK, "'": _APOSTROPHE, "\x0b\x0c\x1c\x1d\x1e\x1f": _UNSURE}
_KIND = bytes({ord(c): kind for chars, kind in _ASCII.items() for c in chars}.get(b, _OTHER) for b in range(256))
#: Code points beyond ASCII that some definition takes for white space.
_MAYBE_SPACE = np.array([0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x3000, 0xFEFF])
_WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8\xd0\xd1][\x80-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch
#: Texts are split in blocks of so many bytes, longer texts in pieces that end before white space.
_CUT, _BLOCK = re.compile(rb"(?<=[!-~])[ \t\n\r]"), 1 << 23
#: Stretches that a worker remembers, and as many again that it has met before those; longer stretches are not kept.
_REMEMBERED, _LONGEST_REMEMBERED = 300_000, 64
#: Pieces, and ids in them, that a task sends at a time.
_FLUSH_PIECES, _FLUSH_IDS = 1 << 16, 1 << 22


def _between(a: int, b: int) -> int:
    """1 where a token ends between neighbours of kinds ``a`` and ``b``; 2 where one ends before ``a``, the last white space of a run."""
    sure, blank = range(_LETTER, _UNSURE), (_SPACE, _LINE)
    if b in blank:
        return int(a in sure)
    if a in blank:
        return (2 + (a == _LINE)) * (b in sure)
    marks = (_MARK, _APOSTROPHE)
    alike = a == b or a in marks and b in marks
    # an apostrophe and letters may be a contraction
    return int(_OTHER not in (a, b) and _UNSURE not in (a, b) and not alike and (a, b) != (_APOSTROPHE, _LETTER))


_BETWEEN = bytes(_between(k >> 3, k & 7) if k < 64 else 0 for k in range(256))


def _byte_characters() -> str:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others, in turn, from U+0100 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return "".join(chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


_BYTE_CHARACTERS = _byte_characters()


def stretches(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the stretches begin of the UTF-8 texts that lie in ``data`` one after the other, between the places ``at``."""
    kind = np.frombuffer(bytearray(data).translate(_KIND), np.uint8)
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    code = (data[two] & 31).astype(np.int32) << 6 | data[two + 1] & 63
    letters = two[(code >= 0xC0) & (code < 0x240) & (code != 0xD7) & (code != 0xF7) | (code >= 0x400) & (code < 0x480)]
    kind[letters] = kind[letters + 1] = _LETTER
    unsure = two[np.isin(code, _MAYBE_SPACE)]
    kind[unsure] = kind[unsure + 1] = _UNSURE
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    code = (data[three] & 15).astype(np.int32) << 12 | (data[three + 1] & 63).astype(np.int32) << 6 | data[three + 2] & 63
    unsure = three[np.isin(code, _MAYBE_SPACE)]
    kind[unsure] = kind[unsure + 1] = kind[unsure + 2] = _UNSURE
    between = np.frombuffer(bytearray(kind[:-1] << 3 | kind[1:]).translate(_BETWEEN), np.uint8)
    inner = at[(at > 0) & (at < len(data))]
    between[inner - 1] = 0
    first = np.zeros(len(data), bool)
    first[1:] = between & 1
    first[:-1] |= between > 1
    first[inner] = first[:1] = True
    return np.flatnonzero(first)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids) if len(ids) < 100 else np.array(ids, "<u4").tobytes()


class Encoder(dict):
    """The ids of a stretch of UTF-8 text, as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        whole, parts = Tokenizer.from_str(definition), json.loads(definition)
        before = parts["pre_tokenizer"] or {}
        self._encode, self._model = whole.encode, whole.model.tokenize
        #: Whether stretches may be encoded alone, and a word be given to the model as it is.
        self._apart = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not (before.get("add_prefix_space") or parts["normalizer"] or parts["post_processor"])
        #: Texts that hold one of these go to the tokenizer as they are.
        self._added = "|".join(re.escape(t["content"]) for t in parts.get("added_tokens") or ())
        self._older: dict[bytes, bytes] = {}

    def __missing__(self, stretch: bytes) -> bytes:
        found = self._older.get(stretch)
        if found is None:
            found = self._word(stretch) if _WORD(stretch) else self._whole(stretch)
        if len(stretch) <= _LONGEST_REMEMBERED:
            if len(self) >= _REMEMBERED:
                self._older = dict(self)
                self.clear()
            self[stretch] = found
        return found

    def _word(self, word: bytes) -> bytes:
        return _packed([token.id for token in self._model(charmap_decode(word, "strict", _BYTE_CHARACTERS)[0])])

    def _whole(self, text: bytes) -> bytes:
        return _packed(self._encode(text.decode(), add_special_tokens=False).ids)

    def _block(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids of texts in ``data`` that are split at once."""
        data, at = data[at[0] : at[-1]], at - at[0]
        if not len(data):
            return [b""] * (len(at) - 1)
        starts = stretches(data, at)
        split = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = split.dictionary_encode()
        found = pa.array([self[s] for s in coded.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary()).take(coded.indices)
        _, places, ids = found.buffers()
        edges = np.frombuffer(places, np.int64)[np.searchsorted(starts, at)].tolist()
        ids = memoryview(ids)
        return [bytes(ids[a:b]) for a, b in pairwise(edges)]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each whole text, in turn; the same as those of the tokenizer on the whole."""
        if not len(texts):
            return
        alone = np.full(len(texts), not self._apart)
        if self._apart and self._added:
            alone = pc.match_substring_regex(texts, self._added).to_numpy(zero_copy_only=False)
        alone = np.append(np.flatnonzero(alone), len(texts))
        texts = texts.cast(pa.large_binary())
        _, places, data = texts.buffers()
        at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        i = 0
        while i < len(texts):
            stop, start, end = int(alone[np.searchsorted(alone, i)]), int(at[i]), int(at[i + 1])
            if stop == i:
                yield self._whole(data[start:end].tobytes())
                i += 1
            elif end - start > _BLOCK:
                found = []
                while start < end:
                    cut = _CUT.search(data, start + _BLOCK, end)
                    until = cut.start() if cut else end
                    found += self._block(data, np.array([start, until]))
                    start = until
                yield b"".join(found)
                i += 1
            else:
                j = min(stop, int(np.searchsorted(at, start + _BLOCK, side="right")) - 1)
                yield from self._block(data, at[i : j + 1])
                i = j

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        return next(self.encode(pa.array([text], pa.string())))


@lru_cache(maxsize=1)
def encoder(definition: str) -> Encoder:
    """A worker's encoder; the tasks that it runs one after the other share what it remembers."""
    return Encoder(definition)


def cuts(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: ``most`` each, the first one what is left over."""
    first = n % most or most
    yield 0, first
    for start in range(first, n, most):
        yield start, most


def pieces(docs: DataFrame, definition: str, most: int = TOKENS, end: int | None = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, piece, start, length, ids_crc32)`` of the token ids of each row of ``docs``, each closed with the id ``end``.

    ``definition`` is the tokenizer's file as text. With ``with_ids``, ``ids`` holds the piece's ids. A null text is empty; an empty one gives
    its closing id alone, or no piece where there is none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    last = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode

        def out() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * len(kinds)
            held.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

        held, n_ids = [], 0
        for batch in batches:
            for doc_id, text_hash, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encode(batch.column(2))):
                found = ids + last
                for piece, (start, length) in enumerate(cuts(len(found) // 4, most) if found else ()):
                    own = found[4 * start : 4 * (start + length)]
                    row = (doc_id, text_hash, piece, start, length, crc32(own))
                    held.append(row + (np.frombuffer(own, "<u4").astype(np.int32),) if with_ids else row)
                    n_ids += length
                if len(held) >= _FLUSH_PIECES or with_ids and n_ids >= _FLUSH_IDS:
                    yield out()
                    n_ids = 0
        yield out()

    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    schema = "doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        kinds["ids"], schema = pa.list_(pa.int32()), schema + ", ids array<int>"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)), text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Capacities:
    """What a bin holds, and the weights of what is left of each: tokens, documents, and the sum of squared lengths.

    Documents default to the tokens and cost to their square, which hold whenever tokens do.
    """

    tokens: int = TOKENS
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], np.int64)


#: A step of a plan: of the items of a length those from rank ``first`` on go, ``each`` to a bin, to bins from ``bin`` on, at ``offset``.
PLAN = ("length", "first", "each", "bin", "offset")


def plan(counts: dict[int, int], capacities: Capacities = Capacities()) -> tuple[np.ndarray, int]:
    """The steps of decreasing best fit over the number of items of each length, as rows of ``PLAN``, and the number of bins.

    A run of bins with the same residuals is one row of state. Each length splits two runs at most and opens two, so state and plan
    are bounded by the bin's capacity. A length that no empty bin holds is an error.
    """
    limits = capacities.limits()
    scale = np.sqrt(np.array(capacities.weights)) / limits
    state = np.zeros((0, 6), np.int64)  # first bin, bins, residuals, tokens used
    steps, bins = [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        item, left, rank = np.array([length, 1, length * length], np.int64), counts[length], 0
        most_empty = int((limits // item).min())
        if most_empty < 1:
            raise ValueError(f"an item of {length} tokens exceeds a bin's capacities {limits.tolist()}")
        while left:
            room = (state[:, 2:5] // item).min(axis=1)
            open_ = np.flatnonzero(room > 0)
            if not len(open_):
                break
            if capacities.rule == "norm":
                # what is left only gets smaller in a bin that took an item, so the same bin stays the best one until it is full
                order, each = open_[np.argsort(np.square((state[open_, 2:5] - item) * scale).sum(axis=1), kind="stable")], room
            else:
                dot = (state[open_, 2:5] * scale * scale * item).sum(axis=1)
                order, each = open_[[int(np.argmax(dot))]], np.ones_like(room)
            taken_before = np.concatenate([[0], np.cumsum(state[order, 1] * each[order])])
            used = order[taken_before[:-1] < left]
            new, split = [], []
            for r, before in zip(used.tolist(), taken_before.tolist()):
                first, n, *residual, offset = state[r].tolist()
                per, here = int(each[r]), min(left - before, n * int(each[r]))
                steps.append((length, rank + before, per, first, offset))
                whole, part = divmod(here, per)
                for at, m, took in ((first, whole, per), (first + whole, int(part > 0), part)):
                    if m:
                        new.append((at, m, *(x - took * y for x, y in zip(residual, item.tolist())), offset + took * length))
                rest = n - whole - (part > 0)
                if rest:
                    split.append((first + whole + (part > 0), rest, *residual, offset))
            done = min(left, int(taken_before[-1]))
            left, rank = left - done, rank + done
            state = np.concatenate([np.delete(state, used, axis=0), np.array([*new, *split], np.int64).reshape(-1, 6)])
        if left:
            steps.append((length, rank, most_empty, bins, 0))
            whole, part = divmod(left, most_empty)
            for at, m, took in ((bins, whole, most_empty), (bins + whole, int(part > 0), part)):
                if m:
                    state = np.concatenate([state, np.array([[at, m, *(limits - took * item), took * length]], np.int64)])
            bins += whole + (part > 0)
        state = state[(state[:, 2:5] > 0).all(axis=1)]
    return np.array(steps, np.int64).reshape(-1, len(PLAN)), bins


def place(steps: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of items, by their length and their rank among those of the length."""
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps, width = steps[order], np.int64(1) << 40
    at = np.searchsorted(steps[:, 0] * width + steps[:, 1], length * width + rank, side="right") - 1
    _, first, each, start, offset = steps[at].T
    nth = rank - first
    return start + nth // each, offset + nth % each * length


def assigned(cut: DataFrame, capacities: Capacities = Capacities()) -> DataFrame:
    """``cut(doc_id, text_hash, piece, length, ...)``, a table, with ``sequence_id`` and ``offset``; other columns as they are."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps, _ = plan(counts, capacities)
    starts, total = np.zeros(max(counts, default=0) + 1, np.int64), 0
    for length in sorted(counts):
        starts[length] = total
        total += counts[length]
    shared = cut.sparkSession.sparkContext.broadcast((steps, starts))
    names = cut.columns
    ranked = dense_index(cut, "length", F.asc_nulls_last("doc_id"), "piece", "text_hash", name="_place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, starts = shared.value
        for batch in batches:
            if batch.num_rows:
                length = batch.column("length").to_numpy()
                bins, offset = place(steps, length, batch.column("_place").to_numpy() - starts[length])
                yield pa.record_batch([*(batch.column(c) for c in names), pa.array(bins), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {kind}" for c, kind in cut.dtypes)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, definition: str, capacities: Capacities = Capacities(), end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of the rows of ``docs``: doc_id, text_hash, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text and the closing id; only documents beyond a bin's tokens are cut. A bin's pieces
    follow each other without a gap. Rows that repeat an id are documents of their own; a null id stays null; columns besides
    id and text are not read. An empty table gives an empty result.
    """
    cut = materialize(pieces(docs, definition, capacities.tokens, end, False, id_col, text_col), "pieces")
    return assigned(cut, capacities)


def sequences(docs: DataFrame, definition: str, capacities: Capacities = Capacities(), end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(sequence_id, ids, documents)``: the packed token ids of each bin, and its documents as structs of doc_id, piece, start, length and offset in their order."""
    cut = materialize(pieces(docs, definition, capacities.tokens, end, True, id_col, text_col), "pieces")
    placed = assigned(cut, capacities)
    held = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("held"))
    return held.select("sequence_id", F.flatten("held.ids").alias("ids"), F.transform("held", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("documents"))
