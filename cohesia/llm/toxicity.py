"""Toxicity: noisy-channel deobfuscation, then a classifier over the restored words.

A writer who hides a word replaces letters with look-alikes, spaces letters out or repeats them. For each token that may
be so made, a lattice holds what every character may stand for; a Viterbi search finds the restoration that the channel
and a character language model, counted over all documents, make likeliest. Other tokens have one path: themselves.

Words and word beginnings that toxic training texts have far more often than others become weighted features. A
logistic regression over how many features a text hits, fitted on rows that chose no features, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohesia.llm.text import byte_rows
from cohesia.runtime import materialize

#: What look-alike characters may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .-_*~'"
#: Log-probabilities of the channel: a look-alike for its letter, a separator put in, a letter repeated, a character meant as it stands,
#: a blank in a run of single characters that ends a word.
_SWAPPED, _SPACED, _REPEATED, _LITERAL, _ENDED = -1.0, -0.5, -0.7, -0.1, -0.5
_LITERAL_SYMBOL = -9.0
#: The longest token whose reading is remembered; longer ones are read again each time.
LONGEST = 64

#: The classes of bytes that the language model counts: 0 for what stands between words, letters, digits, bytes of other letters.
SYMBOLS = 156
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[128:] = np.arange(28, 156)
_CHUNK = 1 << 22

#: Lengths of word beginnings that are features; the least length of a word.
PREFIXES, SHORTEST = (4, 5, 6), 3
MIN_TOXIC, MIN_Z, MIN_ODDS = 3, 2.6, 2.5
#: Documented bound of the classifier: the most labelled rows that the regression is fitted on.
FIT_ROWS = 200_000
#: The most features that are broadcast (some 150 bytes each in a task); more are joined by shuffle.
BROADCAST_FEATURES = 200_000
_FLUSH = 500_000
BROADCAST_IDS = 4_000_000


def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, waiting, held = np.zeros(SYMBOLS**3, np.int64), [], 0

    def add() -> None:
        if waiting:
            counts[:] += np.bincount(np.concatenate(waiting), minlength=SYMBOLS**3)
            waiting.clear()

    for batch in batches:
        for data in byte_rows(batch.column(0)):
            size = len(data or b"")
            for at in range(0, size, _CHUNK):
                c = _CLASS[np.frombuffer(data[max(0, at - 2) : at + _CHUNK], np.uint8)]
                ends = [0] if at + _CHUNK >= size else []  # a text ends in a space, a piece doesn't
                c = np.concatenate([[] if at else [0, 0], c, ends]).astype(np.int32)
                waiting.append((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:])
                held += len(c)
                if held >= _CHUNK:
                    add()
                    held = 0
    add()
    codes = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(codes), pa.array(counts[codes])], ["code", "n"])


def language_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log-probability of each symbol after each two, interpolated with shorter contexts; SYMBOLS**3 numbers for any corpus."""
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_symbols, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(SYMBOLS**3)
    three[found["code"].to_numpy()] = found["n"].to_numpy()
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 0.5
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32).ravel()


class Restorer:
    """Viterbi decoding under the language model; remembers what it has decoded."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp
        self._short = lru_cache(1 << 17)(self._restore)

    def __reduce__(self):
        return Restorer, (self.logp,)

    def _step(self, state: tuple[int, int], letter: str) -> tuple[float, tuple[int, int]]:
        total, (a, b) = 0.0, state
        for byte in letter.encode():
            c = int(_CLASS[byte])
            total += float(self.logp[(a * SYMBOLS + b) * SYMBOLS + c])
            a, b = b, c
        return total, (a, b)

    def restore(self, token: str, words: bool = False) -> str:
        """The likeliest word behind ``token``; with ``words``, the likeliest words, with blanks between them."""
        return (self._short if len(token) <= LONGEST else self._restore)(token, words)

    def _restore(self, token: str, words: bool) -> str:
        literal_symbol = _LITERAL if token.isdigit() else _LITERAL_SYMBOL  # digits alone are a number unless the model prefers a word
        beam: dict[tuple, tuple[float, tuple]] = {((0, 0), ""): (0.0, ())}
        for char in token:
            grown: dict[tuple, tuple[float, tuple]] = {}
            for (state, last), (score, out) in beam.items():
                choices = []
                if char in SEPARATORS:
                    choices.append((_SPACED, ""))
                if words and char == " " and last != " ":
                    choices.append((_ENDED, " "))
                if char == last:
                    choices.append((_REPEATED, ""))
                if char.isalpha():
                    choices.append((_LITERAL, char))
                elif char not in SEPARATORS:
                    choices.append((literal_symbol, char))
                choices += [(_SWAPPED, letter) for letter in LOOKALIKES.get(char, "")]
                for cost, letter in choices:
                    gain, after = self._step(state, letter) if letter else (0.0, state)
                    key = (after, letter or last)
                    if key not in grown or grown[key][0] < score + cost + gain:
                        grown[key] = (score + cost + gain, (out, letter) if letter else out)
            beam = grown
        if not beam:
            return token
        out, letters = max(((s + self._step(state, " ")[0], out) for (state, _), (s, out) in beam.items()), key=lambda x: x[0])[1], []
        while out:
            out, letter = out
            letters.append(letter)
        return "".join(reversed(letters))


_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¿¡«»„“”‘’…–—"
_TRAIL = _EDGES.translate(dict.fromkeys(map(ord, "@$!|+(")))
_LETTERS = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"([^\W\d_])\1")
_SPACED_OUT = re.compile(r"(?<!\S)[\w@$!|+(€£¡](?:\s+[\w@$!|+(€£¡]){2,}(?!\S)")
_MASKED = re.compile(r"[\w@$!|+(€£¡]+(?:[.\-_*~']+[\w@$!|+(€£¡]+)*")
#: Long repeats say no more than short ones: of a character three stay, of separators one.
_REPEATS, _GAPS, _BLANKS = re.compile(r"(.)\1{3,}", re.DOTALL), re.compile(r"([.\-_*~'])[.\-_*~']+"), re.compile(r"\s+")
_SAME = re.compile("([" + re.escape("".join(LOOKALIKES)) + r"])\1+")
#: Characters of a text that are split at a time, and tokens that a task remembers.
_BLOCK, _REMEMBERED = 1 << 20, 300_000


def _blocks(text: str) -> Iterator[str]:
    """The lower-cased text in pieces that end after a token of two characters or more, so in no run of single ones."""
    start = 0
    while start < len(text):
        end = start + _BLOCK
        while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace() and not text[max(end - 2, 0)].isspace()):
            end += 1
        yield text[start:end].lower()
        start = end


def _hidden(token: str) -> bool:
    """Whether a token that isn't all letters may be a hidden word: letters or look-alikes, with separators among them."""
    return any(c.isalpha() or c in LOOKALIKES for c in token) and _MASKED.fullmatch(token) is not None


def _collapsed(token: str) -> set[str]:
    """The token with long repeats shortened, and also with one of each look-alike that repeats."""
    short = _GAPS.sub(r"\1", _REPEATS.sub(r"\1\1\1", token))
    return {short, _SAME.sub(r"\1", short)}


def token_words(raw: str, restorer: Restorer) -> list[str]:
    """The words of a token between white space: plain words as they are, and for hidden ones also what stands behind them."""
    plain = raw.rstrip(".,")
    if plain.isalpha() and not _TWICE.search(plain):
        return [plain]
    token, edged = raw.strip(_EDGES), raw.strip(_TRAIL)
    words = [token] if token.isalpha() else _LETTERS.findall(token)
    forms = {f for f in (token, edged) if f and not f.isalpha()}
    found = [restorer.restore(f) for f in sorted({c for f in forms if _hidden(f) for c in _collapsed(f)})]
    found += [restorer.restore(c) for w in words if _TWICE.search(w) for c in _collapsed(w)]
    return words + [w for w in dict.fromkeys(found) if w not in words and any(c.isalpha() for c in w)]


def _spaced_words(block: str, restorer: Restorer) -> Iterator[str]:
    """Words behind runs of single characters: as the model divides a run, and a run as one word, also without a single character at its ends."""
    for m in _SPACED_OUT.finditer(block):
        run = _BLANKS.sub(" ", m[0])
        found = restorer.restore(run, True).split(" ")
        found += map(restorer.restore, (run, run[2:], run[:-2], run[2:-2]))
        yield from dict.fromkeys(found)


def restored_words(text: str, restorer: Restorer) -> Iterator[str]:
    """The words of the restored text, lower-case."""
    for block in _blocks(text):
        for raw in block.split():
            yield from token_words(raw, restorer)
        yield from _spaced_words(block, restorer)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) >= n)] if len(word) >= SHORTEST else []


class _TokenFeatures(dict):
    """Features of a token's words, remembered."""

    def __init__(self, restorer: Restorer):
        self.restorer = restorer

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) >= _REMEMBERED // 4:  # these entries are the larger ones
            self.clear()
        found = self[raw] = tuple({f for w in token_words(raw, self.restorer) for f in features(w)})
        return found


def _count_features(restorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        known = _TokenFeatures(restorer.value)

        def out() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            found = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, clean))]
            toxic.clear()
            clean.clear()
            return pa.record_batch(found, ["feature", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                mine = set()
                for block in _blocks(text.as_py() or ""):
                    mine.update(*map(known.__getitem__, set(block.split())))
                    mine.update(f for w in _spaced_words(block, restorer.value) for f in features(w))
                (toxic if label else clean).update(mine)
                if len(toxic) + len(clean) >= _FLUSH:
                    yield out()
        yield out()

    return run


class Lexicon:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = {f.rstrip("~")[:4] for f in weights}

    def best(self, words: Iterable[str]) -> str | None:
        """The weightiest feature of ``words``."""
        near = [w for w in words if w[:4] in self.heads and len(w) >= SHORTEST]
        return max((f for w in near for f in features(w) if f in self.weights), key=lambda f: (self.weights[f], f), default=None) if near else None


class Reader(dict):
    """What each token means for the score, remembered: 0 no word, 1 words without a hit, -1 a single character, else 2 + the place of its feature."""

    def __init__(self, restorer: Restorer, lexicon: Lexicon):
        self.restorer, self.lexicon = restorer, lexicon
        self.places: dict[str, int] = {}

    def _place(self, feature: str) -> int:
        return 2 + self.places.setdefault(feature, len(self.places))

    def __missing__(self, raw: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        words = token_words(raw, self.restorer)
        best = self.lexicon.best(words)
        code = self._place(best) if best is not None else -1 if len(raw) == 1 and not raw.isspace() else int(bool(words))
        self[raw] = code
        return code

    def hits(self, text: str) -> tuple[int, int, int, float]:
        """Number of tokens with words, of those that hit, of different features hit, and the sum of the latter's weights."""
        n, found = 0, []
        for block in _blocks(text):
            tokens = block.split()
            codes = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
            n += int(np.count_nonzero(codes))
            found += codes[codes > 1].tolist()
            single = codes == -1
            if len(codes) > 2 and (single[:-2] & single[1:-1] & single[2:]).any():
                bests = (self.lexicon.best([w]) for w in _spaced_words(block, self.restorer))
                found += [self._place(b) for b in bests if b is not None]
        names = list(self.places)
        kinds = {names[c - 2] for c in found}
        return n, len(found), len(kinds), sum(map(self.lexicon.weights.get, sorted(kinds)))


def _measure(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            rows = [reader.hits(x.as_py() or "") for x in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]
            yield pa.record_batch([batch.column(0), *columns, batch.column(2), batch.column(3)], _MEASURED)

    return run


def _emit(shared):
    """Each text's distinct tokens and words of spaced runs, with how often they occur and their features; under token -1 the number of tokens with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = shared.value
        known = _TokenFeatures(restorer)
        held: list[tuple[int, int, int, str | None]] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            held.clear()
            return pa.record_batch(columns, ["row", "token", "c", "feature"])

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens, spaced = Counter(), Counter()
                for block in _blocks(text.as_py() or ""):
                    tokens.update(block.split())
                    spaced.update(_spaced_words(block, restorer))
                at = 0
                for found, c in [*((known[t], c) for t, c in tokens.items()), *((features(w), c) for w, c in spaced.items())]:
                    held += [(row, at, c, f) for f in found]
                    at += 1
                    if len(held) >= _FLUSH:
                        yield out()
                n = sum(c for t, c in tokens.items() if known[t] or len(t) == 1 or token_words(t, restorer))
                held.append((row, -1, n, None))
            if held:
                yield out()

    return run


def _joined_measures(rows: DataFrame, chosen: DataFrame, shared) -> DataFrame:
    """As :func:`_measure`, where the features are too many to broadcast: by a shuffle join."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    emitted = materialize(rows.select("row", "text").mapInArrow(_emit(shared), "row long, token long, c long, feature string"), "tokens")
    best = emitted.where("token >= 0").join(chosen.select("feature", "odds"), "feature").groupBy("row", "token").agg(F.max(F.struct("odds", "feature")).alias("best"), F.first("c").alias("c"))
    kinds = best.groupBy("row", "best").agg(F.sum("c").alias("c"))
    hits = kinds.groupBy("row").agg(F.sum("c").alias("hit"), F.count("*").alias("kinds"), F.sum("best.odds").alias("weight"))
    found = rows.drop("text").join(emitted.where("token = -1").select("row", F.col("c").alias("n")), "row").join(hits, "row", "left")
    return found.select("key", F.col("n").cast("double"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("hit", "kinds", "weight")), "toxic", "fold")


_MEASURED = ["key", "n", "hit", "kinds", "weight", "toxic", "fold"]


def _inputs(n: np.ndarray, hit: np.ndarray, kinds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(n), np.log1p(hit), np.log1p(kinds), np.log1p(weight), 100 * hit / np.maximum(n, 20)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton's method; without rows of both classes all scores are near 0."""
    beta = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        beta[0] = -5.0
        return beta
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - penalty * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, held_out, score, predicted.

    Labels are learned only from rows whose crc32 of the id is not divisible by 5: those with remainder 1 fit the
    regression, the others choose the features. Where rows of ``labels`` repeat an id, toxic wins. A null text counts as
    empty; an empty one gets the score of a text without hits. A row without an id is scored and never held out.
    Without usable labels of both classes all scores are near 0. Rows that repeat are scored each.
    """
    context = docs.sparkSession.sparkContext
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known, "labels")
    few = known.count() <= BROADCAST_IDS
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known) if few else known, F.col("doc_id") == F.col("l"), "left").withColumn("fold", fold)

    restorer = Restorer(language_model(docs, text_col))
    shared = context.broadcast(restorer)
    train = rows.where("toxic is not null and fold not in (0, 1)").select("text", "toxic")
    counts = train.mapInArrow(_count_features(shared), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    size = known.where(F.pmod(F.crc32(F.col("l").cast("string").cast("binary")), F.lit(5)) > 1)
    n_toxic, n_all = size.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    half = F.lit(0.5)
    odds = F.log((F.col("a") + half) / (F.greatest(n_toxic - F.col("a"), F.lit(0)) + half)) - F.log((F.col("b") + half) / (F.greatest(n_all - n_toxic - F.col("b"), F.lit(0)) + half))
    z = odds / F.sqrt(1 / (F.col("a") + half) + 1 / (F.col("b") + half))
    chosen = counts.where(F.col("a") >= MIN_TOXIC).select("feature", odds.alias("odds"), z.alias("z")).where((F.col("odds") >= MIN_ODDS) & (F.col("z") >= MIN_Z))
    chosen = materialize(chosen, "features")

    measured = rows.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"), "text", "toxic", "fold")
    if chosen.count() <= BROADCAST_FEATURES:
        lexicon = Lexicon({r.feature: r.odds for r in chosen.collect()})
        both = context.broadcast((restorer, lexicon))
        measured = measured.mapInArrow(_measure(both), "key struct<doc_id: long, text_hash: long>, n double, hit double, kinds double, weight double, toxic int, fold int")
    else:
        measured = _joined_measures(measured, chosen, shared)
    measured = materialize(measured, "toxicity")
    fit = measured.where("toxic is not null and fold = 1")
    share = FIT_ROWS / max(fit.count(), 1)
    if share < 1:
        fit = fit.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = fit.select("n", "hit", "kinds", "weight", "toxic").toArrow()
    columns = [sample[c].to_numpy().astype(float) for c in sample.column_names]
    beta = [float(b) for b in _fit(_inputs(*columns[:4]), columns[4])]
    line = F.lit(beta[0]) + F.log1p("hit") * beta[1] + F.log1p("kinds") * beta[2] + F.log1p("weight") * beta[3] + F.col("hit") * 100 / F.greatest("n", F.lit(20.0)) * beta[4]
    score = 1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))
    return measured.select(
        F.col("key.doc_id").alias("doc_id"),
        F.col("key.text_hash").alias("text_hash"),
        F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic, all columns as they are."""
    found = score_toxicity(docs, labels, id_col, text_col).where("predicted = 1").select("doc_id", "text_hash").distinct().hint("shuffle_hash")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(F.col(text_col)).alias("_h"))
    same = F.col("_i").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash"))
    return rows.join(found, same, "left_anti").select("_row.*")
