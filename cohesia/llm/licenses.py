"""Licence scans: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates.

The training set is fixed: paragraphs of each licence family with windows and gapped copies of them, statements made of a
way to state a licence and a name, and an unknown class. A sparse softmax regression is fitted on it on the driver; its
weights are a table of a few thousand rows, whatever the size of the corpus. Its temperature is fitted on ways of stating
and windows that training never saw.

Every paragraph is judged, by DataFrame functions alone. Most paragraphs can be judged by what they lack: the model's
anchors are words such that the n-grams without any of them can't add up to a family, whatever their number (see
:func:`anchors`). A paragraph without an anchor is of the unknown class by that bound; of the others the n-grams meet the
weights in a broadcast join.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohesia.llm.license_texts import COMMON_WORDS, DECOYS, LEADS, NAMES, PARAGRAPHS, RESERVED
from cohesia.runtime import materialize

UNKNOWN = "unknown"
CLASSES = (UNKNOWN, *sorted(PARAGRAPHS))
#: The least probability of a family, and the least share of the shorter side's n-grams that template and paragraph share.
MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.5
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: A newline inside a paragraph: after a line that ends no sentence, before a small letter.
WRAPPED = r"(?<=[^\s.!?:;])[ \t]*\r?\n(?=[ \t]*[a-z])"
_ROUNDS, _RATE, _SPARSE, _RIDGE = 300, 8.0, 2e-5, 2e-6


def ngrams(text: str) -> list[str]:
    """Distinct words and word pairs, lower-case, without those of common words alone."""
    words = re.findall(WORD, text.lower())
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:]) if a not in COMMON_WORDS or b not in COMMON_WORDS]
    return list(dict.fromkeys([*(w for w in words if w not in COMMON_WORDS), *pairs]))


def _variants(text: str) -> list[tuple[str, str]]:
    """(part, text): the paragraph, its windows and copies with every fourth word missing, dealt to the three parts."""
    words = text.split()
    windows = [" ".join(words[at : at + n]) for n in (8, 14, 24) if n < len(words) for at in range(0, len(words) - n + 1, 4)]
    gapped = [" ".join(w for i, w in enumerate(words) if i % 4 != k) for k in range(4)] if len(words) >= 8 else []
    return [("train", text), *((("train", "train", "train", "calibrate", "measure")[i % 5], v) for i, v in enumerate([*windows, *gapped]))]


def examples(part: str) -> list[tuple[str, str]]:
    """(class, text) of ``train``, ``calibrate`` or ``measure``. Statements share no wording between parts but the names."""
    found = [(family, v) for family, texts in PARAGRAPHS.items() for text in texts for p, v in _variants(text) if p == part]
    found += [(family, lead.format(name)) for family, names in NAMES.items() for name in names for lead in LEADS[part]]
    found += [("proprietary", text.format(year)) for text in RESERVED[part] for year in ("1999", "2014", "2023")]
    for text in DECOYS[part]:
        words = text.split()
        found += [(UNKNOWN, text), *((UNKNOWN, " ".join(words[at : at + 6])) for at in range(0, len(words) - 6, 3))]
    return [(c, t) for i, (c, t) in enumerate(found) if (c, t) not in found[:i]]


class Model:
    """Weights per n-gram and class, already divided by the temperature; each n-gram of a text counts 1 / sqrt(number of its n-grams)."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.vocabulary, self.weights, self.bias, self.temperature = vocabulary, weights / temperature, bias / temperature, temperature

    def anchors(self) -> list[str]:
        """Words without which no text can be of a family.

        A family's probability of ``MIN_PROBABILITY``, a half or more, takes a score above the unknown class's. Of a text without
        anchors at most m n-grams have weights, none of which contains an anchor, and each counts 1 / sqrt(m) at most. So the
        difference is at most the bias's plus the largest sum of the m highest differences over sqrt(m). Words are taken as
        anchors, by the highest difference of an n-gram that has them, until that is below zero for every family.
        """
        grams = list(self.vocabulary)
        lead = self.weights[:, 1:] - self.weights[:, :1]
        best: dict[str, float] = {}
        for g, d in zip(grams, lead.max(axis=1)):
            for w in set(g.split(" ")) - COMMON_WORDS:
                best[w] = max(best.get(w, 0.0), float(d))
        order = sorted(best, key=lambda w: (-best[w], w))
        gap = self.bias[1:] - self.bias[0]

        def enough(n: int) -> bool:
            taken = set(order[:n])
            rest = lead[[not taken.intersection(g.split(" ")) for g in grams]]
            top = np.sort(np.maximum(rest, 0), axis=0)[::-1]
            reach = (np.cumsum(top, axis=0) / np.sqrt(np.arange(1, len(top) + 1))[:, None]).max(axis=0, initial=0.0)
            return bool((gap + reach < -1e-6).all())

        low, high = 0, len(order)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if enough(middle) else (middle + 1, high)
        if not enough(low):
            raise ValueError("the bias alone makes a family")
        return sorted(order[:low])


@cache
def model() -> Model:
    """The softmax regression, by proximal gradient steps with a sparsity penalty."""
    train = [(ngrams(t), CLASSES.index(c)) for c, t in examples("train")]
    held = [(ngrams(t), CLASSES.index(c)) for c, t in examples("calibrate")]
    train += [(["-"] * n, 0) for n in (4, 8, 16, 32)]  # texts of no known word
    vocabulary = {g: i for i, g in enumerate(sorted({g for gs, _ in train for g in gs if g != "-"}))}

    def matrix(rows) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, (gs, _) in enumerate(rows):
            x[i, [vocabulary[g] for g in gs if g in vocabulary]] = 1 / max(1, len(gs)) ** 0.5
        return x, np.eye(len(CLASSES), dtype=np.float32)[[y for _, y in rows]]

    x, y = matrix(train)
    share = (y / y.sum(axis=0) / len(CLASSES)).sum(axis=1, keepdims=True)  # families weigh alike
    share[y[:, 0] == 1] *= 3
    weights, bias = np.zeros((len(vocabulary), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    ahead, last = weights, weights
    for k in range(_ROUNDS):
        slope = (_softmax(x @ ahead + bias) - y) * share
        stepped = ahead - _RATE * (x.T @ slope + _RIDGE * ahead)
        weights = np.sign(stepped) * np.maximum(np.abs(stepped) - _RATE * _SPARSE, 0)
        bias = bias - _RATE * 0.1 * slope.sum(axis=0)
        ahead, last = weights + k / (k + 3) * (weights - last), weights
    x, y = matrix(held)
    loss = {t: -np.log(np.maximum((_softmax((x @ weights + bias) / t) * y).sum(axis=1), 1e-12)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    used = np.abs(weights).max(axis=1) > 0
    grams = [g for g, i in vocabulary.items() if used[i]]
    return Model({g: i for i, g in enumerate(grams)}, weights[used].astype(float), bias.astype(float), min(loss, key=loss.get))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def templates() -> list[tuple[str, str]]:
    """(family, text) of the paragraphs and of each name in the first way of stating it."""
    named = [(family, name) for family, names in NAMES.items() for name in names]
    return [(family, t) for family, texts in PARAGRAPHS.items() for t in texts] + named + [("proprietary", "all rights reserved")]


def _weights_table(spark: SparkSession) -> DataFrame:
    """``(gram, w)``: w holds a weight per class. Its size is that of the fixed training set."""
    m = model()
    return spark.createDataFrame([(g, [float(v) for v in m.weights[i]]) for g, i in m.vocabulary.items()], "gram string, w array<double>")


def _templates_table(spark: SparkSession) -> DataFrame:
    """``(gram, template, family, n_template)``, a row for each n-gram of each template."""
    rows = [(g, i, family, len(gs)) for i, (family, text) in enumerate(templates()) if (gs := ngrams(text)) for g in gs]
    return spark.createDataFrame(rows, "gram string, template int, family string, n_template int")


def _grams(words: Column) -> Column:
    """As :func:`ngrams`, in another order."""
    common = sorted(COMMON_WORDS)
    following = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(words, following, lambda a, b: F.when(~(a.isin(common) & b.isin(common)), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(F.filter(words, lambda w: ~w.isin(common)), F.filter(pairs, lambda p: p.isNotNull())))


def paragraphs(text: Column) -> Column:
    """Lines, of which a wrapped one goes on in the next."""
    return F.split(F.regexp_replace(text, WRAPPED, " "), "\n", -1)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph that has an anchor: doc_id, paragraph, family, probability, similarity, confirmed.

    All other paragraphs are unknown by the model, which their lack of an anchor proves, and have no row. paragraph counts
    paragraphs from 0 (see :func:`paragraphs`); family is the likeliest one, or unknown where the probability of every
    family is under ``MIN_PROBABILITY``; similarity is the largest share of n-grams, of the shorter side's, in common with a
    template of the family (unknown: 0), and confirmed tells whether that is enough. Null and empty texts have no
    paragraphs; rows that repeat are judged each.
    """
    spark, m = docs.sparkSession, model()
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(paragraphs(F.col(text_col).cast("string"))).alias("paragraph", "line"))
    words = lines.select("doc_id", "paragraph", F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), 1).alias("words"))
    found = words.where(F.arrays_overlap("words", F.array(*map(F.lit, m.anchors())))).select("doc_id", "paragraph", _grams(F.col("words")).alias("grams"))
    found = materialize(found.withColumn("id", F.monotonically_increasing_id()), "paragraphs")

    grams = found.select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    scale = 1 / F.sqrt("n")
    sums = [F.sum(F.coalesce(F.col("w")[i], F.lit(0.0)) * scale).alias(f"z{i}") for i in range(len(CLASSES))]
    logits = grams.join(F.broadcast(_weights_table(spark)), "gram", "left").groupBy("id").agg(*sums)
    z = [F.col(f"z{i}") + float(b) for i, b in enumerate(m.bias)]
    top = F.greatest(*z)
    whole = sum((F.exp(c - top) for c in z), F.lit(0.0))
    best = F.greatest(*(F.struct((F.exp(c - top) / whole).alias("p"), F.lit(name).alias("family")) for c, name in zip(z[1:], CLASSES[1:])))
    judged = logits.select("id", best.alias("best")).select("id", F.col("best.p").alias("probability"), "best.family")
    judged = judged.withColumn("family", F.when((F.col("probability") >= MIN_PROBABILITY), F.col("family")).otherwise(UNKNOWN))

    shared = grams.join(F.broadcast(_templates_table(spark)), "gram").groupBy("id", "template", "family").agg((F.count("*") / F.least(F.first("n"), F.first("n_template"))).alias("share"))
    shared = shared.groupBy("id", "family").agg(F.max("share").alias("share"))
    out = found.select("id", "doc_id", "paragraph").join(judged, "id", "left").join(shared, ["id", "family"], "left")
    similarity = F.coalesce("share", F.lit(0.0))
    return out.select(
        "doc_id",
        F.col("paragraph").cast("long").alias("paragraph"),
        F.coalesce("family", F.lit(UNKNOWN)).alias("family"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
        similarity.alias("similarity"),
        (similarity >= MIN_SIMILARITY).alias("confirmed"),
    )
