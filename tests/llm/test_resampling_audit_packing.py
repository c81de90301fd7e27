"""Importance resampling, filter audit and packing against brute force, on small and awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import awkward, docs_frame, labels_frame

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = {c: c + 32 for c in range(65, 91)}


def definition():
    with open(TOKENIZER, encoding="utf-8") as file:
        return file.read()


# importance resampling


def brute_features(text, longest=3):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_importance(rows, target, share=(5, 100), min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    found = [(i, *brute_features(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in brute_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for i, words, fs in found:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    open_ = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(open_[: share[0] * len(open_) // share[1]], 1):
        r[5] = rank
    return out


def test_features_of_blocks(monkeypatch):
    from cohesia.llm import resampling, text

    rng = random.Random(5)
    texts = ["", "One", "one two", "ä-b c_d 9,x  é\n\ty", " ".join(rng.choice(["a", "Bc", "d.e", "ß"]) for _ in range(300))]
    for block in (1, 7, 1 << 20):
        monkeypatch.setattr(text, "BLOCK", block)
        for t in texts:
            words, expected = brute_features(t)
            n, found = resampling.features(t.encode())
            assert n == len(words)
            assert sorted(found.tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in expected)
            assert len(resampling.features(t.encode(), 7, 1)[1]) == len(words)


def test_importance_and_resampling(spark):
    from cohesia.llm.resampling import importance, resample

    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 19, 20, 40])))) for i in range(300)]
    rows += [(i, rows[3][1] + " more words " * 10) for i in range(300, 360)] + [(400, None), (401, ""), (None, "x " * 25), (2, "y " * 30), (2, "y " * 30)]
    target = [" ".join(vocabulary[:10]), "w1 w2 w3", None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("clash")).repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    found = [tuple(r) for r in importance(docs, items).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    order = lambda rs: sorted(rs, key=lambda r: tuple((x is None, x or 0) for x in r))
    assert order(found) == order(map(tuple, brute_importance(rows, target)))
    drawn = Counter(r[0] for r in found if r[5] is not None)
    assert Counter(r["doc_id"] for r in resample(docs, items).collect()) == drawn
    assert resample(docs, items).columns == docs.columns
    # a larger share of a text with copies: each is drawn as often as it ranks
    half = importance(docs, items, share=(1, 2)).where("rank is not null")
    assert resample(docs, items, share=(1, 2)).count() == half.count() == sum(n[1] >= 20 for n in found) // 2


def test_importance_of_awkward_tables(spark):
    from cohesia.llm.resampling import importance, resample

    docs = awkward(spark)
    none = docs.where("false")
    items = docs.select("text")
    assert importance(docs, items).count() == docs.count()
    assert importance(none, items).count() == 0 == resample(none, items).count()
    assert importance(docs, none.select("text")).count() == docs.count()
    rows = {r["doc_id"]: r for r in importance(docs, items).collect()}
    assert [rows[i]["n_features"] for i in (2, 3, 4)] == [0, 0, 0] and [rows[i]["weight"] for i in (2, 3, 4)] == [0, 0, 0]


def test_importance_query_against_sql(spark):
    """By DuckDB's own rows, in which a null rank is None however its data frames write it."""
    import duckdb

    from cohesia.llm.queries import QUERIES, SQL

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    found = QUERIES["op11_importance_resampling"](spark, data).select(*columns).collect()
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL['op11_importance_resampling']})").fetchall()
    assert any(r[4] is None for r in expected) and any(r[4] for r in expected)
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


# filter audit


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = defaultdict(list)
    for i, text, _ in rows:
        least[text or ""].append(math.inf if i is None else i)
    masks = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": min(least[text]) < (math.inf if i is None else i),
        }
        masks.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [m for m in left if m[1][name]]
                left = [m for m in left if not m[1][name]]
                share[name] += len(gone)
                failing = [m for m in own if m[1][name]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(m[1].values()) == 1 for m in failing), sum(m[2] for m in gone), sum(m[3] for m in gone), name]
        for key, values in out.items():
            if key[0] == part:
                values[6] = share[values[6]]
    return out


@pytest.mark.parametrize("parts", [1, 256])
def test_audit(spark, monkeypatch, parts):
    from cohesia.llm import audit

    monkeypatch.setattr(audit, "_PARTS", parts)
    rng = random.Random(2)
    rows = []
    for i in range(120):
        words = [rng.choice(["alpha", "Beta", "GAMMA", f"u{rng.random()}"]) for _ in range(rng.choice([3, 199, 200, 260]))]
        if rng.random() < 0.3:
            words.append(rng.choice("#$%&*|"))
        rows.append((i, " ".join(words), rng.choice(["en", "de", None, ""])))
    rows += [(500 + i, rows[i % 7][1], "fr") for i in range(30)] + [(None, rows[0][1], "en"), (None, "alone", "en"), (None, "alone", "en"), (7, rows[7][1], "en"), (601, None, "en"), (602, "", "xx"), (603, "ÀÉ" * 99 + "A", "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(4)
    found = audit.filter_audit(docs, labels_frame(spark, labels)).collect()
    expected = brute_audit(rows, labels)
    assert len(found) == len(expected) == 600 * 5
    assert {(r[0], r[1], r[2]): list(r)[3:] for r in found} == expected


def test_audit_of_awkward_tables(spark):
    from cohesia.llm.audit import filter_audit, first_failures, masks

    docs, labels = awkward(spark), labels_frame(spark)
    assert filter_audit(docs.where("false"), labels).count() == 0
    assert filter_audit(docs, labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0
    assert filter_audit(docs, labels).count() == 600 * docs.select(F.coalesce("lang", F.lit(""))).distinct().count()
    assert masks(docs, labels).count() == docs.count()
    table = first_failures()
    assert table.shape == (32, 120) and (table[0] == 0).all() and (table[31] == 1).all()


# packing


def sequential(lengths, limits, weights, rule):
    """Best fit one item at a time, longest first."""
    scale, bins = np.sqrt(np.array(weights)) / np.array(limits), []
    for length in sorted(lengths, reverse=True):
        item = np.array([length, 1, length * length])
        open_ = [b for b in range(len(bins)) if (bins[b] >= item).all()]
        if not open_:
            bins.append(np.array(limits) - item)
            continue
        score = (lambda b: np.square((bins[b] - item) * scale).sum()) if rule == "norm" else (lambda b: -(bins[b] * scale * scale * item).sum())
        best = min(open_, key=score)
        bins[best] = bins[best] - item
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, None, None), (64, 5, None), (64, None, 1200), (64, 7, 900)])
def test_plan_is_best_fit_under_every_capacity(rule, limits):
    from cohesia.llm.packing import Capacities, place, plan

    rng = random.Random(str((rule, limits)))
    for weights in ((1.0, 1e-3, 1e-3), (1.0, 0.7, 0.3)):
        for _ in range(15):
            most = 64 if limits[2] is None else 30
            lengths = [min(most, int(rng.expovariate(1 / rng.choice([5, 25]))) + 1) for _ in range(rng.choice([0, 1, 50, 400]))]
            capacities = Capacities(*limits, weights=weights, rule=rule)
            counts = Counter(lengths)
            steps, n = plan(counts, capacities)
            items = np.array([(length, r) for length in counts for r in range(counts[length])], np.int64).reshape(-1, 2)
            bins, offset = place(steps, items[:, 0], items[:, 1]) if len(items) else (np.zeros(0, int), np.zeros(0, int))
            assert set(bins.tolist()) == set(range(n))
            for b in range(n):
                own = sorted(zip(offset[bins == b].tolist(), items[bins == b, 0].tolist()))
                assert [o for o, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))]
                used = [sum(x for _, x in own), len(own), sum(x * x for _, x in own)]
                assert (np.array(used) <= capacities.limits()).all()
            if rule == "norm":
                assert n == sequential(lengths, capacities.limits(), weights, rule)
            else:
                assert abs(n - sequential(lengths, capacities.limits(), weights, rule)) <= max(1, n // 50)


def test_plan_does_not_grow_with_the_items():
    from cohesia.llm.packing import Capacities, plan

    rng = random.Random(3)
    counts = {k: rng.randrange(1, 2000) for k in range(1, 1025)}
    small, few = plan(counts)
    large, n = plan({k: v * 10**6 for k, v in counts.items()})
    assert len(large) < 3 * len(small) < 100_000
    assert abs(n - few * 10**6) <= 1e-4 * n and few <= 1.02 * sum(k * v for k, v in counts.items()) / 1024
    with pytest.raises(ValueError):
        plan({1025: 1}, Capacities())


def test_encoder_equals_the_tokenizer(monkeypatch):
    from cohesia.llm import packing

    monkeypatch.setattr(packing, "_REMEMBERED", 20)
    whole, encoder, rng = Tokenizer.from_file(TOKENIZER), packing.Encoder(definition()), random.Random(4)
    bits = ["a", "Bcd", "über", "ß", "µ", "×", "ñÿ-", "́", "#", "<", "_", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "é", "日本", "1", "23", "!", ".", ",", "|", "<|endoftext|>", "\xa0", "　", "\x0b", "\x1c", "​", " x y", "word "]
    for n in range(4000):
        monkeypatch.setattr(packing, "_BLOCK", rng.choice([1, 5, 1 << 20]))
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_of_tables_equals_the_tokenizer(monkeypatch):
    import pyarrow as pa

    from cohesia.llm import packing

    whole, encoder, rng = Tokenizer.from_file(TOKENIZER), packing.Encoder(definition()), random.Random(8)
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    bits = [*spaces, " ", "  ", "\n", "\n\n", "a", "Zé", "ł", "ɐ", "×", "÷", "ª", "я", "Ѐѿ", "Ҁ", "҂", "Ͽ", "ȿ", "日", "’", "𝒳", "😀", "\u0301", "\0", "\x7f", "'", "''", "'s", "'re", "_", "<", "!?", "7", "²", "٣", "<|endoftext|>"]
    for n in range(400):
        monkeypatch.setattr(packing, "_BLOCK", rng.choice([1, 9, 60, 1 << 23]))
        texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 3, 12, 40]))) for _ in range(rng.randint(0, 12))]
        table = pa.array(["x", *texts], rng.choice([pa.string(), pa.large_string()])).slice(1)
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(table)]
        assert found == [whole.encode(t, add_special_tokens=False).ids for t in texts], texts


def test_encoder_asks_for_each_token_once():
    """Marks that stand together and hard spaces don't make new stretches of known words, nor does a worker's next task forget them."""
    from cohesia.llm import packing

    asked, encoder = [], packing.Encoder(definition())
    model, encode = encoder._model, encoder._encode
    encoder._model = lambda word: asked.append(word) or model(word)
    encoder._encode = lambda text, **options: asked.append(text) or encode(text, **options)
    encoder.ids("alpha,beta7(alpha).beta;7alpha\xa0 " + "gamma beta\n\n" * 500 + "(beta)\u3000" + " alpha" * 500)
    assert len(asked) < 25 and max(map(len, asked)) < 12
    assert packing.encoder(definition()) is packing.encoder(definition())


def test_encoder_of_other_pretokenizers():
    from tokenizers import Tokenizer, models, pre_tokenizers

    from cohesia.llm.packing import Encoder

    plain = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    for text in ("a b", "a\nb c", ""):
        assert np.frombuffer(Encoder(plain.to_str()).ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    from cohesia.llm.packing import Capacities, pack, sequences

    rng, whole = random.Random(6), Tokenizer.from_file(TOKENIZER)
    texts = [" ".join(rng.choice(["the", "Quality", "of", "x9", "über"]) for _ in range(rng.choice([0, 3, 30, 90, 700]))) for _ in range(80)] + [None, "", texts_of_one_length()]
    docs = docs_frame(spark, texts).withColumn("length", F.lit("clash")).withColumn("ids", F.lit(0)).repartition(3)
    capacities = Capacities(128)
    rows = pack(docs, definition(), capacities).collect()
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids[i])
        assert all(r["length"] == 128 for r in own[1:]) and own[0]["length"] <= 128
        assert len(own) == max(1, -(-len(ids[i]) // 128))
    assert set(by_doc) == set(ids)
    for own in by_bin.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 128
    assert len(by_bin) <= 1.03 * sum(map(len, ids.values())) / 128 + 1
    # the packed ids, cut up again, are the documents
    again = defaultdict(dict)
    for s in sequences(docs, definition(), capacities).collect():
        assert len(s["ids"]) <= 128
        for d in s["documents"]:
            again[d["doc_id"]][d["start"]] = s["ids"][d["offset"] : d["offset"] + d["length"]]
    assert {i: [x for start in sorted(parts) for x in parts[start]] for i, parts in again.items()} == ids


def texts_of_one_length():
    return "the " * 127


def test_packing_of_awkward_tables(spark):
    from cohesia.llm.packing import Capacities, pack, sequences

    docs = awkward(spark)
    rows = pack(docs, definition()).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert pack(docs.where("false"), definition()).count() == 0 == sequences(docs.where("false"), definition()).count()
    assert pack(docs, definition(), end=None).where("doc_id = 3").count() == 0
    few = pack(docs, definition(), Capacities(1024, documents=2)).groupBy("sequence_id").count()
    assert few.agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_packing_query(spark, sf):
    from cohesia.llm.queries import QUERIES

    rows = QUERIES["op13_best_fit_packing"](spark, f"/root/testdata/{sf}").toPandas()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024
    assert rows["sequence_id"].nunique() <= 1.01 * rows["length"].sum() / 1024 + 1
