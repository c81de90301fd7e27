"""Registered queries against DuckDB, and the pipeline stage by stage against plain versions of its stages."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cohesia.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_query_against_sql(spark, compare, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert compare(queries.QUERIES[name](spark, DATA).toPandas()) == compare(con.execute(queries.SQL[name]).df())


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES if n.startswith("op")}


def test_pipeline(spark):
    """Each stage's table against a brute-force version on that stage's own input."""
    import corpus_pipeline
    from tests.llm.test_operators import brute_components, brute_hits, brute_lines, brute_simhash

    from cohesia.llm.lines import MIN_WORDS
    from cohesia.llm.toxicity import score_toxicity
    from cohesia.runtime import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], DATA), name))
    rows = [sorted(t.collect(), key=lambda r: r.doc_id) for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])

    toxic = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    assert rows[1] == [r for r in rows[0] if r.doc_id not in toxic]

    texts = [r.text for r in rows[1]]
    gone = brute_lines_fast(texts, MIN_WORDS)
    kept = ["\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]
    assert [r.text for r in rows[2]] == kept and [r.doc_id for r in rows[2]] == [r.doc_id for r in rows[1]]

    ids, prints = [r.doc_id for r in rows[2]], [brute_simhash(r.text) for r in rows[2]]
    assert [r.doc_id for r in rows[3]] == sorted(set(brute_components(ids, prints).values()))

    for before, after in zip(rows[3], rows[4], strict=True):
        n, hit, _ = brute_hits(before.text, items)
        assert (after.text == before.text) == (hit == 0)
        assert brute_hits(after.text, [])[0] == n - hit and after.n_chars == len(after.text)

    copies = {}
    for r in rows[5]:
        copies.setdefault(r.doc_id, []).append(r.copy)
        assert r.text == next(x.text for x in rows[4] if x.doc_id == r.doc_id)
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in copies.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, rows[5]))
    assert brute_lines(["a b\nc", "a b\nc"], 2) == {(1, 0), (1, 1)}


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Null, empty, long and repeated rows, clashing columns; and a table without rows."""
    import corpus_pipeline
    from tests.llm.test_operators import awkward, labels_frame

    docs = awkward(spark)
    labels_frame(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c d e f g"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.withColumn("copy", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == [*docs.columns, "copy", "_copy"]
    rows = found.collect()
    assert rows and all(r["size"] == r["copy"] == "clash" and r.text and 1 <= r._copy <= 3 for r in rows)
    assert not any("c d e" in r.text for r in rows if r.doc_id == 1)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def brute_lines_fast(texts, min_words):
    """As the brute force over all runs, but over runs of up to the length that first has enough words, from both ends."""
    from collections import defaultdict

    places = defaultdict(list)
    for d, t in enumerate(texts):
        lines = t.split("\n")
        words = [len(x.split()) for x in lines]
        runs = set()
        for s in range(len(lines)):
            e, n = s, 0
            while e < len(lines) and n < min_words:
                n += words[e]
                e += 1
            if n >= min_words:
                runs.add((s, e))
            e, n = s, 0
            while e >= 0 and n < min_words:
                n += words[e]
                e -= 1
            if n >= min_words:
                runs.add((e + 1, s + 1))
        for s, e in runs:
            places[tuple(lines[s:e])].append((d, s))
    return {(d, s + i) for run, at in places.items() for d, s in sorted(at)[1:] for i in range(len(run))}
