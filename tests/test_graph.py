"""Graph operators against the golden example, micro-fixtures, edge cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohesia.functions import balance, ragged
from cohesia.operators import canonical, sets, triangles, truss
from cohesia.operators import access
from cohesia.operators.access import Graph, prefix_sums
from cohesia.sources import edges as sources

#: (src, dst, support, trussness) of the example graph.
GOLDEN = [
    (1, 2, 2, 4), (1, 3, 2, 4), (1, 4, 3, 4), (1, 5, 1, 3), (2, 3, 2, 4), (2, 4, 2, 4), (3, 4, 3, 4), (3, 7, 2, 3), (3, 9, 1, 3),
    (4, 5, 3, 4), (4, 6, 2, 4), (4, 7, 3, 4), (5, 6, 2, 4), (5, 7, 2, 4), (6, 7, 4, 4), (6, 8, 2, 4), (6, 11, 2, 4), (7, 8, 4, 5),
    (7, 9, 4, 5), (7, 10, 3, 5), (7, 11, 4, 5), (8, 9, 3, 5), (8, 10, 3, 5), (8, 11, 4, 5), (9, 10, 3, 5), (9, 11, 3, 5), (10, 11, 3, 5),
]


def brute_supports(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {(a, b): len(near[a] & near[b]) for a, b in edges}


def brute_trussness(edges):
    left, out, k = set(edges), {}, 2
    while left:
        while weak := [e for e, s in brute_supports(left).items() if s < k - 1]:
            out |= dict.fromkeys(weak, k)
            left -= set(weak)
        k += 1
    return out


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def complete(n, first=0):
    return list(itertools.combinations(range(first, first + n), 2))


@pytest.fixture(scope="module")
def golden(spark):
    return frame(spark, [g[:2] for g in GOLDEN])


def test_golden(spark, golden):
    assert rows(triangles.support(golden), "src", "dst", "support") == [g[:3] for g in GOLDEN]
    expected = [(*g[:2], g[3]) for g in GOLDEN]
    assert rows(truss.trussness(golden), "src", "dst", "trussness") == expected
    assert rows(truss.trussness(golden, local_below=0), "src", "dst", "trussness") == expected
    assert rows(truss.trussness_peel(golden), "src", "dst", "trussness") == expected
    assert rows(truss.trussness_peel(golden, local_below=10), "src", "dst", "trussness") == expected
    assert triangles.triangle_count(golden).first()[0] == 24
    assert rows(truss.layers(golden), "trussness", "edges", "start", "end") == [(3, 3, 0, 3), (4, 14, 3, 17), (5, 10, 17, 27)]
    for k, n in ((2, 27), (3, 27), (4, 24), (5, 10), (6, 0)):
        assert truss.k_truss(golden, k).count() == n
        assert truss.k_truss(golden, k, local_below=0).count() == n


CASES = {
    "empty": [],
    "one edge": [(1, 2)],
    "path": [(1, 2), (2, 3), (3, 4)],
    "star": [(0, i) for i in range(1, 6)],
    "triangle": complete(3),
    "complete": complete(6),
    "two triangles on an edge": [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)],
    "two cliques": complete(4) + complete(5, 10),
    "far ids": [(10**12, 10**12 + 7), (10**12, 5 * 10**12), (10**12 + 7, 5 * 10**12)],
}


@pytest.mark.parametrize("name", CASES)
def test_edge_cases(spark, name):
    edges = CASES[name]
    df = frame(spark, edges)
    expected = sorted((*e, t) for e, t in brute_trussness(edges).items())
    assert rows(truss.trussness(df), "src", "dst", "trussness") == expected
    assert rows(truss.trussness_h_index(df), "src", "dst", "trussness") == expected
    assert rows(truss.k_truss(df, 99), "src", "dst") == []
    assert rows(truss.layers(df, with_empty=True), "trussness") == [(k,) for k in range(3, max([2, *(t for *_, t in expected)]) + 1)]


@settings(max_examples=80, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 11), st.integers(0, 11)).filter(lambda e: e[0] < e[1])))
def test_peel_arrays(edges):
    ids = {e: i for i, e in enumerate(sorted(edges))}
    tri = [(ids[a, b], ids[a, c], ids[b, c]) for (a, b), (_, c) in itertools.product(edges, edges) if _ == a and b < c and (b, c) in ids]
    found, level = truss.peel_arrays(np.array(tri, np.int64).reshape(-1, 3))
    expected = {ids[e]: t for e, t in brute_trussness(edges).items() if t > 2}
    assert dict(zip(found.tolist(), (level + 2).tolist())) == expected


def test_random_graph_by_all_methods(spark):
    rng = random.Random(7)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(260)})
    df = frame(spark, edges)
    expected = sorted((*e, t) for e, t in brute_trussness(edges).items())
    for found in (truss.trussness(df), truss.trussness_h_index(df), truss.trussness_peel(df)):
        assert rows(found, "src", "dst", "trussness") == expected
    assert rows(triangles.support(df), "src", "dst", "support") == sorted((*e, s) for e, s in brute_supports(edges).items())


def test_ranges_and_removal_without_a_single_task(spark):
    """The paths by DataFrame rounds: peeling that stops, ranges, k-truss and supports after a removal, against brute force."""
    rng = random.Random(9)
    edges = sorted({tuple(sorted(rng.sample(range(20), 2))) for _ in range(80)})
    df, truth = frame(spark, edges), brute_trussness(edges)
    want = sorted((*e, t) for e, t in truth.items() if 3 <= t <= 4)
    for below in (0, 10**6):
        assert rows(truss.trussness_between(df, 3, 4, local_below=below), "src", "dst", "trussness") == want
    assert rows(truss.trussness_between(df, high=3, local_below=0), "src", "dst", "trussness") == sorted((*e, t) for e, t in truth.items() if t <= 3)
    supports = brute_supports(edges)
    for limit in (-1, 0, 1, 2):
        left = [e for e in edges if supports[e] > limit]
        assert rows(truss.support_after_removal(df, limit), "src", "dst", "support") == sorted((*e, n) for e, n in brute_supports(left).items())


def test_out_intersection_masks_give_the_triangles(spark, golden):
    masks = triangles.out_intersection_masks(golden)
    assert masks.where("in_src and in_dst").count() == 24 == triangles.triangle_list(golden).count()


def test_cleaning(spark):
    noisy = frame(spark, [(2, 1), (1, 2), (1, 2), (3, 3), (2, 5)])
    assert rows(canonical.canonicalise(noisy), "src", "dst") == [(1, 2), (2, 5)]
    assert rows(canonical.multiplicities(noisy), "src", "dst", "n") == [(1, 2, 3), (2, 5, 1)]
    assert rows(canonical.canonicalise(frame(spark, [(4, 4)])), "src", "dst") == []


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# head\n1 2 0.5\n\n2\t1 7 # trailing\n 3   4  1\n5 5 2\n")
    g = Graph.read(spark, str(tmp_path / "g.txt"), attributes=["w"])
    assert rows(g.edges, "src", "dst", "w") == [(1, 2, 0.5), (3, 4, 1.0)]
    sources.write_edge_text(g.edges.select("src", "dst"), str(tmp_path / "out"))
    assert rows(sources.edges_from_text(spark, str(tmp_path / "out")), "src", "dst") == [(1, 2), (3, 4)]
    sources.write_edges(g.edges, str(tmp_path / "p"))
    assert rows(sources.read_edges(spark, str(tmp_path / "p")), "src", "dst") == [(1, 2), (3, 4)]


def test_text_to_graph(spark, tmp_path):
    """Reversed and repeated rows with attributes of two types; undirected edges ascend, so supports are right."""
    (tmp_path / "g.txt").write_text("2 1 7 x\n1 2 8 y\n3 2 9 z\n3 1 4 u\n3 1 5 v\n4 4 1 w\n")
    kinds = {"n": "int", "name": "string"}
    g = Graph.read(spark, str(tmp_path / "g.txt"), attributes=kinds)
    assert rows(g.edges, "src", "dst", "n", "name") == [(1, 2, 7, "x"), (1, 3, 4, "u"), (2, 3, 9, "z")]
    assert dict(g.edges.dtypes)["n"] == "int" and rows(triangles.support(g.edges), "src", "dst", "support") == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]
    d = Graph.read(spark, str(tmp_path / "g.txt"), directed=True, attributes=kinds)
    assert rows(d.edges, "src", "dst", "n") == [(1, 2, 8), (2, 1, 7), (3, 1, 4), (3, 2, 9)]
    assert rows(Graph.read(spark, str(tmp_path / "g.txt"), directed=True).edges, "src", "dst") == [(1, 2), (2, 1), (3, 1), (3, 2)]
    built = Graph.from_edges(spark.createDataFrame([(2, 1, "b"), (1, 2, "a")], "src long, dst long, w string"))
    assert rows(built.edges, "src", "dst", "w") == [(1, 2, "a")]
    vertices = built.vertices.withColumn("size", F.col("id") * 10)
    assert rows(Graph(built.edges, vertices).vertex_attribute(spark.createDataFrame([(2,)], "id long"), "size"), "id", "size") == [(2, 20)]


def test_measurements(spark, tmp_path):
    (tmp_path / "m.csv").write_text("graph,a,b.c\nRN,0.5,1\nA0,,2\n")
    assert sorted(map(tuple, sources.read_measurements(spark, str(tmp_path / "m.csv")).collect())) == [("A0", None, 2.0), ("RN", 0.5, 1.0)]


def test_command_line(spark, tmp_path, capsys):
    from cohesia.__main__ import main

    (tmp_path / "g.txt").write_text("\n".join(f"{a} {b}" for a, b in complete(4)))
    assert main(["--graph", str(tmp_path / "g.txt"), "--output", str(tmp_path / "o")]) == 0
    assert "k_max 4" in capsys.readouterr().out
    assert rows(spark.read.parquet(str(tmp_path / "o")), "src", "dst", "trussness") == [(*e, 4) for e in complete(4)]
    assert main(["--graph", str(tmp_path / "g.txt"), "--output", str(tmp_path / "k"), "--k", "5"]) == 0
    assert spark.read.parquet(str(tmp_path / "k")).count() == 0


def test_csr_round_trip(spark, tmp_path, golden):
    sources.write_csr(Graph(golden), str(tmp_path / "csr"))
    offsets, columns = sources.read_csr(spark, str(tmp_path / "csr"))
    place = [r.nbr for r in columns.orderBy("place").collect()]
    near = {r.id: [n + 1 for n in place[r.start : r.end]] for r in offsets.collect()}
    assert near[1] == [2, 3, 4, 5] and near[7] == [3, 4, 5, 6, 8, 9, 10, 11] and len(place) == 54


def test_degree_order_and_orientation(spark, golden):
    ranked = canonical.rank_by_degree(golden).orderBy("idx").collect()
    assert [(r.degree, r.id) for r in ranked] == sorted((r.degree, r.id) for r in ranked)
    assert [r.idx for r in ranked] == list(range(11))
    degree = {r.id: r.degree for r in ranked}
    assert all((degree[r.src], r.src) < (degree[r.dst], r.dst) for r in canonical.orient(golden).collect())


def test_access(spark, golden):
    g, some = Graph(golden), spark.createDataFrame([(7,), (8,), (99,)], "id long")
    assert (g.num_vertices(), g.num_edges()) == (11, 27)
    assert rows(g.out_neighbours(some), "id", "nbr") == [(7, 8), (7, 9), (7, 10), (7, 11), (8, 9), (8, 10), (8, 11)]
    assert rows(g.in_neighbours(some), "id", "nbr") == [(7, 3), (7, 4), (7, 5), (7, 6), (8, 6), (8, 7)]
    assert rows(g.induced_subgraph(some).edges, "src", "dst") == [(7, 8)]
    assert g.all_edges(some).count() == 12
    assert {r.id: r.degree for r in g.out_degree().collect()}[11] == 0
    assert {r.id: r.degree for r in g.all_degree().collect()}[7] == 8
    assert {r.id: r.nbrs for r in g.adjacency("out").collect()}[11] == []
    changed = g.set_edge_attribute("w", F.lit(1), F.col("src") == 7)
    assert changed.select_edges("w", lambda c: c.isNull()).count() == 23
    assert rows(changed.edge_attribute(spark.createDataFrame([(7, 8)], "src long, dst long"), "w"), "w") == [(1,)]


def test_two_core(spark):
    assert rows(canonical.two_core(frame(spark, complete(3) + [(2, 9), (9, 8), (20, 21)])), "src", "dst") == complete(3)


def test_ragged(spark, monkeypatch):
    ranges = spark.createDataFrame([(0, 0, 2), (1, 2, 5), (2, 5, 9), (3, 18, 21), (4, 3, 3)], "row long, start long, end long")
    assert [r.value for r in ragged.expand_ranges(ranges).orderBy("row", "value").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 18, 19, 20]
    lists = ranges.select("row", ragged.range_array(F.col("start"), F.col("end")).alias("v"))
    padded = [r[0] for r in lists.orderBy("row").select(ragged.padded(F.col("v"), 4)).collect()]
    assert padded == [[0, 1, -1, -1], [2, 3, 4, -1], [5, 6, 7, 8], [18, 19, 20, -1], [-1] * 4]
    mask = [r[0] for r in lists.orderBy("row").select(ragged.pad_mask(F.col("v"), 3)).collect()]
    assert mask == [[True, True, False]] + [[True] * 3] * 3 + [[False] * 3]
    values = spark.createDataFrame([(k, v) for k, vs in enumerate(([1, 2, 3], [4, 5], [6, 7, 8])) for v in vs], "k long, v long")
    segments = spark.createDataFrame([(0,), (1,), (2,), (3,)], "k long")
    assert rows(ragged.segment_sum(values, segments, "k", "v"), "k", "total") == [(0, 6), (1, 9), (2, 21), (3, 0)]
    sums = prefix_sums(spark.createDataFrame([(i, 2) for i in range(5)], "p long, n long"), "p", "n")
    assert rows(sums, "p", "start", "end") == [(i, 2 * i, 2 * i + 2) for i in range(5)]
    monkeypatch.setattr(access, "SUM_BLOCK", 3)  # blocks of blocks
    sums = prefix_sums(spark.createDataFrame([(i, i % 4) for i in range(40)], "p long, n long"), "p", "n")
    assert rows(sums, "p", "start") == [(i, sum(k % 4 for k in range(i))) for i in range(40)]


def test_balance(spark):
    assert balance.lightest_first([8, 6, 5, 4, 3, 2, 1], 3) == [0, 1, 2, 2, 1, 0, 1]
    assert balance.lightest_first([1.0], 4) == [0] and balance.lightest_first([], 4) == []
    s = spark.createDataFrame([(v,) for v in [0, 0, 0, 1, 1, 2, 3, 8]], "support int")
    assert balance.split_by_edges(s).first()[0] == 2
    assert balance.split_by_nonzero_edges(s).first()[0] == 3
    assert balance.split_by_triangles(s).first()[0] == 9
    assert balance.split_by_cost(s.limit(0)).collect() == []
    assert [tuple(r) for r in balance.split_for_parts(s, 4).collect()] == [(0, 2), (1, 4), (2, 6)]  # where 4, 5 and 6 edges are below, but increasing
    assert [tuple(r) for r in balance.split_for_parts(s.where("support = 0"), 3).collect()] == [(0, 2), (1, 4)]
    assert balance.split_for_parts(s.limit(0), 4).collect() == [] == balance.split_for_parts(s, 1).collect()
    items = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "k string, w long")
    assert rows(balance.lpt_partition(items, "k", "w", 2), "k", "part") == [("a", 0), ("b", 1), ("c", 1)]


def test_membership(spark):
    a, b = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, None)], "g long, v long"), spark.createDataFrame([(1, 6), (2, None)], "g long, v long")
    left, right = sets.mutual_membership(a, b, "g", "v")
    assert rows(left.where("is_in"), "g", "v") == [(1, 6)] and rows(right.where("is_in"), "g", "v") == [(1, 6)]
    assert sets.non_members(a, b.limit(0), ["g"]).count() == 4


def test_community_partition_covers_all_edges(spark, golden):
    placed = balance.community_partition(golden, 3)
    assert rows(placed.select("src", "dst").distinct(), "src", "dst") == [g[:2] for g in GOLDEN]
    apart = frame(spark, [(10 * i + a, 10 * i + b) for i in range(6) for a, b in complete(4)])
    parts = rows(balance.community_partition(apart, 3).groupBy("part").count(), "part", "count")
    assert parts == [(0, 12), (1, 12), (2, 12)]


def test_edge_stream(spark, tmp_path):
    from cohesia.streaming.edges import ingest

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    frame(spark, [(2, 1), (1, 2), (3, 3)]).coalesce(1).write.mode("append").parquet(source)
    ingest(spark, source, "src long, dst long", target, str(tmp_path / "c")).awaitTermination()
    frame(spark, [(1, 2), (5, 4)]).coalesce(1).write.mode("append").parquet(source)
    ingest(spark, source, "src long, dst long", target, str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(target), "src", "dst") == [(1, 2), (4, 5)]
