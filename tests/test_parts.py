"""Communities, parts, tiles and peeling by frontiers against brute force on small graphs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohesia.operators import clustering, parts, tiles, triangles, truss
from tests.test_graph import brute_trussness, complete, frame, rows


def groups(n_groups, size, between, seed):
    """Dense groups of vertices and a few edges between them."""
    rng, out = random.Random(seed), set()
    for k in range(n_groups):
        own = range(k * size, (k + 1) * size)
        out |= {(a, b) for a in own for b in own if a < b and rng.random() < 0.8}
    while between:
        a, b = sorted(rng.sample(range(n_groups * size), 2))
        between -= (a, b) not in out
        out.add((a, b))
    return sorted(out)


def brute_modularity(edges, label):
    m, degree = len(edges), Counter(x for e in edges for x in e)
    total = Counter()
    for v, d in degree.items():
        total[label[v]] += d
    return sum(label[a] == label[b] for a, b in edges) / m - sum((t / (2 * m)) ** 2 for t in total.values())


def test_moves_are_gains_in_modularity(spark):
    edges, rng = groups(3, 7, 6, 1), random.Random(2)
    near = clustering.weighted(frame(spark, edges)).cache()
    degree = Counter(x for e in edges for x in e)
    label = {v: rng.randrange(5) for v in degree}
    state = spark.createDataFrame([(v, label[v], d) for v, d in degree.items()], "id long, label long, k long")
    q, m = brute_modularity(edges, label), len(edges)
    assert clustering.modularity(near, state) == pytest.approx(q)
    found = {r.id: r for r in clustering.best_moves(near, state).collect()}
    for v in degree:
        next_to = {label[b if a == v else a] for a, b in edges if v in (a, b)} - {label[v]}
        gains = {c: brute_modularity(edges, label | {v: c}) - q for c in next_to}
        best = max(gains.values(), default=0)
        if best > 1e-12:
            assert found[v].gain / (2 * m * m) == pytest.approx(best)
            assert gains[found[v].to] == pytest.approx(best) and found[v].label == label[v]
        else:
            assert v not in found or found[v].gain < 1e-6


def test_communities_and_balanced_parts(spark):
    edges, trace = groups(5, 9, 10, 3), []
    found = {r.id: r.label for r in clustering.communities(frame(spark, edges), trace=trace).collect()}
    assert all(a < b for level in trace for a, b in zip(level, level[1:]))
    assert trace[-1][-1] == pytest.approx(brute_modularity(edges, found))
    whole = {v: v // 9 for v in found}
    assert brute_modularity(edges, found) >= 0.9 * brute_modularity(edges, whole)
    edges = groups(1, 24, 0, 4) + [(a + 100, b + 100) for a, b in groups(6, 4, 8, 5)]
    for n in (4,):
        got = {r.id: r.part for r in clustering.vertex_parts(frame(spark, edges), n).collect()}
        sizes = Counter(got.values())
        assert set(got) == {x for e in edges for x in e}
        assert max(sizes.values()) <= (1 + clustering.SLACK) * len(got) / n + 1
        halo = clustering.with_halo(frame(spark, edges), spark.createDataFrame(list(got.items()), "id long, part long"))
        assert {tuple(r) for r in halo.collect()} == {(a, b, got[x]) for a, b in edges for x in (a, b)}
    assert clustering.vertex_parts(frame(spark, []), 3).count() == 0


def test_linking_prefers_average_weight(spark):
    label = {v: v // 3 for v in range(12)}
    edges = [(0, 3), (1, 4), (2, 5), (3, 6), (6, 9), (7, 10)]
    labels = spark.createDataFrame(list(label.items()), "id long, label long")
    found = defaultdict(set)
    for r in clustering.linked(frame(spark, edges), labels, 6).collect():
        found[r.label].add(r.id)
    assert sorted(map(sorted, found.values())) == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11]]


def test_linking_goes_on_until_no_two_may_merge(spark):
    # a path whose edges are all alike: with ties to the least vertex one pair merged a round, 60 rounds at most
    path, trace = [(i, i + 1) for i in range(149)], []
    labels = spark.createDataFrame([(v, v) for v in range(150)], "id long, label long")
    of = {r.id: r.label for r in clustering.linked(frame(spark, path), labels, 2, trace).collect()}
    size = Counter(of.values())
    assert len(of) == 150 and max(size.values()) == 2
    assert all(of[a] == of[b] or size[of[a]] + size[of[b]] > 2 for a, b in path)
    assert trace[-1] == 0 and sum(trace) == 150 - len(size) and len(trace) < 15


CASES = {
    "none": [],
    "path": [(1, 2), (2, 3), (3, 4)],
    "complete": complete(7),
    "two": complete(4) + complete(5, 10) + [(1, 10)],
    "shared": [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)],
    "random": sorted({tuple(sorted(random.Random(i).sample(range(22), 2))) for i in range(150)}),
}


@pytest.mark.parametrize("name, kind", [*((name, "hash") for name in CASES), ("random", "one"), ("two", "each")])
def test_trussness_by_parts(spark, name, kind):
    edges = CASES[name]
    part = {v: {"one": 0, "hash": v % 3, "each": v}[kind] for v in {x for e in edges for x in e}}
    given = spark.createDataFrame(list(part.items()), "id long, part long")
    for most in (10**6, 3) if name == "random" and kind != "each" else (10**6,):
        found = parts.trussness_by_parts(frame(spark, edges), given, most)
        assert rows(found, "src", "dst", "trussness") == sorted((a, b, t) for (a, b), t in brute_trussness(edges).items())


def test_no_part_exceeds_its_bound(spark):
    edges = CASES["random"]
    found = triangles.triangle_list(frame(spark, edges))
    given = spark.createDataFrame([(v, 0) for v in range(22)], "id long, part long")
    part = {r.id: r.part for r in parts.bounded_parts(found, given, 5).collect()}
    inner = Counter()
    for a, b, c in found.collect():
        for p, n in Counter((part[a], part[b], part[c])).items():
            inner[p] += n > 1
    assert len(part) == 22 and max(inner.values()) <= 5


@pytest.mark.parametrize("name", CASES)
def test_tiles(spark, name):
    expected = rows(triangles.triangle_list(frame(spark, CASES[name])), "a", "b", "c")
    for buckets in (1, 4):
        assert rows(tiles.triangle_list_tiled(frame(spark, CASES[name]), buckets), "a", "b", "c") == expected
    assert rows(tiles.triangle_list_tiled(frame(spark, CASES[name]), most=20), "a", "b", "c") == expected


def test_tiles_move_fewer_rows_than_wedges(spark, monkeypatch):
    edges = [(a, 1000 + b) for a in range(60) for b in range(0, 400, 7)] + complete(40)
    graph = frame(spark, edges)
    buckets = tiles.buckets_for(len(edges), 1500)
    sent = tiles.tiled(graph, buckets)
    assert sent.count() == buckets * len(edges)
    assert sent.groupBy("tile").count().agg({"count": "max"}).first()[0] < 3 * 1500
    degree = Counter(r.src for r in tiles.tiled(graph, 1).collect())
    assert buckets * len(edges) < sum(d * (d - 1) // 2 for d in degree.values())
    monkeypatch.setattr(tiles, "_STEP", 50)
    oriented = tiles.tiled(graph, 1).toPandas()
    found = tiles.merged(oriented["src"].to_numpy(), oriented["dst"].to_numpy())
    assert sorted(map(tuple, np.sort(found, axis=1).tolist())) == rows(triangles.triangle_list(graph), "a", "b", "c")


@pytest.mark.parametrize("edges", [complete(40), [(0, v) for v in range(1, 900)] + complete(20, 1000)], ids=["complete", "hub"])
def test_a_grid_given_is_made_finer_where_tiles_hold_too_much(spark, edges):
    oriented = tiles.tiled(frame(spark, edges), 1).select("src", "dst").cache()
    buckets = tiles.buckets_that_fit(oriented, len(edges), 2, 200)
    sizes = [r["count"] for r in tiles.tiled(frame(spark, edges), buckets).groupBy("tile").count().collect()]
    assert max(sizes) == tiles.largest_tile(oriented, buckets) <= tiles.TILE_SLACK * 200
    assert tiles.largest_tile(oriented, 2) > tiles.TILE_SLACK * 200 and tiles.buckets_that_fit(oriented, len(edges), 7, 10**6) == 7
    found = tiles.triangle_list_tiled(frame(spark, edges), 2, most=200)
    # a tile is a partition, so none holds more
    assert found.rdd.getNumPartitions() == buckets * (buckets + 1) * (buckets + 2) // 6
    assert rows(found, "a", "b", "c") == rows(triangles.triangle_list(frame(spark, edges)), "a", "b", "c")


def test_a_tiles_triangles_leave_it_in_steps(spark, monkeypatch):
    monkeypatch.setattr(tiles, "_STEP", 500)
    cells = tiles.tiled(frame(spark, complete(40)), 1).toArrow()
    pieces = [len(piece) for piece in tiles._partition(iter(cells.to_batches()))]
    assert sum(pieces) == 40 * 39 * 38 // 6 and max(pieces) <= 500
    assert list(tiles._partition(iter([]))) == []


@pytest.mark.parametrize("name, window", [*((name, 1) for name in CASES), ("random", 3), ("two", 16)])
def test_trussness_by_frontiers(spark, name, window):
    edges = CASES[name]
    found = truss.trussness_frontier(frame(spark, edges), window)
    assert rows(found, "src", "dst", "trussness") == sorted((a, b, t) for (a, b), t in brute_trussness(edges).items())


def test_queries_leave_results_only(spark, tmp_path, monkeypatch):
    import os

    from cohesia import runtime
    from cohesia.plans import catalogue

    for name in ("trussness_frontier", "support_of_text_graph", "csr_offsets", "canonical_edges"):
        folder = tmp_path / name
        folder.mkdir()
        monkeypatch.setattr(runtime, "_local_dir", lambda: str(folder))  # noqa: B023
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count()
        assert all(x.startswith(name) for x in os.listdir(folder)), (name, os.listdir(folder))
