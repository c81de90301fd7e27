"""Work that follows what changes: h-index rounds, capped counts, ranges side by side; against brute force on small graphs."""

import random

import pytest

from cohesia.operators import triangles, truss
from tests.test_graph import brute_supports, brute_trussness, complete, frame, rows
from tests.test_parts import groups


def made(seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(rng.choice([25, 90, 160]))})


def as_rows(found):
    return sorted((a, b, n) for (a, b), n in found.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("compact", [0.0, 0.25, 10.0])
def test_h_index_by_what_fell(spark, seed, compact):
    edges = made(seed)
    g = truss.Listed.of(frame(spark, edges))
    found = g.labelled(truss._by_h_index(g, compact), "trussness", 2)
    assert rows(found, "src", "dst", "trussness") == as_rows(brute_trussness(edges))


def test_h_index_rounds_look_at_few_edges(spark):
    # a strip of triangles unravels from its end, an edge or two a round; the complete graph beside it never changes
    strip = [(i, i + d) for i in range(12) for d in (1, 2)]
    edges = sorted(strip + complete(9, 100))
    trace = []
    g = truss.Listed.of(frame(spark, edges))
    found = g.labelled(truss._by_h_index(g, trace=trace), "trussness", 2)
    assert rows(found, "src", "dst", "trussness") == as_rows(brute_trussness(edges))
    assert trace[0][0] > 50 and trace[-1][1] == 0
    assert all(looked <= len(strip) for looked, _ in trace[1:])


@pytest.mark.parametrize("seed", [4, 5, 6])
@pytest.mark.parametrize(("cap", "slices"), [(0, 3), (1, 1), (2, 4), (99, 5)])
def test_capped_counts(spark, seed, cap, slices):
    edges = made(seed)
    found = triangles.support_capped(frame(spark, edges), cap, slices)
    assert rows(found, "src", "dst", "support") == as_rows({e: min(n, cap) for e, n in brute_supports(edges).items()})


def test_capped_counts_leave_full_edges_alone(spark):
    edges, trace = sorted(complete(24) + [(100, 101), (101, 102)]), []
    found = triangles.support_capped(frame(spark, edges), 3, 4, trace).collect()
    assert {r.support for r in found} == {0, 3} and len(found) == len(edges)
    # edges without another neighbour at an end are never counted for; the complete graph's have 22 corners each
    assert trace[0] == 276 and trace[-1] < 0.1 * trace[0]


def test_capped_counts_of_no_edges(spark):
    assert triangles.support_capped(frame(spark, []), 2).collect() == []


@pytest.mark.parametrize("starts", [[], [3], [4, 5, 7], [5, 5, 90], [2, 0, 4]])
@pytest.mark.parametrize("local_below", [0, 10**6])
def test_ranges_side_by_side(spark, starts, local_below):
    edges = groups(3, 8, 8, 7)
    found = truss.trussness_by_ranges(frame(spark, edges), starts, local_below)
    assert rows(found, "src", "dst", "trussness") == as_rows(brute_trussness(edges))


def test_ranges_overlap_in_time(spark):
    times = []
    truss.trussness_by_ranges(frame(spark, groups(3, 8, 8, 8)), [4, 6], 0, times)
    assert len(times) == 3 and max(began for began, _ in times) < min(ended for _, ended in times)


def test_ranges_of_a_graph_without_triangles(spark):
    assert rows(truss.trussness_by_ranges(frame(spark, [(1, 2), (2, 3)]), [4], 0), "src", "dst", "trussness") == [(1, 2, 2), (2, 3, 2)]
