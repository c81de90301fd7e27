"""Flat arrays and the binary files of a graph, against a plain converter; splits for parts against plain loops."""

import random
import struct

import pytest

from cohesia.functions import balance
from cohesia.operators.access import Graph
from cohesia.sources.arrays import read_array, read_binary_csr, write_array, write_binary_csr
from cohesia.sources.edges import edges_from_table


def plain_files(pairs):
    """The two files of undirected edges, ids numbered by value."""
    number = {v: i for i, v in enumerate(sorted({v for p in pairs for v in p}))}
    near = [[] for _ in number]
    for a, b in pairs:
        near[number[a]].append(number[b])
        near[number[b]].append(number[a])
    starts, flat = [0], []
    for ns in near:
        flat += sorted(ns)
        starts.append(len(flat))
    return struct.pack(f"<{len(starts)}q", *starts), struct.pack(f"<{len(flat)}i", *flat), [(i, n) for i, ns in enumerate(near) for n in sorted(ns)]


@pytest.mark.parametrize("read_bytes", [4, 64, 1 << 20])
def test_binary_csr(spark, tmp_path, read_bytes):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(10, 400, 3), 2))) for _ in range(300)} | {(1, 10 + 3 * i) for i in range(60)})[: 40 if read_bytes == 4 else None]
    g = Graph(edges_from_table(spark.createDataFrame(pairs, "src long, dst long")))
    write_binary_csr(*g.csr(symmetric=True, by="id"), f"file://{tmp_path}")
    starts, flat, rows = plain_files(pairs)
    assert (tmp_path / "csr_vlist.bin").read_bytes() == starts and (tmp_path / "csr_elist.bin").read_bytes() == flat
    assert sorted(map(tuple, read_binary_csr(spark, str(tmp_path), read_bytes).collect())) == rows


def test_vertex_over_several_spans(spark, tmp_path, monkeypatch):
    from cohesia.sources import arrays

    monkeypatch.setattr(arrays, "SPAN", 7)
    pairs = [(0, i) for i in range(1, 40)] + [(1, 2), (50, 51)]
    g = Graph(edges_from_table(spark.createDataFrame(pairs, "src long, dst long")))
    write_binary_csr(*g.csr(symmetric=True, by="id"), str(tmp_path))
    assert sorted(map(tuple, read_binary_csr(spark, str(tmp_path)).collect())) == plain_files(pairs)[2]


def test_array_edges(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "place long, value long")
    path = str(tmp_path / "a.bin")
    write_array(frame([]), path)
    assert (tmp_path / "a.bin").read_bytes() == b"" and read_array(spark, path).count() == 0
    write_array(frame([(2, -7), (0, 2**40), (1, 0)]), path)
    assert (tmp_path / "a.bin").read_bytes() == struct.pack("<3q", 2**40, 0, -7)
    for rows, kind in (([(0, 1), (2, 1)], "int64"), ([(0, 1), (0, 1)], "int64"), ([(0, 1), (0, 1), (3, 1), (3, 1)], "int64"), ([(0, 2**31)], "int32"), ([(-1, 1)], "int64"), ([(0, None)], "int64")):
        with pytest.raises(Exception):  # noqa: B017
            write_array(frame(rows), path, kind)
    assert (tmp_path / "a.bin").read_bytes() == struct.pack("<3q", 2**40, 0, -7), "a write that fails leaves the file as it was"


def least(values, need, weigh):
    l = 1
    while sum(weigh(v) for v in values if v < l) < need:
        l += 1
    return l


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_splits_for_parts(spark, seed, parts):
    rng = random.Random(seed)
    values = [int(rng.paretovariate(0.8)) - 1 for _ in range(200)]
    s = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "src long, support int")

    def bumped(found):
        out = []
        for l in found:
            out.append(max(l, 2) if not out else l if l > out[-1] else out[-1] + 2)
        return list(enumerate(out))

    left = [v for v in values if v]
    need, found = len(left) // 3 * 2, []
    for _ in range(parts - 1):
        found.append(least(left, min(need, len(left)), lambda v: 1))
        left = [v for v in left if v >= found[-1]]
        need //= 3
    assert [tuple(r) for r in balance.split_nonzero_for_parts(s, parts).collect()] == bumped(found)
    total = sum(values)
    found = [least(values, min(total // parts * 2**i, total), lambda v: v) for i in range(parts - 1)]
    assert [tuple(r) for r in balance.split_by_triangles_for_parts(s, parts).collect()] == bumped(found)


def test_splits_without_edges(spark):
    none = spark.createDataFrame([], "src long, support int")
    assert balance.split_nonzero_for_parts(none, 4).count() == balance.split_by_triangles_for_parts(none, 4).count() == 0
    zeros = spark.createDataFrame([(0, 0), (1, 0)], "src long, support int")
    assert balance.split_nonzero_for_parts(zeros, 4).count() == 0
