"""Ragged data: ranges, segments and padded arrays as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def range_array(start: Column, end: Column) -> Column:
    """start, ..., end - 1; empty where end <= start."""
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


def expand_ranges(rows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per element of each range, as ``value``; empty ranges give none."""
    return rows.select("*", F.explode(range_array(F.col(start), F.col(end))).alias("value"))


def padded(values: Column, width: int, fill: int = -1) -> Column:
    """``values`` cut or filled up to ``width``."""
    cut = F.slice(values, 1, width)
    return F.concat(cut, F.array_repeat(F.lit(fill).cast("long"), F.lit(width) - F.size(cut)))


def pad_mask(values: Column, width: int) -> Column:
    """Which places of :func:`padded` hold values."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i <= F.size(values))


def segment_sum(values: DataFrame, segments: DataFrame, key: str, value: str, name: str = "total") -> DataFrame:
    """``(key, total)`` for every segment, zero for those without values."""
    every = segments.select(key, F.lit(0).cast("long").alias(value))
    return values.select(key, F.col(value).cast("long").alias(value)).unionByName(every).groupBy(key).agg(F.sum(value).alias(name))


def uniform_tile(column: Column, vertices: int, cuts: int) -> Column:
    """The tile, of ``cuts`` of equal width, that a dense number is in."""
    return F.floor(column / (vertices // cuts + 1)).cast("long")


def sqrt_tile(column: Column, vertices: int) -> Column:
    """Two tiles; the first one ends at V / sqrt(2), rounded down, which is in it."""
    edge = int(vertices // 2**0.5)
    return F.when(column <= edge, 0).otherwise(1).cast("long")
