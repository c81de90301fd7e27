"""Membership and set operations over keys of one or more columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def members(values: DataFrame, of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``values`` whose key is in ``of``; an empty ``of`` gives no rows."""
    return values.join(of.select(*keys), list(keys), "left_semi").select(*values.columns)


def non_members(values: DataFrame, of: DataFrame, keys: Sequence[str]) -> DataFrame:
    return values.join(of.select(*keys), list(keys), "left_anti").select(*values.columns)


def membership(values: DataFrame, of: DataFrame, keys: Sequence[str], name: str = "is_in") -> DataFrame:
    """``values`` with a flag that tells whether the key is in ``of``."""
    marked = of.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return values.join(marked, list(keys), "left").select(*values.columns, F.coalesce("_hit", F.lit(False)).alias(name))


def mutual_membership(left: DataFrame, right: DataFrame, group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of two ragged tables with a flag: is the value in the other side's group? Null values are in none."""
    keys = [group, value]
    return membership(left, right.where(F.col(value).isNotNull()), keys), membership(right, left.where(F.col(value).isNotNull()), keys)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()
