"""Edge-list sources and sinks. An edge table is ``(src, dst, ...)``; ids are 64-bit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def edges_from_text(spark: SparkSession, path: str, attributes: Sequence[str] | Mapping[str, str] = (), comment: str = "#") -> DataFrame:
    """``(src, dst, *attributes, file, line)`` from white-space separated text without a header.

    Attributes are names, then all are doubles, or names with their types. What follows ``comment``, and blank lines, are
    skipped. A token that is no value of its column's type is an error. ``file`` and ``line`` tell which of several
    rows came first: line is where the row's split of the file starts and the row's order inside the split.
    """
    kinds = dict(attributes) if isinstance(attributes, Mapping) else dict.fromkeys(attributes, "double")
    lines = spark.read.text(path).select(
        F.trim(F.regexp_replace(F.substring_index("value", comment, 1), r"\s+", " ")).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("line"),
    )
    cells = F.split("value", " ")
    columns = [cells[0].cast("long").alias("src"), cells[1].cast("long").alias("dst")]
    columns += [cells[i].cast(kind).alias(name) for i, (name, kind) in enumerate(kinds.items(), 2)]
    return lines.where("value <> ''").select(*columns, "file", "line")


def edges_from_table(df: DataFrame, src: str = "src", dst: str = "dst", attributes: Sequence[str] = ()) -> DataFrame:
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), *attributes)


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    edges.write.mode(mode).parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_edge_text(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    edges.select(F.concat_ws(" ", *edges.columns).alias("value")).write.mode(mode).text(path)


def write_csr(graph, path: str, mode: str = "overwrite") -> None:
    """The doubled adjacency as two tables: ``offsets(idx, id, start, end)`` and ``columns(place, idx, nbr)``, ids dense by value."""
    offsets, columns = graph.csr(symmetric=True, by="id")
    offsets.write.mode(mode).parquet(f"{path}/offsets")
    columns.write.mode(mode).parquet(f"{path}/columns")


def read_csr(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/offsets"), spark.read.parquet(f"{path}/columns")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of measurements, with a header; every column but the first is a number of seconds."""
    raw = spark.read.option("header", True).csv(path)
    name, *rest = raw.columns
    return raw.select(F.col(name), *(F.col(f"`{c}`").cast("double").alias(c) for c in rest))


def pairs_within(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Ordered pairs ``(a, b)`` of members of the same group, loops and repeats included: a noisy edge list."""
    left = rows.select(F.col(group).alias("g"), F.col(member).cast("long").alias("a"))
    return left.join(left.withColumnRenamed("a", "b"), "g").select("a", "b")


def part_graph(spark: SparkSession, sf_dir: str, flag: str | None = "R") -> DataFrame:
    """Parts with a line item on the same order, both with return flag ``flag``: canonical ``(src, dst)``.

    Each order's parts are gathered once (an order has a few lines) and paired there, so the pairs cost one shuffle.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if flag is not None:
        lines = lines.where(F.col("l_returnflag") == flag)
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    first = orders.select("parts", F.posexplode("parts").alias("i", "src"))
    return first.select("src", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))).alias("dst")).distinct()
