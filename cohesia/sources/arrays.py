"""Flat binary arrays of whole numbers as a Spark data source, and with it the two binary files of a compressed graph.

A file holds nothing but little-endian numbers, the one at place p from byte p * width on. Tasks read and write ranges of
bytes at their own places, so no task sees the whole file, and a task that runs again writes the same bytes. The folder
must be one that the driver and all executors see under one path.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that one task reads, and rows of one batch.
READ_BYTES, _ROWS = 64 << 20, 1 << 16


class FlatArray(DataSource):
    """``(place long, value long)``. Options: ``path``, ``dtype`` (``int32`` or ``int64``), ``read_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "flat_array"

    def schema(self) -> str:
        return "place long, value long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_local(self.options["path"]), _dtype(self.options), int(self.options.get("read_bytes", READ_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if schema.fieldNames() != ["place", "value"]:
            raise ValueError(f"an array is written from place and value, not {schema.fieldNames()}")
        path = _local(self.options["path"])
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        found = _Writer(path, _dtype(self.options))
        found.abort([])  # what a run left that ended before it could
        return found


def _local(path: str) -> str:
    """The path in the file system of a ``file:`` address or of a plain path; other stores have no places to write at."""
    plain = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"{path} is not in a file system")
    return plain


def _dtype(options) -> str:
    kind = options.get("dtype", "int64")
    if kind not in ("int32", "int64"):
        raise ValueError(f"dtype is int32 or int64, not {kind}")
    return "<i4" if kind == "int32" else "<i8"


class _Reader(DataSourceReader):
    def __init__(self, path: str, dtype: str, read_bytes: int):
        self.path, self.dtype, self.read_bytes = path, dtype, read_bytes

    def partitions(self) -> list[InputPartition]:
        width, size = np.dtype(self.dtype).itemsize, os.path.getsize(self.path)
        if size % width:
            raise ValueError(f"{self.path} has {size} bytes, no multiple of {width}")
        each, n = max(1, self.read_bytes // width), size // width
        return [InputPartition((start, min(start + each, n))) for start in range(0, n, each)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        start, end = partition.value
        width = np.dtype(self.dtype).itemsize
        with open(self.path, "rb") as f:
            f.seek(start * width)
            for at in range(start, end, _ROWS):
                n = min(_ROWS, end - at)
                values = np.frombuffer(f.read(n * width), self.dtype).astype(np.int64)
                yield pa.record_batch([pa.array(np.arange(at, at + n)), pa.array(values)], ["place", "value"])


class _Writer(DataSourceArrowWriter):
    """Each task writes one run of consecutive places, and the runs must follow each other; values that don't fit the type are errors, too."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, dtype

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        first, n, width, limit = 0, 0, np.dtype(self.dtype).itemsize, np.iinfo(self.dtype)
        out = os.open(self._unfinished(), os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in batches:
                if batch.column(0).null_count or batch.column(1).null_count:
                    raise ValueError("an array has no nulls")
                places, values = (batch.column(i).to_numpy() for i in (0, 1))
                if len(places) == 0:
                    continue
                if places.min() < 0 or values.min() < limit.min or values.max() > limit.max:
                    raise ValueError(f"a place below 0, or a value that is no {self.dtype}")
                first = int(places[0]) if n == 0 else first
                if (places != np.arange(first + n, first + n + len(places))).any():
                    raise ValueError(f"places from {first} on have a gap or a repeat")
                data, at = memoryview(values.astype(self.dtype).tobytes()), (first + n) * width
                while data:
                    done = os.pwrite(out, data, at)
                    data, at = data[done:], at + done
                n += len(places)
            os.fsync(out)
        finally:
            os.close(out)
        return _Written(first, n)

    def _unfinished(self) -> str:
        return self.path + ".part"

    def commit(self, messages: list) -> None:
        n = 0
        for run in sorted((m for m in messages if m and m.n), key=lambda m: m.first):
            if run.first != n:
                self.abort(messages)
                raise ValueError(f"place {min(n, run.first)} is missing or there twice")
            n += run.n
        if n:
            os.replace(self._unfinished(), self.path)
        else:
            open(self.path, "wb").close()

    def abort(self, messages: list) -> None:
        if os.path.exists(self._unfinished()):
            os.remove(self._unfinished())


class _Written(WriterCommitMessage):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


def _registered(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FlatArray)


def write_array(rows: DataFrame, path: str, dtype: str = "int64") -> None:
    """``rows(place, value)`` as the file ``path``; rows are dealt by ranges of places, so that a task writes long runs."""
    _registered(rows.sparkSession)
    ordered = rows.select(F.col("place").cast("long"), F.col("value").cast("long")).repartitionByRange("place").sortWithinPartitions("place")
    ordered.write.format("flat_array").mode("overwrite").option("path", path).option("dtype", dtype).save()


def read_array(spark: SparkSession, path: str, dtype: str = "int64", read_bytes: int = READ_BYTES) -> DataFrame:
    _registered(spark)
    return spark.read.format("flat_array").option("dtype", dtype).option("read_bytes", read_bytes).load(path)


def write_binary_csr(offsets: DataFrame, columns: DataFrame, folder: str) -> None:
    """``csr_vlist.bin``, where each vertex's neighbours start and after the last one their number, and ``csr_elist.bin``, the neighbours.

    ``offsets(idx, end)`` and ``columns(place, nbr)`` are as :meth:`cohesia.operators.access.Graph.csr` gives them.
    """
    os.makedirs(_local(folder), exist_ok=True)
    first = offsets.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("value"))
    write_array(first.unionByName(offsets.select((F.col("idx") + 1).alias("place"), F.col("end").alias("value"))), f"{folder}/csr_vlist.bin", "int64")
    write_array(columns.select("place", F.col("nbr").alias("value")), f"{folder}/csr_elist.bin", "int32")


def read_binary_csr(spark: SparkSession, folder: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """``(idx, nbr)`` of the two files. A place belongs to the last vertex that starts at it or before it, so the files meet in one join on blocks.

    Vertices' ranges and places are both cut into blocks of ``SPAN`` places. A vertex that no block holds whole is in several.
    """
    ends = read_array(spark, f"{folder}/csr_vlist.bin", "int64", read_bytes)
    after = ends.select((F.col("place") - 1).alias("place"), F.col("value").alias("end"))
    ranges = ends.withColumnRenamed("value", "start").join(after, "place").where("start < end").select(F.col("place").alias("idx"), "start", "end")
    blocks = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("end") - 1) / SPAN))))
    # inside a block a vertex's share is a run of places: it is unrolled, and neighbours come by an equi join on the place
    low, high = F.greatest("start", F.col("block") * SPAN), F.least("end", (F.col("block") + 1) * SPAN)
    places = blocks.select("idx", F.explode(F.sequence(low, high - 1)).alias("place"))
    nbrs = read_array(spark, f"{folder}/csr_elist.bin", "int32", read_bytes)
    return places.join(nbrs, "place").select("idx", F.col("value").alias("nbr"))


#: Places that one row is unrolled to at most.
SPAN = 1 << 14
