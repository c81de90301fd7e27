"""Where intermediate tables live and how iterative plans cut their lineage.

Iterations write each round as Parquet into the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor costs a re-read, never a wrong or
missing partition, and the next round's plan starts from a plain scan.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from functools import cache
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

T = TypeVar("T")


@cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="cohesia-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The session's ``spark.checkpoint.dir`` where it is set. Otherwise, in local
    mode, a temporary folder of this process; on a cluster the warehouse, if it
    is in a store that executors share. A warehouse in a local folder is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _local_dir()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if ":" not in warehouse or warehouse.startswith("file:"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is a local one")
    return warehouse + "/_cohesia_work"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    That serves local mode and clusters that share the folder; elsewhere the package goes by ``--py-files``.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def materialize(df: DataFrame, tag: str = "t", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders by the columns ``by``, and read it back."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cohesia_path = path
    return out


def counted(df: DataFrame, write: Callable[[DataFrame], T], rows: Column | None = None) -> tuple[T, int]:
    """What ``write`` returns, and how many rows it wrote, or how many for which ``rows`` holds; there is no second job for the number."""
    seen = Observation()
    out = write(df.observe(seen, F.count(F.when(F.lit(True) if rows is None else rows, 1)).alias("n")))
    return out, seen.get.get("n") or 0


def release(*frames: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_cohesia_path", None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's heap is collected."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


#: The tables of the innermost :func:`settled` call.
_SCOPE: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str = "result") -> DataFrame:
    """The result of ``make``, written; every table that was materialised on the way is deleted then, also where it fails."""
    tables: list[str] = []
    token = _SCOPE.set(tables)
    try:
        df = make()
        _SCOPE.reset(token)
        token = None
        return materialize(df, tag)
    finally:
        if token is not None:
            _SCOPE.reset(token)
        for path in tables:
            _delete(spark, path)


def tidied(spark: SparkSession, make: Callable[[], DataFrame], tag: str = "result") -> DataFrame:
    """As :func:`settled`, but a result that needed no table on its way is returned as the plan it is."""
    tables: list[str] = []
    token = _SCOPE.set(tables)
    try:
        df = make()
        _SCOPE.reset(token)
        token = None
        return materialize(df, tag) if tables else df
    finally:
        if token is not None:
            _SCOPE.reset(token)
        for path in tables:
            _delete(spark, path)


def scoped(path: str) -> str:
    """``path``, which is deleted with the tables of the innermost call of :func:`settled` or :func:`tidied`."""
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


class Grown:
    """A table in the shared folder that rounds append to; a round that is run again after a failure leaves no half of a write."""

    def __init__(self, spark: SparkSession, schema: str, tag: str):
        self.spark, self.path, self.parts = spark, f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.schema = schema
        if (scope := _SCOPE.get()) is not None:
            scope.append(self.path)

    def append(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/part={self.parts}")
        self.parts += 1

    def last(self) -> DataFrame:
        """What was appended last."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={self.parts - 1}")

    def table(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/part={i}" for i in range(self.parts)))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
