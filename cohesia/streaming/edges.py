"""Edge lists that grow: a stream of edge rows kept as a canonical edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cohesia.operators.canonical import drop_loops


def canonical_stream(rows: DataFrame) -> DataFrame:
    """Streaming rows ``(src, dst)`` without loops, as src < dst. Repeats are left to the sink, so no state grows."""
    return drop_loops(rows).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def ingest(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the new canonical edges of Parquet files that arrive in ``source`` to the table at ``target``, then stop.

    Each batch is stored under its number, so a batch that runs again replaces itself; it adds only edges that earlier
    batches lack.
    """

    def store(batch: DataFrame, number: int) -> None:
        new = batch.distinct()
        try:
            old = batch.sparkSession.read.option("basePath", target).parquet(target)
        except Exception as missing:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        else:
            new = new.join(old.where(F.col("batch") < number).select("src", "dst"), ["src", "dst"], "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = canonical_stream(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
