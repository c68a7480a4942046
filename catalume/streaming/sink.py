"""A sink of micro-batches that a job may write twice without doubling anything.

Each batch goes to a folder of its own id, which a repeated write replaces, and its id is recorded after that. Reading
takes recorded batches alone: what a run left between the write and the record is not seen until it is written again.
Of the rows of one key the one of the latest batch counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_writer(path: str, between: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``. ``between`` is called after the write and before the record."""

    def write(batch: DataFrame, id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={id}")
        if between:
            between(id)
        batch.sparkSession.range(id, id + 1).select(F.col("id").alias("batch")).write.mode("overwrite").parquet(f"{path}/done/part={id}")

    return write


def start(stream: DataFrame, path: str, checkpoint: str, between: Callable[[int], None] | None = None) -> StreamingQuery:
    """Write a stream to its present end."""
    return stream.writeStream.foreachBatch(batch_writer(path, between)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of recorded batches, with ``batch``."""
    done = spark.read.parquet(f"{path}/done").select("batch").distinct()
    return spark.read.parquet(f"{path}/data").join(F.broadcast(done), "batch")  # a row a batch


def latest(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The last row of each key: of the latest batch, then by ``order``."""
    found = rows(spark, path)
    kept = [c for c in found.columns if c not in keys]
    last = F.max_by(F.struct(*kept), F.struct("batch", *order)).alias("__row")
    return found.groupBy(*keys).agg(last).select(*keys, "__row.*")
