"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, shared_dir, shared_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, by whatever file system Spark reads it from."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more: all that came of it is written."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return to the system what this Python process has freed: the driver and the workers live on, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Let the driver collect its garbage: the shuffle files and broadcasts of tables that nothing reads any more go, and memory goes back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def settled(df: DataFrame, kind: str) -> DataFrame:
    """``materialise`` and ``settle``: cuts a long query into short ones, each planned by itself, with the driver's memory given back in between."""
    out = materialise(df, kind)
    settle(df.sparkSession)
    return out


def giving_back(each: Callable) -> Callable:
    """``each``, a function over the batches of a task, with ``give_back`` at the end of the task."""

    def run(batches):
        yield from each(batches)
        give_back()

    return run


#: Rows of a batch of whole texts or sets that is sent to Python.
FEW = 512


@contextlib.contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Within it, what is run sends ``FEW`` rows at most to Python at once: both sides hold a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, min(FEW, before) if before > 0 else FEW)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: A sieve has this many words of 64 bits, whatever the data.
CELLS = 1 << 18


def sieved(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with ``__maybe``: true for every row whose hash ``key`` is among the column ``key`` of ``keys``, and for few others.

    The sieve is a table of at most ``CELLS`` x 64 bits with a bit for each key, so it may be sent to all
    tasks; the more keys there are, the more rows pass, and a join behind it decides.
    """

    def cell(k: Column) -> Column:
        return F.pmod(k, F.lit(CELLS))

    def bit(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(k, 32), F.lit(64)).cast("int"))

    marks = keys.groupBy(cell(F.col("key")).alias("__cell")).agg(F.bit_or(bit(F.col("key"))).alias("__mark"))
    held = rows.withColumn("__key", key).withColumn("__cell", cell(F.col("__key")))
    held = held.join(F.broadcast(marks), "__cell", "left")
    return held.withColumn("__maybe", F.coalesce(F.col("__mark").bitwiseAND(bit(F.col("__key"))) != 0, F.lit(False))).drop("__cell", "__mark", "__key")
