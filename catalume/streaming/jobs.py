"""The job stream: parsing, per-host rate limits, state of pipelines, retries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("process-resource", "health-check")


def parse_jobs(messages: DataFrame, types: Sequence[str] = TYPES, body: str = "value") -> DataFrame:
    """(job_id, type, data) of JSON messages; malformed ones and unknown types are dropped."""
    parsed = F.from_json(F.col(body).cast("string"), "struct<id:string,type:string,data:string>")
    return messages.withColumn("job", parsed).where(F.col("job.type").isin(*types)).select(F.col("job.id").alias("job_id"), F.col("job.type").alias("type"), F.col("job.data").alias("data"))


def rate_limited(events: DataFrame, key: str, time: str, seconds: float, tie: str) -> DataFrame:
    """``events`` with ``accepted``, each key's rows taken in order of time. For tables at rest.

    A key's rows are folded in batches as they come, sorted, from a partition of many keys, so only the
    last accepted time is held, whatever the size of a key. From one accepted event the next one is found by a
    search among the key's times, so the work grows with the accepted events.
    """
    schema = events.withColumn("accepted", F.lit(True)).schema
    dealt = events.repartition(F.col(key)).sortWithinPartitions(key, time, tie)
    wait = round(seconds * 1_000_000)

    def fold(batches):
        own, last = None, None
        for batch in batches:
            times = batch[time].astype("datetime64[us]").astype("int64").to_numpy()
            keys = batch[key].to_numpy()
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            ok = np.zeros(len(batch), bool)
            for begin, end in zip(new, np.r_[new[1:], len(keys)], strict=True):
                if keys[begin] != own:
                    own, last = keys[begin], None
                at = begin if last is None else begin + int(np.searchsorted(times[begin:end], last + wait, "right"))
                while at < end:
                    ok[at], last = True, int(times[at])
                    at += int(np.searchsorted(times[at:end], last + wait, "right"))
            yield batch.assign(accepted=ok)

    return dealt.mapInPandas(fold, schema)


def latest_state(log: DataFrame, key: str, time: str) -> DataFrame:
    """The last status of each job in an event log."""
    return log.groupBy(key).agg(F.max_by("status", F.struct(time, "status")).alias("status"), F.max(time).alias("updated"))


def pipeline_outcome(steps: DataFrame) -> DataFrame:
    """(resource_id, status) from step rows: a failed fetch fails the run, other failures are only recorded."""
    failed = lambda name: F.max(((F.col("step_name") == name) & (F.col("status") == "error")).cast("int")) == 1
    return steps.groupBy("resource_id").agg(F.when(failed("fetch"), "error").otherwise("complete").alias("status"), F.count_if(F.col("status") == "error").alias("failed_steps"))


def consume(messages: DataFrame, write, checkpoint: str):
    """Run a job stream to its present end: every micro-batch goes to ``write(batch, id)``, which must be idempotent by id."""
    return parse_jobs(messages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def steps_between(log: DataFrame, key: str, time: str) -> DataFrame:
    """Each status change with the one before it."""
    along = Window.partitionBy(key).orderBy(time)
    return log.withColumn("before", F.lag("status").over(along))
