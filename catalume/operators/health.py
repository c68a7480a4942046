"""Periodic link checks: which resources are due, what changed, what to fetch in full, and a summary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import header_changed

BATCH, STALE_HOURS, FULL_HOURS = 200, 24, 168


def stale(resources: DataFrame, now: datetime, hours: int = STALE_HOURS) -> DataFrame:
    """Active resources never checked, or checked more than ``hours`` ago; of resources with ``url`` and ``url_type``, those that link elsewhere."""
    old = F.col("health_checked_at") < F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    if {"url", "url_type"} <= set(resources.columns):
        resources = resources.where("url IS NOT NULL AND url_type IS NULL")
    return resources.where("state = 'active'").where(F.col("health_checked_at").isNull() | old)


def next_batch(resources: DataFrame, now: datetime, hours: int = STALE_HOURS, size: int = BATCH) -> DataFrame:
    """The resources checked longest ago, those never checked first."""
    return stale(resources, now, hours).orderBy(F.col("health_checked_at").asc_nulls_first(), "id").limit(size)


def history_changes(checks: DataFrame, key: str, time: str, etag: str, modified: str) -> DataFrame:
    """A log of checks with ``changed``: the headers differ from those of the check before."""
    along = Window.partitionBy(key).orderBy(time)
    before = lambda c: F.lag(c).over(along)
    return checks.withColumn("changed", header_changed(before(etag), F.col(etag), before(modified), F.col(modified)))


def full_fetch_due(results: DataFrame, now: datetime, hours: int = FULL_HOURS) -> DataFrame:
    """``results`` with ``due``: changed, or without headers though ok and not fetched within ``hours``."""
    bare = F.col("etag").isNull() & F.col("last_modified").isNull() & (F.col("status") == "ok")
    old = F.col("fetched_at").isNull() | (F.col("fetched_at") < F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return results.withColumn("due", F.coalesce(F.col("changed") | bare & old, F.lit(False)))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isNotNull()).alias("checked"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.count_if("changed").alias("changed"),
        F.count_if("due").alias("enqueued"),
    )
