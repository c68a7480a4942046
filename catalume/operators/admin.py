"""Operational statistics: jobs, link health, users, index contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import health_rank, status_rank
from ..sources.catalog import Catalog


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def job_list(catalog: Catalog, statuses: str = "") -> DataFrame:
    """Jobs with their resources and packages; ``statuses`` is a list joined by commas."""
    jobs = catalog.pipeline.select("resource_id", "status", "updated", "error")
    if statuses:
        jobs = jobs.where(F.col("status").isin(*[s.strip() for s in statuses.split(",")]))
    resources = catalog.resource.select(F.col("id").alias("resource_id"), F.col("name").alias("resource_name"), "package_id")
    packages = catalog.package_core.select(F.col("id").alias("package_id"), F.col("name").alias("package_name"))
    return jobs.join(resources, "resource_id").join(packages, "package_id")


def job_order(df: DataFrame) -> DataFrame:
    """Running work first, then the latest."""
    return df.orderBy(status_rank(F.col("status")), F.desc("updated"), "resource_id")


def recent_errors(jobs: DataFrame, top: int = 10) -> DataFrame:
    return jobs.where("status = 'error'").orderBy(F.desc("updated"), "resource_id").limit(top).select("resource_id", "error", "updated")


def health_counts(resources: DataFrame) -> DataFrame:
    return resources.where("state = 'active'").groupBy(F.coalesce("health_status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def health_order(df: DataFrame) -> DataFrame:
    """Errors first, then what was never checked, then the latest check; nulls last."""
    return df.orderBy(health_rank(F.col("health_status")), F.col("health_checked_at").desc_nulls_last(), "id")


def user_counts(users: DataFrame) -> DataFrame:
    active = F.col("state") == "active"
    return users.agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(active & (F.col("role") == "sysadmin")).alias("sysadmin"),
        F.count_if(F.col("state") == "deleted").alias("deleted"),
    )


def index_stats(**indices: DataFrame) -> DataFrame:
    """(index, docs, bytes) from each index's ``text`` column."""
    parts = [df.agg(F.lit(name).alias("index"), F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes")) for name, df in indices.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def content_by_resource(chunks: DataFrame) -> DataFrame:
    """(resource_id, chunks, bytes, content_type) of indexed content."""
    grouped = chunks.groupBy("resource_id")
    return grouped.agg(F.count("*").alias("chunks"), F.sum("chunk_size").cast("long").alias("bytes"), F.min_by("content_type", "chunk_index").alias("content_type"))


def chunk_listing(chunks: DataFrame, resource: str, limit: int = 100) -> DataFrame:
    return chunks.where(F.col("resource_id") == resource).orderBy("chunk_index").limit(limit)


def browse(docs: DataFrame, key: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of an index without its long text; at most 100 rows."""
    return docs.drop("extracted_text").orderBy(key).offset(offset).limit(min(limit, 100))
