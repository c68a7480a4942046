"""Lookups: documents by id, name or license, pages of an index, and the answers made from them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import UUID
from .ranked import query_terms, tokens

# Known licenses (id, title, url), those of the catalog first, then the standard ones.
LICENSES = (
    ("GJSTU-2.0", "Government of Japan Standard Terms of Use (Version 2.0)", "https://www.kantei.go.jp/jp/singi/it2/densi/kettei/gl2_betten_1.pdf"),
    ("notspecified", "License Not Specified", ""),
    ("PDDL-1.0", "Open Data Commons Public Domain Dedication and Licence 1.0", "https://opendefinition.org/licenses/odc-pddl"),
    ("ODbL-1.0", "Open Data Commons Open Database License 1.0", "https://opendefinition.org/licenses/odc-odbl"),
    ("ODC-BY-1.0", "Open Data Commons Attribution License 1.0", "https://opendefinition.org/licenses/odc-by"),
    ("CC0-1.0", "CC0 1.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0", "https://creativecommons.org/licenses/by/4.0/"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution Share-Alike 4.0", "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("GFDL-1.3-no-cover-texts-no-invariant-sections", "GNU Free Documentation License 1.3 with no cover texts and no invariant sections", "https://opendefinition.org/licenses/gfdl"),
    ("other-open", "Other (Open)", ""),
    ("other-pd", "Other (Public Domain)", ""),
    ("other-at", "Other (Attribution)", ""),
    ("OGL-UK-2.0", "Open Government Licence 2.0 (United Kingdom)", "https://www.nationalarchives.gov.uk/doc/open-government-licence/version/2/"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "https://creativecommons.org/licenses/by-nc/4.0/"),
    ("other-nc", "Other (Non-Commercial)", ""),
    ("other-closed", "Other (Not Open)", ""),
)
#: Licenses of the catalog itself; the others are standard ones.
OWN_LICENSES = 1


def licenses(spark: SparkSession) -> DataFrame:
    """(place, id, title, url, own): the catalog's licenses, then the standard ones."""
    schema = "place int, id string, title string, url string"
    own = spark.createDataFrame([(i, *row) for i, row in enumerate(LICENSES[:OWN_LICENSES])], schema).withColumn("own", F.lit(True))
    standard = spark.createDataFrame([(OWN_LICENSES + i, *row) for i, row in enumerate(LICENSES[OWN_LICENSES:])], schema).withColumn("own", F.lit(False))
    return own.unionByName(standard)


def with_license(df: DataFrame, license: str = "license_id") -> DataFrame:
    """``df`` with ``license_title`` and ``license_url``, whatever the case of its id; an unknown id is its own title."""
    known = licenses(df.sparkSession).select(F.lower("id").alias("__license"), F.col("title").alias("license_title"), F.col("url").alias("license_url"))
    out = df.withColumn("__license", F.lower(license)).join(F.broadcast(known), "__license", "left").drop("__license")
    return out.withColumn("license_title", F.coalesce("license_title", license))


def by_id(df: DataFrame, id: str, key: str = "id") -> DataFrame:
    """One row, or none."""
    return df.where(F.col(key) == id).limit(1)


def by_ids(df: DataFrame, ids: Sequence[str], key: str = "id") -> DataFrame:
    """The rows of some ids, in their order; ids without a row are skipped."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), f"place int, {key} string")
    return df.join(F.broadcast(wanted), key)


def by_name_or_id(df: DataFrame, value: str, state: str | None = "active") -> DataFrame:
    """The row whose id is ``value`` if it looks like a UUID, else whose name is."""
    column = "id" if re.fullmatch(UUID, value) else "name"
    out = df.where(F.col(column) == value)
    return out if state is None else out.where(F.col("state") == state)


def browse_matching(docs: DataFrame, fields: Sequence[str], q: str, key: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of an index (at most 100 rows, with ``total``) of what holds all of the query's terms in one field; the long text is left out."""
    terms = query_terms(q)
    if terms:
        hit = F.lit(False)
        for field in fields:
            hit = hit | (F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), tokens(F.col(field)))) == 0)
        docs = docs.where(hit)
    total = docs.agg(F.count("*").alias("total"))  # one row
    return docs.drop("extracted_text").orderBy(key).offset(offset).limit(min(limit, 100)).join(F.broadcast(total))


def content_page(by_resource: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of the resources with content, by id, after they are counted; at most 100 of them."""
    return by_resource.orderBy("resource_id").offset(offset).limit(min(limit, 100))


def recent(docs: DataFrame, time: str, key: str = "id", top: int = 5) -> DataFrame:
    """The latest documents of an index."""
    return docs.orderBy(F.col(time).desc_nulls_last(), key).limit(top)


def with_job_status(resources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Resources with the status of their job, null without one."""
    own = jobs.select(F.col("resource_id").alias("id"), F.col("status").alias("job_status"))
    return resources.join(own, "id", "left")


def status_envelope(jobs: DataFrame, steps: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, pipeline_status, error, updated, steps by start) of resources ``ids``; one without a job has no status and no steps."""
    fields = ["started_at", "step_name", "status", "error", "completed_at"]
    along = steps.groupBy(F.col("resource_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))
    own = jobs.select(F.col("resource_id").alias("id"), F.col("status").alias("pipeline_status"), "error", "updated")
    out = ids.select("id").join(own, "id", "left").join(along, "id", "left")
    none = F.array().cast(dict(out.dtypes)["steps"])
    return out.withColumn("steps", F.when(F.col("pipeline_status").isNotNull(), F.coalesce("steps", none)).otherwise(none))


def with_admin_role(members: DataFrame, organizations: DataFrame, sysadmin: bool) -> DataFrame:
    """(organization_id, role) of a user: every organization as its admin for a site administrator, else the memberships."""
    if sysadmin:
        return organizations.where("state = 'active'").select(F.col("id").alias("organization_id"), F.lit("admin").alias("role"))
    return members.select("organization_id", "role")


def index_counts(**written: DataFrame) -> DataFrame:
    """(index, n): how many documents a rebuild, a deletion or an enqueueing has touched."""
    parts = [df.agg(F.lit(name).alias("index"), F.count("*").alias("n")) for name, df in written.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
