"""Catalog listings and details: packages with aggregates, organizations, groups, tags, members, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains, role_rank
from ..sources.catalog import Catalog


def package_list(catalog: Catalog, df: DataFrame) -> DataFrame:
    """Packages with their formats (distinct, upper case), number of active resources, tags and groups, by pre-aggregation."""
    active = catalog.resource.where("state = 'active'").groupBy(F.col("package_id").alias("id"))
    formats = F.array_join(F.array_sort(F.collect_set(F.when(F.col("format") != "", F.upper("format")))), ",")
    resources = active.agg(formats.alias("formats"), F.count("*").alias("resource_count"))
    tags = catalog.package_tag.groupBy(F.col("package_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    named = catalog.package_group.join(catalog.grp.select(F.col("id").alias("group_id"), F.concat_ws(":", "name", F.coalesce("title", "name")).alias("g")), "group_id")
    groups = named.groupBy(F.col("package_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("g")), ",").alias("groups"))
    out = df.join(resources, "id", "left").join(tags, "id", "left").join(groups, "id", "left")
    return out.withColumn("resource_count", F.coalesce("resource_count", F.lit(0).cast("long"))).na.fill("", ["formats", "tags", "groups"])


def package_detail(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """Packages with nested resources (by position), tags, groups and organization."""
    key = ids.select(F.col("id").alias("package_id"))
    resources = catalog.resource_positions.where("state = 'active'").join(key, "package_id", "left_semi").groupBy(F.col("package_id").alias("id"))
    resources = resources.agg(F.array_sort(F.collect_list(F.struct("position", F.col("id").alias("resource_id"), "name", "format"))).alias("resources"))
    tags = catalog.package_tag.join(key, "package_id", "left_semi").groupBy(F.col("package_id").alias("id")).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    groups = catalog.package_group.join(key, "package_id", "left_semi").join(catalog.grp.select(F.col("id").alias("group_id"), "name"), "group_id")
    groups = groups.groupBy(F.col("package_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("groups"))
    orgs = catalog.organization.select(F.col("id").alias("owner_org"), F.struct("id", "name", "title").alias("organization"))
    out = ids.join(resources, "id", "left").join(tags, "id", "left").join(groups, "id", "left").join(orgs, "owner_org", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"tags": F.coalesce("tags", none), "groups": F.coalesce("groups", none), "resources": F.coalesce("resources", F.array().cast(dict(out.dtypes)["resources"]))})


def accessible(catalog: Catalog, df: DataFrame, user: str | None, sysadmin: bool = False) -> DataFrame:
    """Packages that may be shown: public and active ones, or those of the user's organizations, or all."""
    if sysadmin:
        return df
    open_ = ~F.col("private") & (F.col("state") == "active")
    if user is None:
        return df.where(open_)
    orgs = catalog.membership.where(F.col("user_id") == user).select(F.col("organization_id").alias("owner_org"), F.lit(True).alias("__member"))
    return df.join(orgs, "owner_org", "left").where(open_ | F.col("__member").isNotNull()).drop("__member")


def organization_list(catalog: Catalog, q: str = "") -> DataFrame:
    """Active organizations with the number of their active packages."""
    counts = catalog.package_core.where("state = 'active'").groupBy(F.col("owner_org").alias("id")).agg(F.count("*").alias("datasets"))
    orgs = catalog.organization.where("state = 'active'").where(contains(q, "name", "title"))
    return orgs.join(counts, "id", "left").withColumn("datasets", F.coalesce("datasets", F.lit(0).cast("long")))


def group_list(catalog: Catalog, q: str = "") -> DataFrame:
    """Active groups with the number of their packages in any state."""
    counts = catalog.package_group.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("datasets"))
    groups = catalog.grp.where("state = 'active'").where(contains(q, "name", "title"))
    return groups.join(counts, "id", "left").withColumn("datasets", F.coalesce("datasets", F.lit(0).cast("long")))


def tag_list(catalog: Catalog, q: str = "") -> DataFrame:
    """All tags with the number of their packages, also those that no package has."""
    known = catalog.tag.where(contains(q, "tag"))
    return known.join(catalog.package_tag, "tag", "left").groupBy("tag").agg(F.count_distinct("package_id").alias("datasets"))


def with_total(df: DataFrame, to: str = "total") -> DataFrame:
    """Every row with the number of all rows: one count beside the rows, not one window over them."""
    return df.join(df.agg(F.count("*").alias(to)), how="inner")


def members(catalog: Catalog) -> DataFrame:
    """Members of active organizations with their users' names and whether they administer the whole site."""
    users = catalog.user.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), (F.col("role") == "sysadmin").alias("is_sysadmin"))
    orgs = catalog.organization.where("state = 'active'").select(F.col("id").alias("organization_id"), F.col("name").alias("organization"))
    return catalog.membership.join(users, "user_id").join(orgs, "organization_id")


def with_role(catalog: Catalog, required: str) -> DataFrame:
    """Memberships whose role ranks no less than the one required."""
    return catalog.membership.where(role_rank(F.col("role")) >= role_rank(F.lit(required)))


def user_autocomplete(catalog: Catalog, q: str, limit: int = 20) -> DataFrame:
    return catalog.user.where("state = 'active'").where(contains(q, "name", "email")).orderBy("name").limit(limit).select("id", "name", "email")


def formats_in_use(catalog: Catalog) -> DataFrame:
    """Distinct formats of active resources as they are written."""
    return catalog.resource.where("state = 'active' AND format <> ''").select("format").distinct()


def next_position(catalog: Catalog) -> DataFrame:
    """The position that a new resource of each package takes, over resources in any state."""
    top = catalog.resource_positions.groupBy(F.col("package_id").alias("id")).agg(F.max("position").alias("top"))
    return catalog.package_core.select("id").join(top, "id", "left").select("id", (F.coalesce("top", F.lit(-1)) + 1).cast("int").alias("next_position"))


def package_documents(catalog: Catalog) -> DataFrame:
    """Search documents of active packages: denormalised organization, groups, tags and formats."""
    return package_list(catalog, catalog.package_notes.where("state = 'active'")).join(
        catalog.organization.select(F.col("id").alias("owner_org"), F.col("name").alias("organization")), "owner_org", "left"
    )


def resource_documents(catalog: Catalog) -> DataFrame:
    return catalog.resource.where("state = 'active'").select("id", "package_id", "name", "description", F.upper("format").alias("format"))


def compat(df: DataFrame) -> DataFrame:
    """Packages under the names of the older interface."""
    renamed = df.withColumnsRenamed({"created": "metadata_created", "updated": "metadata_modified", "owner_org": "owner_organization"})
    return renamed.withColumn("license_title", F.initcap("license_id"))
