"""Exact catalog search: filters, visibility, totals, pages, matched resources and facets.

Filters become one conjunction over packages plus semi joins on pre-aggregated links, so each of them
shuffles on the package id and none of them multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import contains, escape_like
from ..sources.catalog import Catalog

#: Buckets of a facet, and resources shown for a package.
FACET_TOP, MATCHED_CAP = 200, 100


@dataclass(frozen=True)
class Filters:
    """What a search asks for. Categories are joined by AND; tags, formats and groups ask for all of
    their values, organizations and licenses for any. ``allowed_orgs``: None sees everything, a list sees
    public packages and those of its organizations."""

    q: str = ""
    state: str = "active"
    name_prefix: str = ""
    organizations: Sequence[str] = ()
    tags: Sequence[str] = ()
    formats: Sequence[str] = ()
    licenses: Sequence[str] = ()
    groups: Sequence[str] = ()
    allowed_orgs: Sequence[str] | None = ()
    own_orgs: Sequence[str] | None = None
    private: bool | None = None
    creator: str | None = None


def visible(allowed: Sequence[str] | None) -> Column:
    if allowed is None:
        return F.lit(True)
    return ~F.col("private") | F.col("owner_org").isin(*allowed) if allowed else ~F.col("private")


def having_all(links: DataFrame, key: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """The keys that are linked with all wanted values."""
    wanted = sorted(set(wanted))
    some = links.where(F.col(value).isin(*wanted)).groupBy(key)
    return some.agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(wanted)).select(F.col(key).alias("id"))


def active_formats(catalog: Catalog) -> DataFrame:
    """(package_id, format) of active resources, in upper case, without blanks."""
    return catalog.resource.where("state = 'active' AND format <> ''").select("package_id", F.upper("format").alias("format"))


def matching(catalog: Catalog, f: Filters, packages: DataFrame | None = None) -> DataFrame:
    """The packages that pass all filters. A text is sought in names, titles, notes and active resources.

    Unless ``packages`` are given, notes are searched once each, and go only to packages that pass.
    """
    keyed = bool(f.q) and packages is None
    base = packages if packages is not None else catalog.with_note_key(catalog.package) if keyed else catalog.package
    df = base.where(F.col("state") == f.state).where(visible(f.allowed_orgs))
    if f.name_prefix:
        df = df.where(F.col("name").ilike(escape_like(f.name_prefix) + "%"))
    if f.licenses:
        df = df.where(F.col("license_id").isin(*f.licenses))
    if f.own_orgs is not None:
        df = df.where(F.col("owner_org").isin(*f.own_orgs)) if f.own_orgs else df.limit(0)
    if f.private is not None:
        df = df.where(F.col("private") == f.private)
    if f.creator is not None:
        df = df.where(F.col("creator_user_id") == f.creator)
    if f.q:
        hit = catalog.resource.where("state = 'active'").where(contains(f.q, "name", "description")).select(F.col("package_id").alias("id")).distinct()
        by_resource = hit.withColumn("__hit", F.lit(True))
        own = [c for c in ("name", "title", "notes") if c in df.columns]
        found = contains(f.q, *own) | F.col("__hit").isNotNull()
        if keyed:
            by_note = catalog.note.where(contains(f.q, "notes")).select("at", F.lit(True).alias("__noted"))
            df, found = df.join(by_note, "at", "left"), found | F.col("__noted").isNotNull()
        df = df.join(by_resource, "id", "left").where(found).drop("__hit", "__noted")
    if f.organizations:
        orgs = catalog.organization.where(F.col("name").isin(*f.organizations)).select(F.col("id").alias("owner_org"))
        df = df.join(orgs, "owner_org", "left_semi")
    if f.tags:
        df = df.join(having_all(catalog.package_tag, "package_id", "tag", f.tags), "id", "left_semi")
    if f.formats:
        df = df.join(having_all(active_formats(catalog), "package_id", "format", [x.upper() for x in f.formats]), "id", "left_semi")
    if f.groups:
        named = catalog.package_group.join(catalog.grp.select(F.col("id").alias("group_id"), "name"), "group_id")
        df = df.join(having_all(named, "package_id", "name", f.groups), "id", "left_semi")
    return df.join(catalog.note, "at", "left").drop("at") if keyed else df


SORTS = {"updated": "updated", "created": "created", "name": "name"}


def page(df: DataFrame, sort: str = "updated", descending: bool = True, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page in a total order; nulls come last."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset no less than 0")
    by = F.col(SORTS[sort])
    return df.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), "id").offset(offset).limit(limit)


def with_labels(catalog: Catalog, df: DataFrame) -> DataFrame:
    """Packages with their organization's name and their tags, sorted and joined by commas."""
    orgs = catalog.organization.select(F.col("id").alias("owner_org"), F.col("name").alias("organization"))
    tags = catalog.package_tag.join(df.select(F.col("id").alias("package_id")), "package_id", "left_semi").groupBy(F.col("package_id").alias("id"))
    tags = tags.agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return df.join(orgs, "owner_org", "left").join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def matched_resources(catalog: Catalog, ids: DataFrame, q: str, cap: int = MATCHED_CAP) -> DataFrame:
    """Active resources of the packages ``ids`` whose name or description holds ``q``, at most ``cap`` a package."""
    hits = catalog.resource.where("state = 'active'").where(contains(q, "name", "description"))
    own = hits.join(ids.select(F.col("id").alias("package_id")), "package_id", "left_semi")
    first = Window.partitionBy("package_id").orderBy("id")
    return own.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= cap).select("package_id", "id", "name", "format", "rank")


def facets(catalog: Catalog, df: DataFrame, top: int = FACET_TOP) -> DataFrame:
    """(facet, name, count) of five dimensions over the same packages, the most frequent first, null names dropped.

    All links of all dimensions meet the packages in one join and are counted at once; organizations and
    groups get their names when they are counts already.
    """
    of = lambda rows, facet, package, key: rows.select(F.lit(facet).alias("facet"), F.col(package).alias("package_id"), F.col(key).alias("key"))
    links = of(catalog.package_core, "organization", "id", "owner_org").unionByName(of(catalog.package_core.where("license_id <> ''"), "license", "id", "license_id"))
    links = links.unionByName(of(catalog.package_tag, "tag", "package_id", "tag")).unionByName(of(active_formats(catalog).distinct(), "format", "package_id", "format")).unionByName(of(catalog.package_group, "group", "package_id", "group_id"))
    counted = links.join(df.select(F.col("id").alias("package_id")), "package_id", "left_semi").groupBy("facet", "key").agg(F.count("*").alias("n"))
    named = of(catalog.organization, "organization", "id", "name").unionByName(of(catalog.grp, "group", "id", "name")).select("facet", F.col("package_id").alias("key"), F.col("key").alias("title"))
    name = F.when(F.col("facet").isin("organization", "group"), F.col("title")).otherwise(F.col("key"))
    found = counted.join(named, ["facet", "key"], "left").select("facet", name.alias("name"), "n").where("name IS NOT NULL").groupBy("facet", "name").agg(F.sum("n").alias("count"))
    order = Window.partitionBy("facet").orderBy(F.desc("count"), "name")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


def zero_filled(catalog: Catalog, counted: DataFrame) -> DataFrame:
    """Organizations and groups with their titles and counts; those without a package count 0."""
    known = catalog.organization.where("state = 'active'").select(F.lit("organization").alias("facet"), "name", "title")
    known = known.unionByName(catalog.grp.where("state = 'active'").select(F.lit("group").alias("facet"), "name", "title"))
    return known.join(counted, ["facet", "name"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def resource_count(catalog: Catalog, df: DataFrame) -> DataFrame:
    """How many active resources the packages have."""
    key = df.select(F.col("id").alias("package_id"))
    return catalog.resource.where("state = 'active'").join(key, "package_id", "left_semi").agg(F.count("*").alias("resources"))


def organization_ids(catalog: Catalog, user: str) -> DataFrame:
    """The organizations that a user is a member of."""
    return catalog.membership.where(F.col("user_id") == user).select("organization_id")


def keep_order(ranked: DataFrame, rows: DataFrame, rank: str = "rank") -> DataFrame:
    """``rows`` in the order of search results (id, rank); ids without a row are skipped."""
    return ranked.join(rows, "id").orderBy(rank)


def license_ids(df: DataFrame) -> DataFrame:
    """The distinct licenses of packages, without blanks."""
    return df.where("license_id <> ''").select("license_id").distinct()


def state_shown(state: str, mine: bool, user: str | None) -> str:
    """Deleted packages are only shown to a user who looks at the own organizations'."""
    return state if state == "active" or mine and user is not None else "active"


def toggled(chosen: Column, value: Column) -> Column:
    """A list of filter values with one of them taken out if it is there, or put in."""
    return F.when(F.array_contains(chosen, value), F.array_remove(chosen, value)).otherwise(F.array_append(chosen, value))


def exact_search(catalog: Catalog, f: Filters, sort: str = "updated", descending: bool = True, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of an exact search with the total, organizations, tags, and the resources that hold the text (name, at most ``MATCHED_CAP``)."""
    found = matching(catalog, f)
    total = found.agg(F.count("*").alias("total"))  # one row
    shown = with_labels(catalog, page(found, sort, descending, offset, limit)).join(F.broadcast(total))
    if not f.q:
        return shown.withColumn("matched", F.array().cast("array<string>"))
    hits = matched_resources(catalog, shown.select("id"), f.q).groupBy(F.col("package_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]).alias("matched"))
    return shown.join(hits, "id", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
