"""Search, listing and statistics queries over the catalog, each with its oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import admin, health, listing, mutations, ranked, search
from ..sources.catalog import Catalog
from .views import query

NOW = datetime(1999, 1, 1)
FLAGSHIP = search.Filters(q="urgent", tags=("Brand#1", "Brand#2"), formats=("csv",), allowed_orgs=("3", "5"))

#: The flagship's packages, once more in SQL.
FLAGSHIP_SQL = """
    flagship AS (SELECT p.* FROM package_notes p WHERE p.state = 'active' AND (NOT p.private OR p.owner_org IN ('3', '5'))
        AND (p.name ILIKE '%urgent%' OR p.title ILIKE '%urgent%' OR p.notes ILIKE '%urgent%'
            OR EXISTS (SELECT 1 FROM resource r WHERE r.package_id = p.id AND r.state = 'active' AND (r.name ILIKE '%urgent%' OR r.description ILIKE '%urgent%')))
        AND (SELECT count(DISTINCT tag) FROM package_tag t WHERE t.package_id = p.id AND tag IN ('Brand#1', 'Brand#2')) = 2
        AND EXISTS (SELECT 1 FROM active_formats f WHERE f.package_id = p.id AND f.format = 'CSV'))
"""
PAGE_COLUMNS = ["id", "name", "title", "license_id", "owner_org", "private", "state", "created", "updated"]
PAGE = ", ".join(f"p.{c}" for c in PAGE_COLUMNS)


def flagship(c: Catalog):
    return search.matching(c, FLAGSHIP)


def search_exact_page(c: Catalog):
    return search.with_labels(c, search.page(flagship(c).select(*PAGE_COLUMNS, "creator_user_id"), limit=50)).select(*PAGE_COLUMNS, "organization", "tags")


def merged_ranking(c: Catalog):
    found = ranked.ranked_search(c, "machinery", search.Filters(allowed_orgs=None))
    return found.select("id", F.round("score", 4).alias("score"), "source")


def bm25_sql(table: str, fields: dict[str, float], terms: list[str], key: str) -> str:
    """BM25 by SQL: (key, score) of the rows that hold all terms, rounded."""
    words = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
    lists = ", ".join(f"{words.format(f)} AS w_{f}" for f in fields)
    tf = lambda f, t: f"len(list_filter(w_{f}, lambda x: x = '{t}'))"
    stats = ["count(*) AS n", *[f"avg(len(w_{f})) AS l_{f}" for f in fields]]
    stats += [f"greatest({', '.join(f'count(*) FILTER (WHERE {tf(f, t)} > 0)' for f in fields)}) AS d_{i}" for i, t in enumerate(terms)]
    parts = []
    for i, t in enumerate(terms):
        idf = f"ln(1 + (n - d_{i} + 0.5) / (d_{i} + 0.5))"
        parts.append("greatest(" + ", ".join(f"{b} * {idf} * {tf(f, t)} / ({tf(f, t)} + 1.2 * (0.25 + 0.75 * len(w_{f}) / l_{f}))" for f, b in fields.items()) + ")")
    return f"""(WITH cut AS (SELECT *, {lists} FROM {table}), stats AS (SELECT {', '.join(stats)} FROM cut)
        SELECT {key}, {' + '.join(parts)} AS score FROM cut, stats WHERE {' AND '.join(p + ' > 0' for p in parts)})"""


SPARK = {
    # filters, one by one and together
    "search_exact_page": search_exact_page,
    "search_exact_total": lambda c: flagship(c).agg(F.count("*").alias("total")),
    "search_text": lambda c: search.matching(c, search.Filters(q="MACHINERY")).select(*PAGE_COLUMNS),
    "search_text_escaped": lambda c: search.matching(c, search.Filters(q="%%", allowed_orgs=None)).select("id"),
    "search_notes": lambda c: search.matching(c, search.Filters(q="the by", allowed_orgs=None), c.package_notes).select("id"),
    "search_name_prefix": lambda c: search.matching(c, search.Filters(name_prefix="CUSTOMER-00000001")).select("id", "name"),
    "search_organizations_any": lambda c: search.matching(c, search.Filters(organizations=("nation_3", "nation_24"))).select("id", "owner_org"),
    "search_tags_all": lambda c: search.matching(c, search.Filters(tags=("Brand#3", "Brand#4", "Brand#5"))).select("id"),
    "search_formats_all": lambda c: search.matching(c, search.Filters(formats=("CSV", "json"))).select("id"),
    "search_licenses_any": lambda c: search.matching(c, search.Filters(licenses=("BUILDING", "MACHINERY"))).select("id", "license_id"),
    "search_groups_all": lambda c: search.matching(c, search.Filters(groups=("asia", "europe"))).select("id"),
    "search_visibility_anonymous": lambda c: search.matching(c, search.Filters()).select("id", "private"),
    "search_visibility_member": lambda c: search.matching(c, search.Filters(allowed_orgs=("1", "2", "3"))).select("id", "private"),
    "search_own_organizations": lambda c: search.matching(c, search.Filters(allowed_orgs=None, own_orgs=("4", "7"), private=True)).select("id"),
    "search_own_organizations_none": lambda c: search.matching(c, search.Filters(own_orgs=())).select("id"),
    "search_creator_deleted": lambda c: search.matching(c, search.Filters(state="deleted", creator="1", allowed_orgs=None)).select("id"),
    "search_facets": lambda c: search.facets(c, flagship(c)),
    "search_facets_top": lambda c: search.facets(c, flagship(c), top=3),
    "search_facets_zero_filled": lambda c: search.zero_filled(c, search.facets(c, flagship(c))),
    "search_matched_resources": lambda c: search.matched_resources(c, flagship(c), "urgent").select("package_id", "id", "name", "format", "rank"),
    "search_resource_count": lambda c: search.resource_count(c, flagship(c)),
    "search_page_by_name": lambda c: search.page(c.package.where("state = 'active'"), "name", False, 40, 20).select("id", "name"),
    "search_page_by_created": lambda c: search.page(c.package, "created", True, 0, 100).select("id", "created"),
    "search_keep_order": lambda c: search.keep_order(search.page(flagship(c)).select("id", "updated").withColumn("rank", F.datediff(F.lit("2010-01-01"), "updated")).drop("updated"), c.package_core).select("id", "rank", "name"),
    # ranked search
    "ranked_packages": lambda c: ranked.bm25(c.package_notes, "building the", {"title": 3.0, "notes": 1.0}).select("id", F.round("score", 4).alias("score")),
    "ranked_resources": lambda c: ranked.bm25(c.resource.where("state = 'active'"), "high", {"name": 3.0, "description": 2.0}).select("id", F.round("score", 4).alias("score")),
    "ranked_content": lambda c: ranked.bm25(c.content, "the und", {"extracted_text": 1.0}).select("resource_id", F.round("score", 4).alias("score")),
    "ranked_search": merged_ranking,
    "ranked_highlight": lambda c: c.package_core.select("id", ranked.highlight(F.col("title"), "machinery customer").alias("title")),
    "ranked_content_match": lambda c: ranked.content_leg(c.content, "the and", None).select("resource_id"),
    # listings
    "list_packages": lambda c: listing.package_list(c, c.package_core.where("state = 'active'").select("id", "name")),
    "list_package_documents": lambda c: listing.package_documents(c).select("id", "organization", "formats", "tags", "groups", F.length("notes").cast("long").alias("n_notes")),
    "list_resource_documents": lambda c: listing.resource_documents(c),
    "list_organizations": lambda c: listing.organization_list(c).select("id", "name", "datasets"),
    "list_organizations_matching": lambda c: listing.with_total(listing.organization_list(c, "_1").select("id", "datasets")),
    "list_groups": lambda c: listing.group_list(c).select("id", "name", "datasets"),
    "list_tags": lambda c: listing.with_total(listing.tag_list(c, "brand#1")),
    "list_members": lambda c: listing.members(c).select("user_id", "organization", "role", "user_name", "is_sysadmin"),
    "list_roles_at_least_editor": lambda c: listing.with_role(c, "editor"),
    "list_users_autocomplete": lambda c: listing.user_autocomplete(c, "USER-"),
    "list_formats": listing.formats_in_use,
    "list_accessible": lambda c: listing.accessible(c, c.package_core, "3").select("id"),
    "list_next_position": listing.next_position,
    "list_positions": lambda c: c.resource_positions.select("id", F.col("position").cast("long").alias("position")),
    "detail_packages": lambda c: listing.package_detail(c, c.package_core).select("id", F.array_join("tags", ",").alias("tags"), F.array_join("groups", ",").alias("groups"), F.array_join(F.transform("resources", lambda r: r["resource_id"]), ",").alias("resources"), F.col("organization.name").alias("organization")),
    "list_compat": lambda c: listing.compat(c.package).select("id", "metadata_created", "metadata_modified", "owner_organization", "license_title"),
    # statistics
    "stats_jobs": lambda c: admin.job_counts(c.pipeline),
    "stats_job_list": lambda c: admin.job_list(c, "error,queued").select("resource_id", "status", "resource_name", "package_name"),
    "stats_job_order": lambda c: admin.job_order(admin.job_list(c)).limit(50).select("resource_id", "status"),
    "stats_recent_errors": lambda c: admin.recent_errors(c.pipeline).select("resource_id", "updated"),
    "stats_health": lambda c: admin.health_counts(c.resource),
    "stats_health_order": lambda c: admin.health_order(c.resource.where("state = 'active'")).limit(50).select("id", "health_status"),
    "stats_users": lambda c: admin.user_counts(c.user),
    "stats_index": lambda c: admin.index_stats(packages=c.package_notes.select(F.col("notes").alias("text")), content=c.content.select(F.col("extracted_text").alias("text"))),
    "stats_content_by_resource": lambda c: admin.content_by_resource(c.content),
    "stats_browse": lambda c: admin.browse(c.content.withColumn("key", F.col("resource_id").cast("long")), "key", 20, 500).drop("key"),
    # link checks
    "health_stale_batch": lambda c: health.next_batch(c.resource, NOW).select("id", "health_checked_at"),
    "health_stale": lambda c: health.stale(c.resource, NOW).select("id"),
    "health_changes": lambda c: health.history_changes(c.raw("events").withColumn("modified", F.lit(None).cast("string")), "user_id", "ts", "props", "modified").select("event_id", "changed"),
    "health_summary": lambda c: health.summary(health.full_fetch_due(c.resource.select(F.col("health_status").alias("status"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col("health_checked_at").alias("fetched_at"), (F.col("size") > 400_000).alias("changed")), NOW)),
    # changes
    "change_upsert": lambda c: mutations.upsert(c.package_core.select("id", "title"), c.organization.select("id", "title"), ["id"]),
    "change_delete": lambda c: mutations.delete(c.package_core.select("id"), c.resource.where("state = 'deleted'").select(F.col("package_id").alias("id")), ["id"]),
    "change_patch": lambda c: mutations.patch(c.package_core.select("id", "title", "license_id"), c.organization.select("id", F.when(F.col("id").cast("int") % 2 == 0, F.col("title")).alias("title")), "id"),
    "change_soft_delete": lambda c: mutations.set_state(c.package_core, F.col("private"), "deleted").select("id", "state"),
    "change_purge_resources": lambda c: mutations.purge({"package": c.package_core, "resource": c.resource, "package_tag": c.package_tag, "package_group": c.package_group, "pipeline": c.pipeline}, c.package_core.where("state = 'deleted'"))["resource"].select("id"),
    "change_purge_jobs": lambda c: mutations.purge({"package": c.package_core, "resource": c.resource, "package_tag": c.package_tag, "package_group": c.package_group, "pipeline": c.pipeline}, c.package_core.where("state = 'deleted'"))["pipeline"].select("resource_id"),
    "change_purge_guard": lambda c: mutations.linked(c.organization, c.package_core.where("private"), "owner_org").select("id"),
    "change_replace_links": lambda c: mutations.replace_links(c.package_tag, c.package_core.where("private").select(F.col("id").alias("package_id"), F.lit("hidden").alias("tag")), "package_id"),
    "change_create_checked": lambda c: mutations.create_packages(c.package_core, c.package_core.select(F.concat(F.when(F.col("private"), "New ").otherwise(""), "name").alias("name"), "owner_org").unionByName(c.organization.select(F.concat(F.lit("from-"), F.replace("name", F.lit("_"), F.lit("-"))).alias("name"), F.col("id").alias("owner_org"))), c.organization).select("name", "rejected"),
}

SQL = {
    "search_exact_page": query(f"""SELECT {PAGE}, o.name AS organization, (SELECT string_agg(tag, ',' ORDER BY tag) FROM package_tag t WHERE t.package_id = p.id) AS tags
        FROM (SELECT * FROM flagship ORDER BY updated DESC NULLS LAST, id LIMIT 50) p LEFT JOIN organization o ON o.id = p.owner_org""", FLAGSHIP_SQL),
    "search_exact_total": query("SELECT count(*) AS total FROM flagship", FLAGSHIP_SQL),
    "search_text": query(f"""SELECT {PAGE} FROM package_notes p WHERE state = 'active' AND NOT private AND (name ILIKE '%machinery%' OR title ILIKE '%machinery%' OR notes ILIKE '%machinery%'
        OR id IN (SELECT package_id FROM resource WHERE state = 'active' AND (name ILIKE '%machinery%' OR description ILIKE '%machinery%')))"""),
    "search_text_escaped": query(r"""SELECT id FROM package_notes WHERE state = 'active' AND (contains(name, '%%') OR contains(title, '%%') OR contains(notes, '%%')
        OR id IN (SELECT package_id FROM resource WHERE state = 'active' AND (contains(name, '%%') OR contains(description, '%%'))))"""),
    "search_notes": query("SELECT id FROM package_notes WHERE state = 'active' AND (name ILIKE '%the by%' OR title ILIKE '%the by%' OR notes ILIKE '%the by%')"),
    "search_name_prefix": query("SELECT id, name FROM package WHERE state = 'active' AND NOT private AND name ILIKE 'customer-00000001%'"),
    "search_organizations_any": query("SELECT id, owner_org FROM package WHERE state = 'active' AND NOT private AND owner_org IN ('3', '24')"),
    "search_tags_all": query("""SELECT id FROM package p WHERE state = 'active' AND NOT private AND EXISTS (SELECT 1 FROM package_tag t WHERE t.package_id = p.id
        AND tag IN ('Brand#3', 'Brand#4', 'Brand#5') HAVING count(DISTINCT tag) = 3)"""),
    "search_formats_all": query("""SELECT id FROM package WHERE state = 'active' AND NOT private
        AND id IN (SELECT package_id FROM active_formats WHERE format = 'CSV') AND id IN (SELECT package_id FROM active_formats WHERE format = 'JSON')"""),
    "search_licenses_any": query("SELECT id, license_id FROM package WHERE state = 'active' AND NOT private AND license_id IN ('BUILDING', 'MACHINERY')"),
    "search_groups_all": query("""SELECT id FROM package WHERE state = 'active' AND NOT private
        AND id IN (SELECT package_id FROM package_group JOIN grp ON group_id = grp.id WHERE grp.name = 'asia')
        AND id IN (SELECT package_id FROM package_group JOIN grp ON group_id = grp.id WHERE grp.name = 'europe')"""),
    "search_visibility_anonymous": query("SELECT id, private FROM package WHERE state = 'active' AND NOT private"),
    "search_visibility_member": query("SELECT id, private FROM package WHERE state = 'active' AND (NOT private OR owner_org IN ('1', '2', '3'))"),
    "search_own_organizations": query("SELECT id FROM package WHERE state = 'active' AND owner_org IN ('4', '7') AND private"),
    "search_own_organizations_none": query("SELECT id FROM package WHERE false"),
    "search_creator_deleted": query("SELECT id FROM package WHERE state = 'deleted' AND creator_user_id = '1'"),
    "search_matched_resources": query("""SELECT package_id, id, name, format, CAST(rank AS INTEGER) AS rank FROM (SELECT r.*, row_number() OVER (PARTITION BY package_id ORDER BY id) AS rank FROM resource r
        WHERE state = 'active' AND (name ILIKE '%urgent%' OR description ILIKE '%urgent%') AND package_id IN (SELECT id FROM flagship)) WHERE rank <= 100""", FLAGSHIP_SQL),
    "search_resource_count": query("SELECT count(*) AS resources FROM resource WHERE state = 'active' AND package_id IN (SELECT id FROM flagship)", FLAGSHIP_SQL),
    "search_page_by_name": query("SELECT id, name FROM package WHERE state = 'active' ORDER BY name, id LIMIT 20 OFFSET 40"),
    "search_page_by_created": query("SELECT id, created FROM package ORDER BY created DESC NULLS LAST, id LIMIT 100"),
    "search_keep_order": query("""SELECT p.id, CAST(date_diff('day', CAST(updated AS DATE), DATE '2010-01-01') AS INTEGER) AS rank, name FROM
        (SELECT * FROM flagship ORDER BY updated DESC NULLS LAST, id LIMIT 20) p""", FLAGSHIP_SQL),
    "ranked_packages": query(f"SELECT id, round(score, 4) AS score FROM {bm25_sql('package_notes', {'title': 3.0, 'notes': 1.0}, ['building', 'the'], 'id')}"),
    "ranked_resources": query(f"SELECT id, round(score, 4) AS score FROM {bm25_sql('live', {'name': 3.0, 'description': 2.0}, ['high'], 'id')}", "live AS (SELECT * FROM resource WHERE state = 'active')"),
    "ranked_content": query(f"SELECT resource_id, round(score, 4) AS score FROM {bm25_sql('content', {'extracted_text': 1.0}, ['the', 'und'], 'resource_id')}"),
    "ranked_search": query(f"""SELECT id, round(score, 4) AS score, 'package' AS source FROM {bm25_sql('live', {'title': 3.0, 'notes': 1.0}, ['machinery'], 'id')}""", "live AS (SELECT * FROM package_notes WHERE state = 'active')"),
    "ranked_highlight": query("SELECT id, regexp_replace(title, '\\b(machinery|customer)\\b', '<mark>\\1</mark>', 'gi') AS title FROM package_core"),
    "ranked_content_match": query("SELECT resource_id FROM content WHERE list_has_all(regexp_extract_all(lower(extracted_text), '[\\p{L}\\p{N}]+'), ['the', 'and'])"),
    "list_packages": query("""SELECT p.id, p.name,
        coalesce((SELECT string_agg(DISTINCT upper(format), ',' ORDER BY upper(format)) FROM resource r WHERE r.package_id = p.id AND state = 'active' AND format <> ''), '') AS formats,
        (SELECT count(*) FROM resource r WHERE r.package_id = p.id AND state = 'active') AS resource_count,
        coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM package_tag t WHERE t.package_id = p.id), '') AS tags,
        coalesce((SELECT string_agg(g.name || ':' || g.title, ',' ORDER BY g.name || ':' || g.title) FROM package_group x JOIN grp g ON g.id = x.group_id WHERE x.package_id = p.id), '') AS groups
        FROM package_core p WHERE state = 'active'"""),
    "list_package_documents": query("""SELECT p.id, o.name AS organization,
        coalesce((SELECT string_agg(DISTINCT upper(format), ',' ORDER BY upper(format)) FROM resource r WHERE r.package_id = p.id AND state = 'active' AND format <> ''), '') AS formats,
        coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM package_tag t WHERE t.package_id = p.id), '') AS tags,
        coalesce((SELECT string_agg(g.name || ':' || g.title, ',' ORDER BY g.name || ':' || g.title) FROM package_group x JOIN grp g ON g.id = x.group_id WHERE x.package_id = p.id), '') AS groups,
        length(p.notes) AS n_notes FROM package_notes p LEFT JOIN organization o ON o.id = p.owner_org WHERE p.state = 'active'"""),
    "list_resource_documents": query("SELECT id, package_id, name, description, upper(format) AS format FROM resource WHERE state = 'active'"),
    "list_organizations": query("""SELECT o.id, o.name, (SELECT count(*) FROM package_core p WHERE p.owner_org = o.id AND p.state = 'active') AS datasets FROM organization o WHERE state = 'active'"""),
    "list_organizations_matching": query("""SELECT o.id, (SELECT count(*) FROM package_core p WHERE p.owner_org = o.id AND p.state = 'active') AS datasets, count(*) OVER () AS total
        FROM organization o WHERE state = 'active' AND (contains(lower(name), '_1') OR contains(lower(title), '_1'))"""),
    "list_groups": query("SELECT g.id, g.name, (SELECT count(*) FROM package_group p WHERE p.group_id = g.id) AS datasets FROM grp g"),
    "list_tags": query("""SELECT tag, count(DISTINCT package_id) AS datasets, count(*) OVER () AS total FROM (SELECT p_brand AS tag FROM part UNION SELECT 'Brand#1-' || lower(r_name) FROM region)
        LEFT JOIN package_tag USING (tag) WHERE tag ILIKE '%brand#1%' GROUP BY tag"""),
    "list_members": query("""SELECT m.user_id, o.name AS organization, m.role, u.name AS user_name, u.role = 'sysadmin' AS is_sysadmin
        FROM membership m JOIN users u ON u.id = m.user_id JOIN organization o ON o.id = m.organization_id AND o.state = 'active'"""),
    "list_roles_at_least_editor": query("SELECT * FROM membership WHERE role IN ('admin', 'editor')"),
    "list_users_autocomplete": query("SELECT id, name, email FROM users WHERE state = 'active' AND (name ILIKE '%user-%' OR email ILIKE '%user-%') ORDER BY name LIMIT 20"),
    "list_formats": query("SELECT DISTINCT format FROM resource WHERE state = 'active' AND format <> ''"),
    "list_accessible": query("""SELECT id FROM package_core p WHERE (NOT private AND state = 'active')
        OR EXISTS (SELECT 1 FROM membership m WHERE m.user_id = '3' AND m.organization_id = p.owner_org)"""),
    "list_next_position": query("""SELECT p.id, CAST(coalesce(max(r.position), -1) + 1 AS INTEGER) AS next_position FROM package_core p LEFT JOIN resource_positions r ON r.package_id = p.id GROUP BY p.id"""),
    "list_positions": query("SELECT id, position FROM resource_positions"),
    "detail_packages": query("""SELECT p.id, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM package_tag t WHERE t.package_id = p.id), '') AS tags,
        coalesce((SELECT string_agg(g.name, ',' ORDER BY g.name) FROM package_group x JOIN grp g ON g.id = x.group_id WHERE x.package_id = p.id), '') AS groups,
        coalesce((SELECT string_agg(r.id, ',' ORDER BY position) FROM resource_positions r WHERE r.package_id = p.id AND r.state = 'active'), '') AS resources,
        o.name AS organization FROM package_core p LEFT JOIN organization o ON o.id = p.owner_org"""),
    "list_compat": query("""SELECT id, created AS metadata_created, updated AS metadata_modified, owner_org AS owner_organization,
        upper(left(license_id, 1)) || lower(substr(license_id, 2)) AS license_title FROM package"""),
    "stats_jobs": query("SELECT status, count(*) AS n FROM pipeline GROUP BY status"),
    "stats_job_list": query("""SELECT j.resource_id, j.status, r.name AS resource_name, p.name AS package_name FROM pipeline j JOIN resource r ON r.id = j.resource_id
        JOIN package_core p ON p.id = r.package_id WHERE j.status IN ('error', 'queued')"""),
    "stats_job_order": query("""SELECT j.resource_id, j.status FROM pipeline j JOIN resource r ON r.id = j.resource_id JOIN package_core p ON p.id = r.package_id
        ORDER BY CASE j.status WHEN 'processing' THEN 0 WHEN 'queued' THEN 1 WHEN 'pending' THEN 2 WHEN 'complete' THEN 3 ELSE 4 END, j.updated DESC, j.resource_id LIMIT 50"""),
    "stats_recent_errors": query("SELECT resource_id, updated FROM pipeline WHERE status = 'error' ORDER BY updated DESC, resource_id LIMIT 10"),
    "stats_health": query("SELECT coalesce(health_status, 'unknown') AS status, count(*) AS n FROM resource WHERE state = 'active' GROUP BY 1"),
    "stats_health_order": query("""SELECT id, health_status FROM resource WHERE state = 'active' ORDER BY CASE WHEN health_status = 'error' THEN 0 WHEN health_status IS NULL THEN 1 ELSE 2 END,
        health_checked_at DESC NULLS LAST, id LIMIT 50"""),
    "stats_users": query("""SELECT count(*) AS total, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'active' AND role = 'sysadmin') AS sysadmin,
        count(*) FILTER (WHERE state = 'deleted') AS deleted FROM users"""),
    "stats_index": query("""SELECT 'packages' AS index, count(*) AS docs, CAST(coalesce(sum(strlen(notes)), 0) AS BIGINT) AS bytes FROM package_notes
        UNION ALL SELECT 'content', count(*), CAST(coalesce(sum(strlen(extracted_text)), 0) AS BIGINT) FROM content"""),
    "stats_content_by_resource": query("SELECT resource_id, count(*) AS chunks, CAST(sum(chunk_size) AS BIGINT) AS bytes, min(content_type) AS content_type FROM content GROUP BY 1"),
    "stats_browse": query("SELECT resource_id, package_id, content_type, chunk_index, chunk_size FROM content ORDER BY CAST(resource_id AS BIGINT) LIMIT 100 OFFSET 20"),
    "health_stale_batch": query("""SELECT id, health_checked_at FROM resource WHERE state = 'active' AND (health_checked_at IS NULL OR health_checked_at < TIMESTAMP '1999-01-01' - INTERVAL 24 HOURS)
        ORDER BY health_checked_at ASC NULLS FIRST, id LIMIT 200"""),
    "health_stale": query("SELECT id FROM resource WHERE state = 'active' AND (health_checked_at IS NULL OR health_checked_at < TIMESTAMP '1998-12-31')"),
    "health_changes": query("SELECT event_id, coalesce(props <> lag(props) OVER (PARTITION BY user_id ORDER BY ts), false) AS changed FROM events"),
    "health_summary": query("""SELECT count(*) AS total, count(health_status) AS checked, count(*) FILTER (WHERE health_status = 'ok') AS ok, count(*) FILTER (WHERE health_status = 'error') AS error,
        count(*) FILTER (WHERE size > 400000) AS changed, count(*) FILTER (WHERE size > 400000 OR (health_status = 'ok' AND (health_checked_at IS NULL OR health_checked_at < TIMESTAMP '1999-01-01' - INTERVAL 168 HOURS))) AS enqueued
        FROM resource"""),
    "change_upsert": query("SELECT id, title FROM package_core WHERE id NOT IN (SELECT id FROM organization) UNION ALL SELECT id, title FROM organization"),
    "change_delete": query("SELECT id FROM package_core WHERE id NOT IN (SELECT package_id FROM resource WHERE state = 'deleted')"),
    "change_patch": query("""SELECT p.id, CASE WHEN o.id IS NOT NULL AND CAST(o.id AS INTEGER) % 2 = 0 THEN o.title ELSE p.title END AS title, p.license_id
        FROM package_core p LEFT JOIN organization o ON o.id = p.id"""),
    "change_soft_delete": query("SELECT id, CASE WHEN private THEN 'deleted' ELSE state END AS state FROM package_core"),
    "change_purge_resources": query("SELECT r.id FROM resource r WHERE NOT EXISTS (SELECT 1 FROM package_core p WHERE p.id = r.package_id AND p.state = 'deleted')"),
    "change_purge_jobs": query("""SELECT resource_id FROM pipeline j WHERE NOT EXISTS (SELECT 1 FROM resource r JOIN package_core p ON p.id = r.package_id WHERE r.id = j.resource_id AND p.state = 'deleted')"""),
    "change_purge_guard": query("SELECT id FROM organization WHERE id IN (SELECT owner_org FROM package_core WHERE private)"),
    "change_replace_links": query("""SELECT package_id, tag FROM package_tag WHERE package_id NOT IN (SELECT id FROM package_core WHERE private)
        UNION ALL SELECT id, 'hidden' FROM package_core WHERE private"""),
    "change_create_checked": query("""SELECT n.name, CASE WHEN NOT regexp_matches(n.name, '^[a-z0-9._-]+$') THEN 'name' WHEN EXISTS (SELECT 1 FROM package_core p WHERE p.name = n.name) THEN 'taken'
        WHEN NOT EXISTS (SELECT 1 FROM organization o WHERE o.id = n.owner_org AND o.state = 'active') THEN 'organization' END AS rejected
        FROM (SELECT CASE WHEN private THEN 'New ' ELSE '' END || name AS name, owner_org FROM package_core UNION ALL SELECT 'from-' || replace(name, '_', '-'), id FROM organization) n"""),
}

_FACETS = """
    counted AS (
        SELECT 'organization' AS facet, o.name, count(*) AS count FROM flagship p JOIN organization o ON o.id = p.owner_org GROUP BY 2
        UNION ALL SELECT 'tag', tag, count(DISTINCT package_id) FROM package_tag JOIN flagship p ON p.id = package_id GROUP BY 2
        UNION ALL SELECT 'format', format, count(DISTINCT package_id) FROM active_formats JOIN flagship p ON p.id = package_id GROUP BY 2
        UNION ALL SELECT 'license', license_id, count(*) FROM flagship WHERE license_id <> '' GROUP BY 2
        UNION ALL SELECT 'group', g.name, count(DISTINCT package_id) FROM package_group JOIN flagship p ON p.id = package_id JOIN grp g ON g.id = group_id GROUP BY 2)
"""
SQL["search_facets"] = query("SELECT facet, name, count FROM counted", f"{FLAGSHIP_SQL}, {_FACETS}")
SQL["search_facets_top"] = query("SELECT facet, name, count FROM counted QUALIFY row_number() OVER (PARTITION BY facet ORDER BY count DESC, name) <= 3", f"{FLAGSHIP_SQL}, {_FACETS}")
SQL["search_facets_zero_filled"] = query("""SELECT k.facet, k.name, k.title, coalesce(c.count, 0) AS count FROM (SELECT 'organization' AS facet, name, title FROM organization WHERE state = 'active'
    UNION ALL SELECT 'group', name, title FROM grp) k LEFT JOIN counted c ON c.facet = k.facet AND c.name = k.name""", f"{FLAGSHIP_SQL}, {_FACETS}")
