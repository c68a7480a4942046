"""Queries over ranked search in full, lookups, composed changes and raw files, each with its oracle where SQL has one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions import text
from ..operators import admin, health, listing, lookup, mutations, ranked, search
from ..sources import files
from ..sources.catalog import Catalog
from ..streaming import jobs
from .search_queries import bm25_sql
from .views import query

NOW = datetime(1999, 1, 1)
ALL = search.Filters(allowed_orgs=None)
#: Resources and contents that some pages rank, as their SQL does; the others rank all that match.
LEG_TOP = 100


def _page(c: Catalog, q: str, offset: int = 0, limit: int = 50, top: int | None = None):
    return ranked.ranked_page(c, q, ALL, offset, limit, c.content_lines, top=top)


def _shown(df):
    return df.select("rank", "id", F.round("score", 4).alias("score"), "source", "total")


def matched(c: Catalog, q: str = "1"):
    _, resources, content = ranked.search_legs(c, q, ALL, c.content_lines)
    return ranked.matched_resources(resources, content, _page(c, q))


def snippets(c: Catalog):
    found = ranked.with_snippets(matched(c), c.content_lines, "1")
    return found.select("package_id", "resource_id", "match_source", "chunk_id", "place", F.contains("snippet", F.lit("<mark>1</mark>")).alias("marked"))


def highlights(c: Catalog):
    packages = c.package_notes.select("id", F.concat(F.lit("<script>alert(1)</script>"), "title").alias("title"), F.lit("<b>The</b> machinery is here").alias("notes"))
    shown = _page(c, "machinery", top=LEG_TOP)
    return ranked.with_highlights(shown, packages, "machinery").select("rank", "id", "highlighted_title", "highlighted_notes")


def _tables(c: Catalog) -> dict:
    tags = c.tag.select(F.sha2("tag", 256).alias("id"), F.col("tag").alias("name"))
    links = c.package_tag.select("package_id", F.sha2("tag", 256).alias("tag_id"))
    return {"package": c.package_core, "organization": c.organization, "tag": tags, "package_tag": links}


def _new_packages(c: Catalog):
    return c.organization.select(
        F.concat(F.lit("new-"), "id").alias("id"), F.concat(F.lit("new-"), F.replace("name", F.lit("_"), F.lit("-"))).alias("name"), F.col("title"), F.col("id").alias("owner_org"),
        F.lit(False).alias("private"), F.lit("active").alias("state"), F.array(F.lit("Brand#1"), F.concat(F.lit("fresh-"), "id"), F.lit("Brand#1")).alias("tags"),
    )


def _links(tables: dict):
    return tables["package_tag"].join(tables["tag"].select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), "tag_id").select("package_id", "tag")


def _changes(c: Catalog):
    even = F.col("id").cast("int") % 2 == 0
    return c.organization.select("id", F.when(even, F.col("title")).alias("title"), F.when(~even, F.array(F.lit("Brand#2"), F.concat(F.lit("only-"), "id"))).alias("tags"))


def _users(c: Catalog):
    state = F.when(F.col("id").cast("int") >= 5, "deleted").otherwise("active")
    return c.user.withColumn("state", state)


def _purged(c: Catalog) -> dict:
    log = c.raw("events").select(F.col("event_id").cast("string").alias("entity_id"), F.lit("view").alias("action"), (F.col("user_id") % 7).cast("string").alias("user_id"), F.lit(None).cast("string").alias("changes"))
    tables = {"user": _users(c), "package": c.package_core.where("creator_user_id <> '6'"), "activity": log, "audit_log": log}
    return mutations.purge_users(tables, _users(c).select("id"), "0")


def _jobs(c: Catalog):
    return c.pipeline.select("resource_id", "status", "updated", "error", F.lit("key").alias("preview_key"))


def _asked(c: Catalog):
    return c.resource.where("state = 'deleted'").select("id")


def _geojson(c: Catalog):
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), (F.col("s_suppkey") % 90).cast("string"), F.lit(","), (F.col("s_suppkey") % 45).cast("string"), F.lit(']},"properties":{"name":"'), F.col("s_name"), F.lit('","empty":"","tag":"<b>"}}'))
    grouped = c.raw("supplier").groupBy(F.col("s_nationkey").cast("string").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(feature)), ",").alias("f"))
    return files.geojson_features(grouped.select("path", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("text")))


def _csv(c: Catalog):
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', x"')), F.col("o_orderstatus"))
    grouped = c.raw("orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda r: r["l"]), "\n").alias("body"))
    return grouped.select("path", F.encode(F.concat(F.lit("key,priority,status\n"), "body", F.lit("\n合計,,\n")), "UTF-8").alias("content"))


def _objects(c: Catalog):
    return c.raw("documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), F.octet_length("text").cast("long").alias("length"))


def csv_rows(c: Catalog):
    cells = files.extract_tables(files.with_encoding(_csv(c)))
    return cells.where("error IS NULL").select("path", F.col("row_index").cast("long").alias("row_index"), F.array_join("columns", "|").alias("names"), F.array_join("cells", "|").alias("cells"))


def office(c: Catalog):
    """Orders whose jobs have steps, as an entry list of made-up archives."""
    return c.raw("lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("dir"), F.col("l_linenumber").cast("string"), F.lit("/sub/file-"), F.col("l_partkey").cast("string"), F.lit(".csv")).alias("name"),
        F.col("l_quantity").cast("long").alias("size"), F.lit(1).cast("long").alias("compressed_size"), F.lit(False).alias("is_directory"),
    )


def messages(c: Catalog):
    """Every event as a message; some are malformed, some of an unknown type."""
    kind = F.when(F.col("event_id") % 3 == 0, "process-resource").when(F.col("event_id") % 3 == 1, "health-check").otherwise("other")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), kind.alias("type"), F.col("event_type").alias("data")))
    return c.raw("events").select(F.when(F.col("event_id") % 10 == 0, F.lit("not json")).otherwise(body).alias("value"))


def chunks_of(c: Catalog, limit: int, last_break: bool):
    docs = c.raw("documents").select(F.col("doc_id").cast("string").alias("resource_id"), F.col("source").alias("package_id"), F.lit("text").alias("content_type"), "text")
    return text.chunk_totals(text.content_chunks(docs, limit, last_break=last_break), docs)


SPARK = {
    # ranked search in full
    "ranked_page_all_legs": lambda c: _shown(_page(c, "1")),
    "ranked_page_offset": lambda c: _shown(_page(c, "1", 7, 5)),
    "ranked_page_by_tag": lambda c: _shown(_page(c, "Brand#1", top=LEG_TOP)),
    "ranked_page_by_name": lambda c: _shown(_page(c, "customer-000000007", top=LEG_TOP)),
    "ranked_page_without_query": lambda c: _shown(_page(c, "")),
    "ranked_matched_resources": matched,
    "ranked_snippets": snippets,
    "ranked_highlights_sanitised": highlights,
    "ranked_chunks": lambda c: ranked.content_leg(c.content_lines, "the and", None).select("resource_id", "chunk_index", F.round("score", 4).alias("score")),
    "ranked_enriched_page": lambda c: ranked.enriched_page(c, _page(c, "1")).select("rank", "id", "name", "formats", "resource_count", "tags"),
    # exact search in full
    "search_exact_matched": lambda c: search.exact_search(c, search.Filters(q="urgent", tags=("Brand#1",)), limit=30).select("id", "total", "organization", "tags", F.array_join("matched", ",").alias("matched")),
    "search_licenses_distinct": lambda c: search.license_ids(search.matching(c, search.Filters())),
    "search_toggle": lambda c: c.package_core.select("id", F.array_join(F.array_sort(search.toggled(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("license_id"))), ",").alias("chosen")),
    "search_deleted_view": lambda c: search.matching(c, search.Filters(state=search.state_shown("deleted", True, None), allowed_orgs=None)).select(F.lit("nobody").alias("user"), "id").unionByName(search.matching(c, search.Filters(state=search.state_shown("deleted", True, "1"), allowed_orgs=None)).select(F.lit("member").alias("user"), "id")),
    # lookups
    "lookup_with_license": lambda c: lookup.with_license(c.package_core.select("id", F.when(F.col("private"), F.lit("cc-by-4.0")).otherwise(F.col("license_id")).alias("license_id"))),
    "lookup_by_id": lambda c: lookup.by_id(c.package_core, "17").select("id", "name"),
    "lookup_by_ids": lambda c: lookup.by_ids(c.package_core, ["9", "missing", "3", "9"]).select("place", "id", "name"),
    "lookup_by_name": lambda c: lookup.by_name_or_id(c.package_core, "customer-000000007").select("id", "name"),
    "lookup_browse_matching": lambda c: lookup.browse_matching(c.content.withColumn("key", F.col("resource_id").cast("long")), ["extracted_text"], "the und", "key", 2, 500).select("resource_id", "chunk_size", "total"),
    "lookup_content_page": lambda c: lookup.content_page(admin.content_by_resource(c.content_lines), 5, 20),
    "lookup_recent": lambda c: lookup.recent(c.package, "updated").select("id", "updated"),
    "lookup_job_status": lambda c: lookup.with_job_status(c.resource.select("id"), c.pipeline),
    "lookup_status_envelope": lambda c: lookup.status_envelope(c.pipeline, c.step, c.resource).select("id", "pipeline_status", F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["step_name"], x["status"])), ",").alias("steps")),
    "lookup_admin_role": lambda c: lookup.with_admin_role(c.membership.where("user_id = '3'"), c.organization, False).unionByName(lookup.with_admin_role(c.membership, c.organization, True)),
    "lookup_index_counts": lambda c: lookup.index_counts(packages=listing.package_documents(c), resources=listing.resource_documents(c), jobs=c.pipeline.where("status = 'error'")),
    "list_page_without_total": lambda c: listing.with_total(c.tag).orderBy("tag").limit(10).drop("total"),
    "list_all_tags": lambda c: listing.tag_list(c),
    "health_stale_external": lambda c: health.stale(c.resource.withColumn("url", F.when(F.col("size") % 3 != 0, "https://a.example")).withColumn("url_type", F.when(F.col("size") % 2 == 0, "upload")), NOW).select("id"),
    # changes made of several tables
    "change_create_packages": lambda c: mutations.create_with_links(_tables(c), _new_packages(c))["package"].select("id", "name", "owner_org"),
    "change_create_links": lambda c: _links(mutations.create_with_links(_tables(c), _new_packages(c))),
    "change_update_packages": lambda c: mutations.update_with_links(_tables(c), _changes(c))["package"].select("id", "title"),
    "change_update_links": lambda c: _links(mutations.update_with_links(_tables(c), _changes(c))),
    "change_find_or_create_tags": lambda c: mutations.find_or_create_tags(_tables(c)["tag"], c.grp.select("name").unionByName(c.tag.select(F.col("tag").alias("name")))).select("name"),
    "change_members": lambda c: mutations.set_members(c.membership, c.organization.select(F.lit("1").alias("user_id"), F.col("id").alias("organization_id"), F.when(F.col("id").cast("int") % 2 == 0, "editor").alias("role"))),
    "change_update_resources": lambda c: mutations.update_resources(c.resource, c.resource.where("size % 5 = 0").select("id", F.lit("geojson").alias("format"), F.when(F.col("size") % 2 == 0, "changed").alias("name"))).select("id", "name", "format"),
    "change_complete_upload": lambda c: mutations.complete_upload(c.resource.select("id", "size", F.lit(None).cast("string").alias("url"), F.lit("old").alias("hash"), F.lit(None).cast("string").alias("url_type")), c.resource.where("size % 7 = 0").select("id", F.concat(F.lit("f-"), "id").alias("url"), F.lit(5).cast("long").alias("size"), F.lit("new").alias("hash"))),
    "change_restore_users": lambda c: mutations.restore_users(_users(c), c.raw("region").select((F.col("r_regionkey") + 2).cast("string").alias("id"))).select("id", "state"),
    "change_delete_user": lambda c: mutations.delete_user(c.user, c.membership, c.membership, "3")[1].select("user_id", "organization_id"),
    "change_purge_users": lambda c: _purged(c)["user"].select("id"),
    "change_purge_users_log": lambda c: _purged(c)["audit_log"].groupBy("action", "user_id", "changes").agg(F.count("*").alias("n")),
    "change_steps": lambda c: mutations.set_steps(c.step.select("resource_id", "step_name", "status", "error"), c.step.where("status = 'error'").select("resource_id", F.lit("index").alias("step_name"), F.lit("complete").alias("status"), F.lit(None).cast("string").alias("error")).distinct()),
    "change_restart_jobs": lambda c: mutations.restart_jobs(_jobs(c), c.step, _asked(c), NOW)[0],
    "change_restart_steps": lambda c: mutations.restart_jobs(_jobs(c), c.step, _asked(c), NOW)[1].select("resource_id", "step_name"),
    "change_valid_tokens": lambda c: mutations.valid_tokens(c.user.select(F.col("id").alias("user_id"), F.sha2(F.concat(F.lit("t"), F.col("id")), 256).alias("hash"), F.when(F.col("id") == "4", F.lit(datetime(1998, 1, 1))).alias("expires")), c.user, "t3", NOW),
    "change_reset": lambda c: mutations.reset({"user": c.user, "package": c.package_core})["user"].select("id"),
    "change_delete_prefix": lambda c: mutations.deleted_by_prefix(c.resource.select(s.storage_key(F.col("package_id"), F.col("id")).alias("path")), "resources/1")[1],
    "change_resource_positions": lambda c: mutations.reorder(c.resource_positions.where("package_id = '4'").select("id", "package_id", F.col("position").cast("int").alias("position")), [r["id"] for r in c.resource_positions.where("package_id = '4'").orderBy(F.desc("position")).select("id").collect()]).select("id", "position"),
    # files and scalars
    "source_split_lines": lambda c: files.split_lines(c.raw("documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n").otherwise("")).alias("text"))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars")),
    "source_tables": csv_rows,
    "source_encodings": lambda c: files.with_encoding(c.raw("documents").where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("content"))).select("doc_id", "encoding"),
    "source_fetched": lambda c: files.fetched(_objects(c)).select("path", "hash", "size"),
    "source_byte_range": lambda c: files.byte_range(_objects(c), 3, 40).select("path", F.hex("part").alias("bytes"), "total_size"),
    "source_preview": lambda c: files.text_preview(_objects(c).withColumn("encoding", F.lit("UTF8")), limit=1 << 20).select("path", F.length("text").alias("chars"), "truncated"),
    "source_manifest": lambda c: files.zip_manifest(office(c), 3),
    "source_entries_kept": lambda c: files.kept_entries(office(c), 3).select("path", "name"),
    "source_tree": lambda c: files.tree_order(files.path_tree(office(c), by_range=True)),
    "source_geojson": lambda c: _geojson(c).select("path", F.element_at("properties", "name").alias("name"), F.col("geometry.type").alias("type")),
    "source_geojson_rows": lambda c: files.property_table(_geojson(c)).select("path", "rows"),
    "source_geojson_bounds": lambda c: files.bounds_or_centre(files.feature_bounds(_geojson(c)), c.organization.select(F.col("id").alias("path")).unionByName(c.grp.select(F.col("name").alias("path")))),
    "source_table_metadata": lambda c: files.table_metadata(c.spark, f"{c.path}/customer.parquet"),
    "scalar_problems": lambda c: c.package_core.select("id", s.package_problem(F.when(F.col("id").cast("int") % 5 == 0, F.lit("Bad Name")).otherwise(F.col("name")), F.col("title"), F.when(F.col("id").cast("int") % 3 == 0, "no url").otherwise("https://a.example/x"), F.when(F.col("id").cast("int") % 7 == 0, "a@b").otherwise(F.when(F.col("id").cast("int") % 2 == 0, "a.b@c.example").otherwise("")), F.when(F.col("id").cast("int") % 11 == 0, "x").otherwise("0a0a0a0a-aaaa-bbbb-cccc-0a0a0a0a0a0a")).alias("problem")),
    "scalar_escape": lambda c: c.raw("pages").select("page_id", s.escape_html(F.col("html")).alias("text")),
    "scalar_local_date": lambda c: c.package.select("id", s.local_date(F.col("updated").cast("timestamp")).alias("shown")),
    "jobs_parsed": lambda c: jobs.parse_jobs(messages(c)),
    "jobs_outcome": lambda c: jobs.pipeline_outcome(c.step),
    "content_chunk_totals": lambda c: chunks_of(c, text.CHUNK_BYTES, True),
}

_LINES = """content_lines AS (SELECT CAST(doc_id AS VARCHAR) AS resource_id, CAST(doc_id * 7 % 150 + 1 AS VARCHAR) AS package_id, i - 1 AS chunk_index, extracted_text
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS extracted_text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    live AS (SELECT * FROM package_notes WHERE state = 'active'),
    live_resource AS (SELECT r.* FROM resource r WHERE state = 'active' AND package_id IN (SELECT id FROM live)),
    live_lines AS (SELECT * FROM content_lines WHERE package_id IN (SELECT id FROM live))"""


def legs_sql(q: str, terms: list[str], top: int | None = None) -> str:
    """The three legs and their ranking; with ``top``, only of the best resources and contents."""
    best = lambda key: "" if top is None else f" ORDER BY score DESC, {key} LIMIT {top}"
    keyword = lambda boost, df: f"{boost} / 2.2 * ln(1 + ((SELECT count(*) FROM live) - {df} + 0.5) / ({df} + 0.5))"
    return f"""{_LINES},
        named AS (SELECT id FROM live WHERE name = '{q}'), tagged AS (SELECT package_id AS id FROM package_tag WHERE tag = '{q}' AND package_id IN (SELECT id FROM live)),
        package_leg AS (SELECT id, max(score) AS score FROM (SELECT id, score FROM {bm25_sql('live', {'title': 3.0, 'notes': 1.0}, terms, 'id')}
            UNION ALL SELECT id, {keyword(2.0, '(SELECT count(*) FROM named)')} FROM named UNION ALL SELECT id, {keyword(1.0, '(SELECT count(*) FROM tagged)')} FROM tagged) GROUP BY id),
        resource_leg AS (SELECT id, package_id, score FROM {bm25_sql('live_resource', {'name': 3.0, 'description': 2.0}, terms, 'id, package_id')}{best('id')}),
        content_leg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY score DESC, chunk_index) AS n
            FROM {bm25_sql('live_lines', {'extracted_text': 1.0}, terms, 'resource_id, package_id, chunk_index')}) WHERE n = 1{best('resource_id')}),
        merged AS (SELECT id, CASE WHEN p IS NULL AND r IS NULL THEN 0.4 ELSE coalesce(p, 0) + coalesce(r * 0.4, 0) END AS score,
            CASE WHEN p IS NOT NULL THEN 'package' WHEN r IS NOT NULL THEN 'resource' ELSE 'content' END AS source
            FROM (SELECT id, max(score) FILTER (WHERE leg = 'p') AS p, max(score) FILTER (WHERE leg = 'r') AS r FROM (SELECT 'p' AS leg, id, score FROM package_leg
                UNION ALL SELECT 'r', package_id, score FROM resource_leg UNION ALL SELECT 'c', package_id, score FROM content_leg) GROUP BY id)),
        ranking AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, updated DESC NULLS LAST, id) AS INTEGER) AS rank, id, score, source, count(*) OVER () AS total FROM merged JOIN live USING (id))"""


def page_sql(q: str, terms: list[str], offset: int = 0, limit: int = 50, top: int | None = None) -> str:
    return query(f"SELECT rank, id, round(score, 4) AS score, source, total FROM ranking WHERE rank > {offset} AND rank <= {offset + limit}", legs_sql(q, terms, top))


_MATCHED = """, matched AS (SELECT package_id, resource_id, CASE WHEN chunk_index IS NOT NULL THEN 'content' ELSE 'metadata' END AS match_source, resource_id || '_chunk_' || chunk_index AS chunk_id,
    CAST(row_number() OVER (PARTITION BY package_id ORDER BY own DESC NULLS LAST, inside DESC NULLS LAST, resource_id) AS INTEGER) AS place
    FROM (SELECT coalesce(r.package_id, c.package_id) AS package_id, coalesce(r.id, c.resource_id) AS resource_id, r.score AS own, c.score AS inside, c.chunk_index
        FROM resource_leg r FULL JOIN content_leg c ON r.id = c.resource_id AND r.package_id = c.package_id) WHERE package_id IN (SELECT id FROM ranking WHERE rank <= 50))"""
_PACKAGE_LIST = """coalesce((SELECT string_agg(DISTINCT upper(format), ',' ORDER BY upper(format)) FROM resource r WHERE r.package_id = p.id AND state = 'active' AND format <> ''), '') AS formats,
    (SELECT count(*) FROM resource r WHERE r.package_id = p.id AND state = 'active') AS resource_count,
    coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM package_tag t WHERE t.package_id = p.id), '') AS tags"""
_TAG = "tag AS (SELECT p_brand AS tag FROM part UNION SELECT 'Brand#1-' || lower(r_name) FROM region)"
_STEP = """step AS (SELECT CAST(event_id AS VARCHAR) AS resource_id, unnest(['fetch', 'extract', 'index'][1:CAST(event_id % 3 + 1 AS INTEGER)]) AS step_name,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END AS status FROM events)"""
_USERS = "known AS (SELECT id, name, email, CASE WHEN CAST(id AS INTEGER) >= 5 THEN 'deleted' ELSE 'active' END AS state FROM users)"
_GONE = f"{_USERS}, gone AS (SELECT * FROM known WHERE state = 'deleted' AND id NOT IN (SELECT creator_user_id FROM package_core WHERE creator_user_id <> '6'))"
_ENTRIES = "entries AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, 'dir' || l_linenumber || '/sub/file-' || l_partkey || '.csv' AS name, CAST(l_quantity AS BIGINT) AS size FROM lineitem)"
_LICENSES = ", ".join(f"({i}, '{a}', '{t}', '{u}', {'true' if i < lookup.OWN_LICENSES else 'false'})" for i, (a, t, u) in enumerate(lookup.LICENSES))
_NEW = "new AS (SELECT 'new-' || id AS id, 'new-' || replace(name, '_', '-') AS name, id AS owner_org FROM organization WHERE state = 'active')"

SQL = {
    "ranked_page_all_legs": page_sql("1", ["1"]),
    "ranked_page_offset": page_sql("1", ["1"], 7, 5),
    "ranked_page_by_tag": page_sql("Brand#1", ["brand", "1"], top=LEG_TOP),
    "ranked_page_by_name": page_sql("customer-000000007", ["customer", "000000007"], top=LEG_TOP),
    "ranked_page_without_query": query("""SELECT CAST(row_number() OVER (ORDER BY updated DESC NULLS LAST, id) AS INTEGER) AS rank, id, 0.0::DOUBLE AS score, 'package' AS source,
        (SELECT count(*) FROM package WHERE state = 'active') AS total FROM package WHERE state = 'active' ORDER BY rank LIMIT 50"""),
    "ranked_matched_resources": query("SELECT * FROM matched WHERE place <= 100", legs_sql("1", ["1"]) + _MATCHED),
    "ranked_snippets": query("SELECT *, CASE WHEN match_source = 'content' THEN true END AS marked FROM matched WHERE place <= 100", legs_sql("1", ["1"]) + _MATCHED),
    "ranked_highlights_sanitised": query(r"""SELECT rank, id, CASE WHEN title ILIKE '%machinery%' THEN 'alert(1)' || regexp_replace(title, '\b(machinery)\b', '<mark>\1</mark>', 'gi') END AS highlighted_title,
        'The <mark>machinery</mark> is here' AS highlighted_notes FROM ranking JOIN live USING (id) WHERE rank <= 50""", legs_sql("machinery", ["machinery"], LEG_TOP)),
    "ranked_chunks": query(f"""SELECT resource_id, CAST(chunk_index AS INTEGER) AS chunk_index, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY score DESC, chunk_index) AS n
        FROM {bm25_sql('content_lines', {'extracted_text': 1.0}, ['the', 'and'], 'resource_id, package_id, chunk_index')}) WHERE n = 1""", _LINES),
    "ranked_enriched_page": query(f"SELECT k.rank, p.id, p.name, {_PACKAGE_LIST} FROM ranking k JOIN package p ON p.id = k.id WHERE rank <= 50", legs_sql("1", ["1"])),
    "search_exact_matched": query("""SELECT p.id, total, o.name AS organization, (SELECT string_agg(tag, ',' ORDER BY tag) FROM package_tag t WHERE t.package_id = p.id) AS tags,
        coalesce((SELECT string_agg(name, ',' ORDER BY n) FROM (SELECT r.name, row_number() OVER (ORDER BY r.id) AS n FROM resource r WHERE r.package_id = p.id AND state = 'active'
            AND (r.name ILIKE '%urgent%' OR description ILIKE '%urgent%')) WHERE n <= 100), '') AS matched
        FROM (SELECT *, count(*) OVER () AS total FROM package_notes q WHERE state = 'active' AND NOT private AND EXISTS (SELECT 1 FROM package_tag t WHERE t.package_id = q.id AND tag = 'Brand#1')
            AND (name ILIKE '%urgent%' OR title ILIKE '%urgent%' OR notes ILIKE '%urgent%' OR id IN (SELECT package_id FROM resource WHERE state = 'active' AND (name ILIKE '%urgent%' OR description ILIKE '%urgent%')))
            ORDER BY updated DESC NULLS LAST, id LIMIT 30) p LEFT JOIN organization o ON o.id = p.owner_org"""),
    "search_licenses_distinct": query("SELECT DISTINCT license_id FROM package WHERE state = 'active' AND NOT private AND license_id <> ''"),
    "search_toggle": query("SELECT id, CASE license_id WHEN 'BUILDING' THEN 'MACHINERY' WHEN 'MACHINERY' THEN 'BUILDING' ELSE array_to_string(list_sort(['BUILDING', 'MACHINERY', license_id]), ',') END AS chosen FROM package_core"),
    "search_deleted_view": query("SELECT 'nobody' AS user, id FROM package_core WHERE state = 'active' UNION ALL SELECT 'member', id FROM package_core WHERE state = 'deleted'"),
    "lookup_with_license": query("""SELECT id, CASE WHEN private THEN 'cc-by-4.0' ELSE license_id END AS license_id, CASE WHEN private THEN 'Creative Commons Attribution 4.0' ELSE license_id END AS license_title,
        CASE WHEN private THEN 'https://creativecommons.org/licenses/by/4.0/' END AS license_url FROM package_core"""),
    "lookup_by_id": query("SELECT id, name FROM package_core WHERE id = '17'"),
    "lookup_by_ids": query("SELECT CASE id WHEN '9' THEN 0 ELSE 2 END AS place, id, name FROM package_core WHERE id IN ('9', '3')"),
    "lookup_by_name": query("SELECT id, name FROM package_core WHERE name = 'customer-000000007' AND state = 'active'"),
    "lookup_browse_matching": query(r"""SELECT resource_id, chunk_size, count(*) OVER () AS total FROM content WHERE list_has_all(regexp_extract_all(lower(extracted_text), '[\p{L}\p{N}]+'), ['the', 'und'])
        ORDER BY CAST(resource_id AS BIGINT) LIMIT 100 OFFSET 2"""),
    "lookup_content_page": query("SELECT resource_id, count(*) AS chunks, CAST(sum(strlen(extracted_text)) AS BIGINT) AS bytes, 'text' AS content_type FROM content_lines GROUP BY 1 ORDER BY 1 LIMIT 20 OFFSET 5", _LINES),
    "lookup_recent": query("SELECT id, updated FROM package ORDER BY updated DESC NULLS LAST, id LIMIT 5"),
    "lookup_job_status": query("SELECT r.id, j.status AS job_status FROM resource r LEFT JOIN pipeline j ON j.resource_id = r.id"),
    "lookup_status_envelope": query("""SELECT r.id, j.status AS pipeline_status, CASE WHEN j.status IS NULL THEN '' ELSE coalesce((SELECT string_agg(step_name || ':' || s.status, ',' ORDER BY CASE step_name WHEN 'index' THEN 0 WHEN 'extract' THEN 1 ELSE 2 END)
        FROM step s WHERE s.resource_id = r.id), '') END AS steps FROM resource r LEFT JOIN pipeline j ON j.resource_id = r.id""", _STEP),
    "lookup_admin_role": query("SELECT organization_id, role FROM membership WHERE user_id = '3' UNION ALL SELECT id, 'admin' FROM organization WHERE state = 'active'"),
    "lookup_index_counts": query("""SELECT 'packages' AS index, count(*) AS n FROM package WHERE state = 'active' UNION ALL SELECT 'resources', count(*) FROM resource WHERE state = 'active'
        UNION ALL SELECT 'jobs', count(*) FROM pipeline WHERE status = 'error'"""),
    "list_page_without_total": query("SELECT tag FROM tag ORDER BY tag LIMIT 10", _TAG),
    "list_all_tags": query("SELECT tag, count(DISTINCT package_id) AS datasets FROM tag LEFT JOIN package_tag USING (tag) GROUP BY tag", _TAG),
    "health_stale_external": query("SELECT id FROM resource WHERE state = 'active' AND size % 3 <> 0 AND size % 2 <> 0 AND (health_checked_at IS NULL OR health_checked_at < TIMESTAMP '1998-12-31')"),
    "change_create_packages": query("SELECT id, name, owner_org FROM package_core UNION ALL SELECT id, name, owner_org FROM new", _NEW),
    "change_create_links": query("SELECT package_id, tag FROM package_tag UNION ALL SELECT id, unnest(['Brand#1', 'fresh-' || owner_org]) FROM new", _NEW),
    "change_update_packages": query("SELECT p.id, CASE WHEN o.id IS NOT NULL AND CAST(o.id AS INTEGER) % 2 = 0 THEN o.title ELSE p.title END AS title FROM package_core p LEFT JOIN organization o ON o.id = p.id"),
    "change_update_links": query("""SELECT package_id, tag FROM package_tag WHERE package_id NOT IN (SELECT id FROM organization WHERE CAST(id AS INTEGER) % 2 = 1)
        UNION ALL SELECT o.id, unnest(['Brand#2', 'only-' || o.id]) FROM organization o JOIN package_core p ON p.id = o.id WHERE CAST(o.id AS INTEGER) % 2 = 1"""),
    "change_find_or_create_tags": query("SELECT tag AS name FROM tag UNION SELECT name FROM grp", _TAG),
    "change_members": query("""SELECT user_id, organization_id, role FROM membership WHERE user_id <> '1' OR organization_id NOT IN (SELECT id FROM organization)
        UNION ALL SELECT '1', id, 'editor' FROM organization WHERE CAST(id AS INTEGER) % 2 = 0"""),
    "change_update_resources": query("SELECT id, CASE WHEN size % 10 = 0 THEN 'changed' ELSE name END AS name, CASE WHEN size % 5 = 0 THEN 'GeoJSON' ELSE format END AS format FROM resource"),
    "change_complete_upload": query("""SELECT id, CASE WHEN size % 7 = 0 THEN 5 ELSE size END AS size, CASE WHEN size % 7 = 0 THEN 'f-' || id END AS url, CASE WHEN size % 7 = 0 THEN 'new' ELSE 'old' END AS hash,
        CASE WHEN size % 7 = 0 THEN 'upload' END AS url_type FROM resource"""),
    "change_restore_users": query("SELECT id, CASE WHEN CAST(id AS INTEGER) BETWEEN 2 AND 6 THEN 'active' ELSE state END AS state FROM known", _USERS),
    "change_delete_user": query("SELECT user_id, organization_id FROM membership WHERE user_id <> '3'"),
    "change_purge_users": query("SELECT id FROM known WHERE id NOT IN (SELECT id FROM gone)", _GONE),
    "change_purge_users_log": query("""SELECT action, user_id, changes, count(*) AS n FROM (SELECT 'view' AS action, CASE WHEN CAST(user_id % 7 AS VARCHAR) IN (SELECT id FROM gone) THEN NULL ELSE CAST(user_id % 7 AS VARCHAR) END AS user_id, NULL AS changes FROM events
        UNION ALL SELECT 'purge', '0', '{"purgedUserId":"' || id || '","purgedEmail":"' || email || '","purgedName":"' || name || '"}' FROM gone) GROUP BY 1, 2, 3""", _GONE),
    "change_steps": query("""SELECT resource_id, step_name, CASE WHEN status = 'error' AND step_name = 'index' THEN 'complete' ELSE status END AS status, CAST(NULL AS VARCHAR) AS error FROM step
        UNION ALL SELECT DISTINCT resource_id, 'index', 'complete', NULL FROM step s WHERE status = 'error' AND NOT EXISTS (SELECT 1 FROM step t WHERE t.resource_id = s.resource_id AND t.step_name = 'index')""", _STEP),
    "change_restart_jobs": query("""SELECT coalesce(j.resource_id, a.id) AS resource_id, CASE WHEN a.id IS NOT NULL THEN 'queued' ELSE j.status END AS status,
        CASE WHEN a.id IS NOT NULL THEN TIMESTAMP '1999-01-01' ELSE j.updated END AS updated, CASE WHEN a.id IS NULL THEN j.error END AS error, CASE WHEN j.resource_id IS NOT NULL THEN 'key' END AS preview_key
        FROM pipeline j FULL JOIN (SELECT id FROM resource WHERE state = 'deleted') a ON a.id = j.resource_id"""),
    "change_restart_steps": query("SELECT resource_id, step_name FROM step WHERE resource_id NOT IN (SELECT id FROM resource WHERE state = 'deleted')", _STEP),
    "change_valid_tokens": query("SELECT id AS user_id, name, role FROM users WHERE id = '3' AND state = 'active'"),
    "change_reset": query("SELECT id FROM users"),
    "change_delete_prefix": query("SELECT count(*) AS deleted FROM resource WHERE package_id LIKE '1%'"),
    "change_resource_positions": query("SELECT id, CAST((SELECT count(*) FROM resource WHERE package_id = '4') - 1 - position AS INTEGER) AS position FROM resource_positions WHERE package_id = '4'"),
    "source_split_lines": query("SELECT doc_id, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS lines, CAST(length(replace(text, chr(10), '')) AS BIGINT) AS chars FROM documents WHERE text <> '' OR doc_id % 2 = 0"),
    "source_tables": query("""SELECT CAST(o_custkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_index, 'key|priority|status' AS names,
        o_orderkey || '|' || o_orderpriority || ', x|' || o_orderstatus AS cells FROM orders"""),
    "source_fetched": query("SELECT CAST(doc_id AS VARCHAR) AS path, 'sha256:' || sha256(text) AS hash, strlen(text) AS size FROM documents"),
    "source_byte_range": query("SELECT CAST(doc_id AS VARCHAR) AS path, substr(hex(encode(text)), 7, 76) AS bytes, strlen(text) AS total_size FROM documents"),
    "source_preview": query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(length(text) AS INTEGER) AS chars, false AS truncated FROM documents"),
    "source_encodings": query("SELECT doc_id, CASE WHEN strlen(text) = length(text) THEN 'ASCII' ELSE 'UTF8' END AS encoding FROM documents WHERE text <> ''"),
    "source_table_metadata": "SELECT count(*) AS rows, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns FROM customer",
    "source_manifest": query("SELECT path, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, count(*) AS compressed, count(*) > 3 AS truncated FROM entries GROUP BY path", _ENTRIES),
    "source_entries_kept": query("SELECT path, name FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY name) AS n FROM entries) WHERE n <= 3", _ENTRIES),
    "source_tree": query("""SELECT DISTINCT path, node, is_directory FROM (SELECT path, split_part(name, '/', 1) AS node, true AS is_directory FROM entries
        UNION ALL SELECT path, split_part(name, '/', 1) || '/sub', true FROM entries UNION ALL SELECT path, name, false FROM entries)""", _ENTRIES),
    "source_geojson": query("SELECT CAST(s_nationkey AS VARCHAR) AS path, s_name AS name, 'Point' AS type FROM supplier"),
    "source_geojson_rows": query("""SELECT CAST(s_nationkey AS VARCHAR) AS path, '<tr><td>name</td><td>' || s_name || '</td></tr><tr><td>tag</td><td>&lt;b&gt;</td></tr>' AS rows FROM supplier"""),
    "source_geojson_bounds": query("""SELECT k.path, coalesce(west, 138) AS west, coalesce(south, 36) AS south, coalesce(east, 138) AS east, coalesce(north, 36) AS north
        FROM (SELECT id AS path FROM organization UNION ALL SELECT name FROM grp) k LEFT JOIN (SELECT CAST(s_nationkey AS VARCHAR) AS path, CAST(min(s_suppkey % 90) AS DOUBLE) AS west, CAST(min(s_suppkey % 45) AS DOUBLE) AS south,
        CAST(max(s_suppkey % 90) AS DOUBLE) AS east, CAST(max(s_suppkey % 45) AS DOUBLE) AS north FROM supplier GROUP BY 1) b ON b.path = k.path"""),
    "scalar_problems": query("""SELECT id, CASE WHEN CAST(id AS INTEGER) % 5 = 0 THEN 'name' WHEN CAST(id AS INTEGER) % 3 = 0 THEN 'url' WHEN CAST(id AS INTEGER) % 7 = 0 THEN 'author_email'
        WHEN CAST(id AS INTEGER) % 11 = 0 THEN 'owner_org' END AS problem FROM package_core"""),
    "scalar_escape": query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS text FROM pages"""),
    "scalar_local_date": query("SELECT id, coalesce(strftime(CAST(updated AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S'), '1970-01-01T00:00:00') AS shown FROM package"),
    "jobs_parsed": query("SELECT CAST(event_id AS VARCHAR) AS job_id, CASE event_id % 3 WHEN 0 THEN 'process-resource' ELSE 'health-check' END AS type, event_type AS data FROM events WHERE event_id % 10 <> 0 AND event_id % 3 <> 2"),
    "jobs_outcome": query("SELECT resource_id, CASE WHEN bool_or(step_name = 'fetch' AND status = 'error') THEN 'error' ELSE 'complete' END AS status, count(*) FILTER (WHERE status = 'error') AS failed_steps FROM step GROUP BY 1", _STEP),
    "content_chunk_totals": query("SELECT CAST(doc_id AS VARCHAR) AS resource_id, strlen(text) AS original, 1::BIGINT AS chunks, strlen(text) AS indexed FROM documents WHERE text IS NOT NULL"),
}
