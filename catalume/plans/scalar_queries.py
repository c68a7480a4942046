"""Scalar functions, chunks, files and the job rules as queries over the tables, with oracles where SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions import text
from ..sources import files
from ..sources.catalog import Catalog
from ..streaming import jobs
from .views import query

_EXTENSIONS = ("csv", "GeoJSON", "htm", "parquet", "docx", "zip", "txt")
_FORMAT_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in s.FORMATS.items())
_MIME_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in s.MIME_TYPES.items())
_NAMED = "named AS (SELECT event_id, 'file-' || event_id || '.' || ['" + "', '".join(_EXTENSIONS) + "'][event_id % 7 + 1] AS filename, lower(['" + "', '".join(_EXTENSIONS) + "'][event_id % 7 + 1]) AS ext FROM events)"


def named(c: Catalog):
    ext = F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("event_id") % 7).cast("int"))
    return c.raw("events").select("event_id", F.concat(F.lit("file-"), F.col("event_id").cast("string"), F.lit("."), ext).alias("filename"))


def formats(c: Catalog):
    f = F.col("filename")
    found = s.detect_format(f)
    return named(c).select("event_id", s.extension(f).alias("extension"), found.alias("format"), s.detect_content_type(f).alias("mime"), s.content_class(found).alias("class"), s.is_office(found).alias("office"))


def html_lines(c: Catalog):
    return c.raw("pages").select("page_id", F.array_join(s.html_lines(F.col("html")), "\n").alias("text"))


def chunks(c: Catalog):
    docs = c.raw("documents").select(F.col("doc_id").cast("string").alias("resource_id"), F.col("source").alias("package_id"), F.lit("text").alias("content_type"), "text")
    return text.content_chunks(docs).select("resource_id", "chunk_index", "chunk_size")


def rate_limit(c: Catalog):
    events = c.raw("events").select("event_id", "user_id", "ts")
    return jobs.rate_limited(events, "user_id", "ts", 6 * 3600, "event_id").select("event_id", "accepted")


SPARK = {
    "scalar_formats": formats,
    "scalar_storage_keys": lambda c: c.resource.select("id", s.storage_key(F.col("package_id"), F.col("id")).alias("key"), s.preview_key(F.col("package_id"), F.col("id"), "json").alias("preview")),
    "scalar_sizes": lambda c: c.resource.select("id", s.format_bytes(F.col("size") * 37).alias("shown"), s.parse_size(F.concat(F.col("size").cast("string"), F.lit("kb"))).alias("parsed")),
    "scalar_hosts": lambda c: c.raw("pages").select("page_id", s.url_host(F.col("url")).alias("host")),
    "scalar_hashes": lambda c: c.raw("documents").select("doc_id", s.prefixed_sha256(F.col("text").cast("binary")).alias("hash"), F.octet_length("text").cast("long").alias("bytes")),
    "scalar_html_lines": html_lines,
    "scalar_strip_tags": lambda c: c.raw("documents").select("doc_id", "text").unionByName(c.raw("pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))).select("doc_id", s.strip_tags_but_mark(F.concat(F.lit("<p class='x'><mark>"), F.col("text"), F.lit("</mark></p>"))).alias("text")),
    "scalar_json": lambda c: c.raw("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object(s.json_merge(F.col("props"), F.lit('{"etag":"e1"}')), "$.etag").alias("etag")),
    "scalar_json_rows": lambda c: c.raw("events").select("event_id", F.explode(s.json_rows(F.col("props"))).alias("e")).select("event_id", "e.key", "e.value"),
    "scalar_groups": lambda c: c.grp.select("id", F.explode(s.parse_groups(F.concat("name", F.lit(":"), "title", F.lit(":x,plain")))).alias("g")).select("id", "g.name", "g.title"),
    "scalar_validity": lambda c: c.package_core.select("id", s.valid_name(F.col("name")).alias("ok_name"), s.valid_name(F.col("title")).alias("ok_title"), s.is_uuid(F.concat(F.substring(F.md5("id"), 1, 8), F.lit("-aaaa-bbbb-cccc-"), F.substring(F.md5("id"), 1, 12))).alias("uuid")),
    "scalar_ranks": lambda c: c.pipeline.select("resource_id", s.status_rank(F.col("status")).alias("rank")),
    "scalar_paths": lambda c: c.raw("pages").select("page_id", F.explode(s.path_prefixes(F.try_parse_url("url", F.lit("PATH")))).alias("node")),
    "source_lines": lambda c: files.split_lines(c.raw("documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("lines")),
    "source_row_range": lambda c: files.read_rows(c.raw("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("row_index", F.col("l_orderkey")), 100, 200).select("row_index", "n"),
    "content_chunks": chunks,
    "jobs_rate_limit": rate_limit,
    "jobs_latest_state": lambda c: jobs.latest_state(c.pipeline.withColumn("host", F.substring("metadata", -3, 2)), "host", "updated"),
    "jobs_steps": lambda c: jobs.steps_between(c.pipeline.withColumn("host", F.substring("metadata", -3, 2)), "host", "updated").groupBy("before", "status").agg(F.count("*").alias("n")),
}

SQL = {
    "scalar_formats": query(f"""SELECT event_id, ext AS extension, CASE ext {_FORMAT_CASES} ELSE upper(ext) END AS format,
        CASE ext {_MIME_CASES} ELSE 'application/octet-stream' END AS mime,
        CASE WHEN ext IN ('csv', 'tsv') THEN 'tabular' WHEN ext = 'zip' THEN 'manifest' WHEN ext IN ('geojson', 'htm', 'txt') THEN 'text' WHEN ext = 'docx' THEN 'document' END AS class,
        ext = 'docx' AS office FROM named""", _NAMED),
    "scalar_storage_keys": query("SELECT id, 'resources/' || package_id || '/' || id AS key, 'previews/' || package_id || '/' || id || '.json' AS preview FROM resource"),
    "scalar_hosts": query(r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages"),
    "scalar_hashes": query("SELECT doc_id, 'sha256:' || sha256(text) AS hash, strlen(text) AS bytes FROM documents"),
    "scalar_html_lines": query(r"""SELECT page_id, coalesce(array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda y: y <> ''), chr(10)), '') AS text FROM pages"""),
    "scalar_strip_tags": query("SELECT doc_id, '<mark>' || text || '</mark>' AS text FROM documents WHERE NOT regexp_matches(text, '<[a-zA-Z/]') UNION ALL SELECT page_id, '<mark>' || regexp_replace(html, '</?[a-zA-Z][^>]*>', '', 'g') || '</mark>' FROM pages"),
    "scalar_json": query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'e1' AS etag FROM events"),
    "scalar_json_rows": query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events"),
    "scalar_groups": query("SELECT id, name, title || ':x' AS title FROM grp UNION ALL SELECT id, 'plain', 'plain' FROM grp"),
    "scalar_validity": query("""SELECT id, regexp_matches(name, '^[a-z0-9._-]+$') AND length(name) BETWEEN 2 AND 100 AS ok_name, regexp_matches(title, '^[a-z0-9._-]+$') AS ok_title, true AS uuid FROM package_core"""),
    "scalar_ranks": query("SELECT resource_id, CAST(list_position(['processing', 'queued', 'pending', 'complete', 'error'], status) - 1 AS INTEGER) AS rank FROM pipeline"),
    "source_lines": query("SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS BIGINT) AS lines FROM documents WHERE text <> ''"),
    "source_row_range": query("SELECT l_orderkey AS row_index, count(*) AS n FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 200 GROUP BY 1"),
    "scalar_sizes": query("""SELECT id, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f', round(n / pow(1024, u), 1)) || ' ' || ['KB', 'MB', 'GB', 'TB'][u] END AS shown, size * 1024 AS parsed
        FROM (SELECT id, size, size * 37 AS n, CASE WHEN size * 37 >= 1099511627776 THEN 4 WHEN size * 37 >= 1073741824 THEN 3 WHEN size * 37 >= 1048576 THEN 2 ELSE 1 END AS u FROM resource)"""),
    "scalar_paths": query(r"""SELECT page_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS node
        FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS parts FROM pages)"""),
    "content_chunks": query("SELECT CAST(doc_id AS VARCHAR) AS resource_id, 0 AS chunk_index, CAST(strlen(text) AS INTEGER) AS chunk_size FROM documents WHERE text IS NOT NULL"),
    "jobs_rate_limit": """WITH RECURSIVE taken AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
        UNION ALL SELECT a.user_id, min(e.ts) FROM taken a JOIN events e ON e.user_id = a.user_id AND e.ts > a.ts + INTERVAL 6 HOURS GROUP BY a.user_id)
        SELECT event_id, t.ts IS NOT NULL AND row_number() OVER (PARTITION BY e.user_id, e.ts ORDER BY event_id) = 1 AS accepted FROM events e LEFT JOIN taken t ON t.user_id = e.user_id AND t.ts = e.ts""",
    "jobs_latest_state": query("""SELECT host, status, updated FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY updated DESC, status DESC) AS n FROM
        (SELECT *, substr(metadata, -3, 2) AS host FROM pipeline)) WHERE n = 1"""),
    "jobs_steps": query("""SELECT before, status, count(*) AS n FROM (SELECT status, lag(status) OVER (PARTITION BY substr(metadata, -3, 2) ORDER BY updated) AS before FROM pipeline) GROUP BY 1, 2"""),
}
