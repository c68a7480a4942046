"""Scalar functions of the catalog as column expressions; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical format names and MIME types by lower-case extension.
FORMATS = {
    "csv": "CSV",
    "tsv": "TSV",
    "json": "JSON",
    "geojson": "GeoJSON",
    "xml": "XML",
    "xlsx": "XLSX",
    "xls": "XLS",
    "pdf": "PDF",
    "zip": "ZIP",
    "doc": "DOC",
    "docx": "DOCX",
    "ppt": "PPT",
    "pptx": "PPTX",
    "odt": "ODT",
    "odp": "ODP",
    "ods": "ODS",
    "rtf": "RTF",
    "txt": "TXT",
    "html": "HTML",
    "htm": "HTML",
    "rdf": "RDF",
}
MIME_TYPES = {
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "json": "application/json",
    "geojson": "application/geo+json",
    "xml": "application/xml",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "rtf": "application/rtf",
    "txt": "text/plain",
    "html": "text/html",
    "htm": "text/html",
    "rdf": "application/rdf+xml",
}
CSV_MIMES = ("text/csv", "application/csv", "text/tab-separated-values")
TEXT_FORMATS = ("txt", "text", "json", "geojson", "xml", "html", "htm", "md")
DOCUMENT_FORMATS = ("pdf", "docx", "xlsx", "pptx", "odt", "odp", "ods", "rtf")
OFFICE_FORMATS = ("xlsx", "xls", "doc", "docx", "ppt", "pptx")
CHARSETS = {"UTF8": "utf-8", "ASCII": "utf-8", "SJIS": "shift_jis", "EUCJP": "euc-jp", "JIS": "iso-2022-jp", "UNICODE": "utf-8"}
ROLE_RANKS = {"admin": 3, "editor": 2, "member": 1}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SLUG = r"^[a-z0-9._-]+$"


def _lookup(pairs: dict[str, str | int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def escape_like(text: str) -> str:
    """``text`` with the wildcards of LIKE escaped by a backslash."""
    return "".join("\\" + c if c in "%_\\" else c for c in text)


def contains(q: str, *columns: str) -> Column:
    """Whether any column holds ``q``, whatever the case; a null column doesn't."""
    pattern = f"%{escape_like(q)}%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return found


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def normalize_format(c: Column) -> Column:
    return F.coalesce(_lookup(FORMATS, F.lower(c)), F.upper(c))


def extension(filename: Column) -> Column:
    """What follows the last dot, in lower case; null without one, or if it comes first."""
    found = F.lower(F.regexp_extract(filename, r"(?s)^.+\.([^.]*)$", 1))
    return F.when(F.length(found) > 0, found)


def detect_format(filename: Column) -> Column:
    return normalize_format(extension(filename))


def mime_type(fmt: Column) -> Column:
    return _lookup(MIME_TYPES, F.lower(fmt))


def detect_content_type(filename: Column) -> Column:
    return F.coalesce(_lookup(MIME_TYPES, extension(filename)), F.lit("application/octet-stream"))


def is_csv(fmt: Column, mime: Column | None = None) -> Column:
    by_mime = F.lit(False) if mime is None else F.coalesce(F.lower(mime).isin(*CSV_MIMES), F.lit(False))
    return F.coalesce(F.lower(fmt).isin("csv", "tsv"), F.lit(False)) | by_mime


def is_text(fmt: Column) -> Column:
    return is_csv(fmt) | F.coalesce(F.lower(fmt).isin(*TEXT_FORMATS), F.lit(False))


def is_document(fmt: Column) -> Column:
    return F.coalesce(F.lower(fmt).isin(*DOCUMENT_FORMATS), F.lit(False))


def is_office(fmt: Column) -> Column:
    return F.coalesce(F.lower(fmt).isin(*OFFICE_FORMATS), F.lit(False))


def is_one(fmt: Column, name: str) -> Column:
    """The predicates for a single format: pdf, geojson, zip."""
    return F.coalesce(F.lower(fmt) == name, F.lit(False))


def content_class(fmt: Column) -> Column:
    """tabular, manifest, text or document, tried in this order; else null."""
    return F.when(is_csv(fmt), "tabular").when(is_one(fmt, "zip"), "manifest").when(is_text(fmt), "text").when(is_document(fmt), "document")


def charset(encoding: Column) -> Column:
    return F.coalesce(_lookup(CHARSETS, encoding), F.lit("utf-8"))


def storage_key(package: Column, resource: Column) -> Column:
    return F.concat(F.lit("resources/"), F.concat_ws("/", package, resource))


def preview_key(package: Column, resource: Column, ext: str = "parquet") -> Column:
    return F.concat(F.lit("previews/"), F.concat_ws("/", package, resource), F.lit(f".{ext}"))


def format_bytes(n: Column) -> Column:
    """1536 as "1.5 KB"; bytes without decimals; null for null or negative."""
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")])
    size = F.lit(0)
    for i in range(1, 6):
        size = F.when(n >= 1024**i, F.lit(i)).otherwise(size)
    scaled = n / F.pow(F.lit(1024.0), size)
    shown = F.when(size == 0, F.format_string("%d B", n.cast("long"))).otherwise(F.concat_ws(" ", F.format_string("%.1f", F.round(scaled, 1)), F.get(units, size)))
    return F.when(n >= 0, shown)


def parse_size(text: Column) -> Column:
    """Bytes of "12.5kb"; null where it isn't a size."""
    number = F.regexp_extract(F.lower(text), r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(b|kb|mb|gb|tb)\s*$", 1)
    unit = F.regexp_extract(F.lower(text), r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(b|kb|mb|gb|tb)\s*$", 2)
    power = _lookup({"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4}, unit)
    return F.round(F.nullif(number, F.lit("")).try_cast("double") * power).cast("long")


def parse_groups(text: Column) -> Column:
    """"name:title,…" as an array of (name, title); a title keeps later colons."""
    part = lambda s: F.struct(F.split(s, ":", 2)[0].alias("name"), F.coalesce(F.get(F.split(s, ":", 2), F.lit(1)), F.split(s, ":", 2)[0]).alias("title"))
    return F.when(F.length(text) > 0, F.transform(F.split(text, ","), part)).otherwise(F.array().cast("array<struct<name:string,title:string>>"))


def strip_tags_but_mark(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)</?(?!mark\b)[a-z][^>]*>", "")


def html_lines(text: Column) -> Column:
    """Lines without tags, white space collapsed, empty ones dropped; a tag that spans lines isn't stripped."""
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), r"\s+", " "))
    return F.filter(F.transform(F.split(text, "\n"), clean), lambda s: s != "")


def prefixed_sha256(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def json_merge(old: Column, new: Column) -> Column:
    """Shallow merge of JSON objects; null counts as {}; keys of ``new`` win."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = as_map(old), as_map(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def json_rows(text: Column) -> Column:
    """(key, value) of a JSON object without null and empty values."""
    return F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: e["value"].isNotNull() & (e["value"] != ""))


def role_rank(role: Column) -> Column:
    return F.coalesce(_lookup(ROLE_RANKS, role), F.lit(0))


def status_rank(status: Column) -> Column:
    return F.when(status == "processing", 0).when(status == "queued", 1).when(status == "pending", 2).when(status == "complete", 3).otherwise(4)


def health_rank(status: Column) -> Column:
    return F.when(status == "error", 0).when(F.coalesce(status, F.lit("unknown")) == "unknown", 1).otherwise(2)


def license_label(translated: Column, title: Column, raw: Column) -> Column:
    return F.coalesce(translated, title, raw)


def license_key(raw: Column) -> Column:
    return F.replace(raw, F.lit("."), F.lit("_"))


def plain_markdown(text: Column) -> Column:
    """Inline markdown as plain text: links, bold, italics and code marks go, entities are decoded."""
    out = text
    for pattern, to in ((r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1")):
        out = F.regexp_replace(out, pattern, to)
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(to))
    return out


def percent_encode(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def path_prefixes(path: Column) -> Column:
    """A path and all directories that it implies."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n))))


def header_changed(etag: Column, new_etag: Column, modified: Column, new_modified: Column) -> Column:
    """Both ETags decide where they are present; else both modification dates; else nothing changed."""
    by_date = F.when(modified.isNotNull() & new_modified.isNotNull(), modified != new_modified).otherwise(F.lit(False))
    return F.when(etag.isNotNull() & new_etag.isNotNull(), etag != new_etag).otherwise(by_date)


def valid_name(name: Column) -> Column:
    return F.coalesce(F.length(name).between(2, 100) & name.rlike(SLUG), F.lit(False))


def valid_email(c: Column) -> Column:
    """A local part of common characters without a dot at its ends or two in a row, and a domain with a top level of two letters or more."""
    local, domain = r"(?!\.)(?!.*\.\.)[A-Za-z0-9_'+.-]*[A-Za-z0-9_+-]", r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
    return F.coalesce(c.rlike(f"^{local}@{domain}$"), F.lit(False))


def valid_url(c: Column) -> Column:
    """A URL with a scheme and a host."""
    return F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(c, F.lit("HOST")).isNotNull()


def package_problem(name: Column, title: Column, url: Column, email: Column, owner: Column) -> Column:
    """The first field of a package that can't be accepted, or null; blank urls and emails count as not given."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(~valid_name(name), "name")
        .when(given(url) & ~valid_url(url), "url")
        .when(given(email) & ~valid_email(email), "author_email")
        .when(~F.coalesce(is_uuid(owner), F.lit(False)), "owner_org")
    )


def escape_html(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def local_date(time: Column) -> Column:
    """A time as text without a zone; the epoch where there is none."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("1970-01-01T00:00:00"))
