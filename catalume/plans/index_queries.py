"""Queries over kept indexes, fragments, chunks, documents after changes, and job states, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fragments, text
from ..functions import scalars as s
from ..operators import admin, incremental, listing, lookup, mutations, postings, ranked, search, transitions, trigrams
from ..sources import files
from ..sources.catalog import Catalog
from ..sources.shared import shared_path
from . import more_queries
from .views import query

ALL = search.Filters(allowed_orgs=None)
_KEPT: dict[tuple, object] = {}


def _once(c: Catalog, name: str, make):
    """What ``make`` writes for a session and a directory, made once."""
    key = (c.spark.sparkContext.applicationId, c.path, name)
    if key not in _KEPT:
        _KEPT[key] = make(shared_path(c.spark, name))
    return _KEPT[key]


# chunks

CHUNK_LIMIT = 2_000


def chunks_split(c: Catalog) -> DataFrame:
    """Every document in chunks of 2,000 bytes, by both accountings: long lines cut off, or kept whole."""
    docs = c.raw("documents").select(F.col("doc_id").cast("string").alias("resource_id"), F.col("source").alias("package_id"), F.lit("text").alias("content_type"), "text")
    parts = []
    for name, whole, last_break in (("cut off", False, True), ("whole", True, False)):
        found = text.content_chunks(docs, CHUNK_LIMIT, whole=whole, last_break=last_break)
        parts.append(found.select(F.lit(name).alias("accounting"), "resource_id", "chunk_index", "chunk_size", F.sha2("extracted_text", 256).alias("hash")))
    return parts[0].unionByName(parts[1])


_CHUNKS = f"""
    WITH RECURSIVE ways(accounting, keep, extra) AS (VALUES ('cut off', false, 0), ('whole', true, 1)),
    docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND strlen(text) > {CHUNK_LIMIT}),
    lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs)),
    sized AS (SELECT accounting, keep, extra, doc_id, i, line, strlen(line) + 1 AS size, strlen(line) + 1 - extra > {CHUNK_LIMIT} AS long FROM lines, ways),
    -- line by line: the number of the chunk that a line falls in, and what it holds so far
    walk AS (
        SELECT accounting, doc_id, i, 1 AS chunk, CASE WHEN long THEN 0 ELSE size END AS used, long FROM sized WHERE i = 1
        UNION ALL
        SELECT s.accounting, s.doc_id, s.i, w.chunk + CASE WHEN s.long OR w.long OR w.used + s.size - s.extra > {CHUNK_LIMIT} THEN 1 ELSE 0 END,
               CASE WHEN s.long THEN 0 WHEN w.long OR w.used + s.size - s.extra > {CHUNK_LIMIT} THEN s.size ELSE w.used + s.size END, s.long
        FROM walk w JOIN sized s ON s.accounting = w.accounting AND s.doc_id = w.doc_id AND s.i = w.i + 1),
    chars AS (SELECT accounting, keep, doc_id, i, k, substr(line, k, 1) AS ch, sum(strlen(substr(line, k, 1))) OVER (PARTITION BY accounting, doc_id, i ORDER BY k) AS upto
        FROM sized, LATERAL (SELECT unnest(range(1, length(line) + 1)) AS k) WHERE long),
    -- a long line is cut where the next character would go beyond the limit
    cuts AS (
        SELECT accounting, keep, doc_id, i, 0 AS piece, 0::HUGEINT AS since, (SELECT max(upto) FROM chars c WHERE c.accounting = s.accounting AND c.doc_id = s.doc_id AND c.i = s.i AND c.upto <= {CHUNK_LIMIT}) AS upto
        FROM sized s WHERE long
        UNION ALL
        SELECT p.accounting, p.keep, p.doc_id, p.i, p.piece + 1, p.upto, (SELECT max(upto) FROM chars c WHERE c.accounting = p.accounting AND c.doc_id = p.doc_id AND c.i = p.i AND c.upto <= p.upto + {CHUNK_LIMIT})
        FROM cuts p WHERE p.keep AND p.upto < (SELECT max(upto) FROM chars c WHERE c.accounting = p.accounting AND c.doc_id = p.doc_id AND c.i = p.i)),
    parts AS (
        SELECT w.accounting, w.doc_id, w.chunk, 0 AS piece, string_agg(s.line, chr(10) ORDER BY s.i) AS part FROM walk w JOIN sized s ON s.accounting = w.accounting AND s.doc_id = w.doc_id AND s.i = w.i
        WHERE NOT w.long GROUP BY ALL
        UNION ALL
        SELECT w.accounting, w.doc_id, w.chunk, p.piece, (SELECT string_agg(ch, '' ORDER BY k) FROM chars c WHERE c.accounting = p.accounting AND c.doc_id = p.doc_id AND c.i = p.i AND c.upto > p.since AND c.upto <= p.upto)
        FROM walk w JOIN cuts p ON p.accounting = w.accounting AND p.doc_id = w.doc_id AND p.i = w.i WHERE w.long
        UNION ALL
        SELECT accounting, doc_id, 1, 0, text FROM documents, ways WHERE text IS NOT NULL AND strlen(text) <= {CHUNK_LIMIT})
    SELECT accounting, CAST(doc_id AS VARCHAR) AS resource_id, CAST(row_number() OVER (PARTITION BY accounting, doc_id ORDER BY chunk, piece) - 1 AS INTEGER) AS chunk_index,
           CAST(strlen(part) AS INTEGER) AS chunk_size, sha256(part) AS hash FROM parts
"""

# the kept index


def kept_index(c: Catalog) -> ranked.SearchIndex:
    return _once(c, "index", lambda path: ranked.write_index(c, path, c.content_lines))


def index_page(c: Catalog, q: str) -> DataFrame:
    return more_queries._shown(ranked.ranked_page(c, q, ALL, 0, 50, c.content_lines, kept_index(c)))


TITLES = ("人口統計データ", "気象観測の記録", "東京都の公園一覧", "道路交通量 2024", "予算書 Budget", "東京の人口とデータ")
NOTES = ("東京都が公開する人口統計です。毎年、人口を数えます。", "A Budget of the city, 予算の詳細。", "公園と道路。")
JAPANESE_Q = ("人口統計", "東京 人口", "園", "budget 予算", "データ")


def japanese(c: Catalog) -> DataFrame:
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("id").cast("long") % n).cast("int"))
    return c.package_core.select("id", F.concat_ws(" ", pick(TITLES, len(TITLES)), "name").alias("title"), pick(NOTES, 4).alias("notes"))


def japanese_scan(c: Catalog) -> DataFrame:
    parts = [ranked.bm25(japanese(c), q, {"title": 3.0, "notes": 1.0}).select(F.lit(q).alias("q"), "id", F.round("score", 4).alias("score")) for q in JAPANESE_Q]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _written(c: Catalog, name: str, made) -> DataFrame:
    def make(path: str) -> DataFrame:
        postings.write_postings(made(), path)
        return postings.read_postings(c.spark, path)

    return _once(c, name, make)


def japanese_index(c: Catalog) -> DataFrame:
    held = _written(c, "japanese", lambda: postings.postings_of(japanese(c), "id", ["title", "notes"]))
    return _union([postings.search(held, q, {"title": 3.0, "notes": 1.0}).select(F.lit(q).alias("q"), "id", F.round("score", 4).alias("score")) for q in JAPANESE_Q])


def index_after_changes(c: Catalog) -> DataFrame:
    """Every seventh title changes, every fifth document goes; the others' postings stay as they are."""
    held = _written(c, "japanese", lambda: postings.postings_of(japanese(c), "id", ["title", "notes"]))
    changed = japanese(c).where("id % 7 = 0 AND id % 5 <> 0").withColumn("title", F.lit("東京湾の港"))
    new = postings.replaced(held, postings.postings_of(changed, "id", ["title", "notes"]), japanese(c).where("id % 5 = 0"))
    return _union([postings.search(new, q, {"title": 3.0, "notes": 1.0}).select(F.lit(q).alias("q"), "id", F.round("score", 4).alias("score")) for q in ("東京", "港")])


def _pick(values, n: int) -> str:
    return f"[{', '.join(repr(v) for v in values)}{', NULL' * (n - len(values))}][CAST(id AS BIGINT) % {n} + 1]"


_JAPANESE = f"japanese AS (SELECT id, concat_ws(' ', {_pick(TITLES, len(TITLES))}, name) AS title, {_pick(NOTES, 4)} AS notes FROM package_core)"
_CHANGED = f"""{_JAPANESE}, changed AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN '東京湾の港' ELSE title END AS title, notes FROM japanese WHERE CAST(id AS BIGINT) % 5 <> 0)"""


def dense_bm25_sql(table: str, asked: list[tuple[str, bool]]) -> str:
    """BM25 of title and notes where words of dense scripts are found as they stand: (id, score)."""
    script = "[\\p{Han}\\p{Hiragana}\\p{Katakana}ー]"
    plain = lambda f: f"regexp_extract_all(regexp_replace(lower(coalesce({f}, '')), '{script}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')"

    def tf(f: str, t: str, dense: bool) -> str:
        if not dense:
            return f"len(list_filter({plain(f)}, lambda w: w = '{t}'))"
        return f"len(list_filter(range(1, length(coalesce({f}, '')) + 1), lambda i: substr(coalesce({f}, ''), i, {len(t)}) = '{t}'))"

    fields = {"title": 3.0, "notes": 1.0}
    columns = [f"len(regexp_extract_all(coalesce({f}, ''), '{script}')) + len({plain(f)}) AS len_{f}" for f in fields]
    columns += [f"{tf(f, t, d)} AS tf_{f}_{i}" for f in fields for i, (t, d) in enumerate(asked)]
    stats = ["count(*) AS n", *[f"avg(len_{f}) AS mean_{f}" for f in fields], *[f"greatest({', '.join(f'count(*) FILTER (WHERE tf_{f}_{i} > 0)' for f in fields)}) AS d_{i}" for i in range(len(asked))]]
    parts = []
    for i in range(len(asked)):
        idf = f"ln(1 + (n - d_{i} + 0.5) / (d_{i} + 0.5))"
        parts.append("greatest(" + ", ".join(f"{b} * {idf} * tf_{f}_{i} / (tf_{f}_{i} + 1.2 * (0.25 + 0.75 * len_{f} / mean_{f}))" for f, b in fields.items()) + ")")
    return f"(WITH cut AS (SELECT id, {', '.join(columns)} FROM {table}), stats AS (SELECT {', '.join(stats)} FROM cut) SELECT id, {' + '.join(parts)} AS score FROM cut, stats WHERE {' AND '.join(p + ' > 0' for p in parts)})"


def _japanese_sql(table: str, more: str, queries: dict[str, list[tuple[str, bool]]]) -> str:
    return query(" UNION ALL ".join(f"SELECT '{q}' AS q, id, round(score, 4) AS score FROM {dense_bm25_sql(table, asked)}" for q, asked in queries.items()), more)


_ASKED = {"人口統計": [("人口統計", True)], "東京 人口": [("東京", True), ("人口", True)], "園": [("園", True)], "budget 予算": [("budget", False), ("予算", True)], "データ": [("データ", True)]}

# fragments

FRAGMENT_Q, FRAGMENT = "the and", 120


def shown_fragments(c: Catalog) -> DataFrame:
    found = c.raw("documents").select("doc_id", fragments.fragment(F.col("text"), FRAGMENT_Q, FRAGMENT).alias("f")).where("f IS NOT NULL")
    return found.select("doc_id", "f.n", "f.start", F.sha2("f.fragment", 256).alias("hash"))


def fetched_highlights(c: Catalog) -> DataFrame:
    """The chunks of one page of results, which is at most 200."""
    return ranked.fetch_highlights(c.content, [f"{i}_chunk_0" for i in range(200)], FRAGMENT_Q)


def resource_marks(c: Catalog) -> DataFrame:
    matched = ranked.resource_leg(c.resource.where("state = 'active'"), "urgent", None).select("package_id", F.col("id").alias("resource_id"))
    return ranked.resource_highlights(matched, c.resource, "urgent order").select("resource_id", "highlighted_name", "highlighted_description")


def _fragments_sql(size: int, where: str = "true") -> str:
    return f"""pieces AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS ps FROM documents WHERE {where})),
        ended AS (SELECT *, lower(piece) IN ('the', 'and') AS hit, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM pieces),
        told AS (SELECT *, stop - length(piece) AS start FROM ended),
        -- every hit has three characters
        counted AS (SELECT doc_id, start AS since, count(*) OVER w AS n, max(stop) OVER w AS upto FROM told WHERE hit WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {size - 3} FOLLOWING)),
        best AS (SELECT doc_id, n, greatest(0, since - CAST(floor(({size} - (upto - since)) / 2.0) AS BIGINT)) AS start FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, since) = 1),
        shown AS (SELECT b.doc_id, b.n, b.start, string_agg(CASE WHEN hit AND t.start >= b.start AND stop <= b.start + {size} THEN '<mark>' || piece || '</mark>'
                ELSE substr(piece, CAST(greatest(b.start - t.start, 0) + 1 AS BIGINT), CAST(least(stop, b.start + {size}) - greatest(t.start, b.start) AS BIGINT)) END, '' ORDER BY i) AS fragment
            FROM best b JOIN told t ON t.doc_id = b.doc_id AND t.stop > b.start AND t.start < b.start + {size} GROUP BY ALL)"""


# documents after changes

_DOCUMENT = ["id", "title", "organization", "formats", "resource_count", "tags", "groups"]


def changed_catalog(c: Catalog) -> tuple[Catalog, dict[str, DataFrame]]:
    """An organization gets another name, some packages another title or state, some resources and tags go."""
    number = F.col("id").cast("long")
    lost = (F.col("package_id").cast("long") % 59 == 0) & (F.col("tag") == "Brand#1")
    after = incremental.with_tables(
        c,
        organization=c.organization.withColumn("name", F.when(F.col("id") == "3", "renamed").otherwise(F.col("name"))),
        package_core=c.package_core.withColumn("title", F.when(number % 50 == 7, F.concat(F.lit("Changed "), "title")).otherwise(F.col("title"))).withColumn("state", F.when(number % 53 == 0, "deleted").otherwise(F.col("state"))),
        resource=c.resource.withColumn("state", F.when(number % 211 == 0, "deleted").otherwise(F.col("state"))),
        package_tag=c.package_tag.where(~lost),
    )
    changes = {
        "organization": c.organization.where("id = '3'"),
        "package": c.package_core.where((number % 50 == 7) | (number % 53 == 0)),
        "resource": c.resource.where(number % 211 == 0),
        "package_tag": c.package_tag.where(lost),
    }
    return after, changes


def documents_after_changes(c: Catalog) -> DataFrame:
    after, changes = changed_catalog(c)
    return incremental.rebuilt(listing.package_documents(c).select(*_DOCUMENT), c, after, changes)


def documents_affected(c: Catalog) -> DataFrame:
    """Which packages a change of a tag, a group or an organization touches."""
    changes = {"tag": c.tag.where("tag = 'Brand#7'"), "grp": c.grp.where("id = '2'"), "organization": c.organization.where("id IN ('1', '24')")}
    return _union([incremental.affected(c, c, {kind: rows}).select(F.lit(kind).alias("kind"), "id") for kind, rows in changes.items()])


_AFTER = """organization_b AS (SELECT id, CASE WHEN id = '3' THEN 'renamed' ELSE name END AS name FROM organization),
    package_b AS (SELECT id, owner_org, CASE WHEN CAST(id AS BIGINT) % 50 = 7 THEN 'Changed ' || title ELSE title END AS title, CASE WHEN CAST(id AS BIGINT) % 53 = 0 THEN 'deleted' ELSE state END AS state FROM package_core),
    resource_b AS (SELECT package_id, format, CASE WHEN CAST(id AS BIGINT) % 211 = 0 THEN 'deleted' ELSE state END AS state FROM resource),
    tag_b AS (SELECT * FROM package_tag WHERE NOT (CAST(package_id AS BIGINT) % 59 = 0 AND tag = 'Brand#1'))"""

# job states


def job_log(c: Catalog) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "click", "step").when(kind == "signup", "queued").when(kind == "view", "processing").when(kind == "purchase", "complete").otherwise("error")
    return c.raw("events").select("event_id", F.col("user_id").alias("job"), "ts", event.alias("event"))


def job_transitions(c: Catalog) -> DataFrame:
    return transitions.transitions(job_log(c), "job", "ts", "event_id")


_JOBS = """WITH RECURSIVE log AS (SELECT event_id, user_id AS job, CASE event_type WHEN 'click' THEN 'step' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'complete' ELSE 'error' END AS event,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    walk AS (SELECT job, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS event, 'none' AS before, false AS accepted, 'none' AS after FROM (SELECT DISTINCT job FROM log)
        UNION ALL
        SELECT l.job, l.n, l.event_id, l.event, w.after, x.ok, CASE WHEN x.ok AND l.event <> 'step' THEN l.event ELSE w.after END
        FROM walk w JOIN log l ON l.job IS NOT DISTINCT FROM w.job AND l.n = w.n + 1,
        LATERAL (SELECT CASE l.event WHEN 'queued' THEN w.after IN ('none', 'pending', 'complete', 'error') WHEN 'processing' THEN w.after IN ('pending', 'queued', 'processing') ELSE w.after = 'processing' END AS ok) x),
    told AS (SELECT * FROM walk WHERE n > 0)"""

# grams

GRAM_Q = ("1", "er", "#00", "machinery cust", "%", "_0", "CUSTOMER-000000007")


def by_grams(c: Catalog) -> DataFrame:
    own = c.package_core.select("id", "name", "title")

    def make(path: str) -> DataFrame:
        trigrams.write_grams(trigrams.grams(own, "id", ["name", "title"]), path)
        return trigrams.read_grams(c.spark, path)

    held = _once(c, "grams", make)
    return _union([trigrams.containing(own, held, q, "id", ["name", "title"]).select(F.lit(q).alias("q"), "id") for q in GRAM_Q])


# files


def preview_rows(c: Catalog) -> DataFrame:
    """Rows 3 to 5 of every file's table, from previews of two rows a page."""

    def make(path: str) -> str:
        cells = files.extract_tables(files.with_encoding(more_queries._csv(c))).where("error IS NULL")
        files.write_preview(cells.select("path", "row_index", F.array_join("cells", "|").alias("cells")), path, 2)
        return path

    return files.read_rows(c.spark.read.parquet(_once(c, "preview", make)), 3, 6, 2)


NAMES = ("Äpfel", "apfel", "Zebra", "éclair", "eclair", "Eclair", "file-10", "file-2", "b c", "bc", "Apfel")


def tree_places(c: Catalog) -> DataFrame:
    pick = lambda n: F.get(F.array(*[F.lit(v) for v in NAMES]), (n % len(NAMES)).cast("int"))
    name = F.when(F.col("l_linenumber") % 3 == 0, F.concat(pick(F.col("l_suppkey")), F.lit("/"), pick(F.col("l_partkey")))).otherwise(pick(F.col("l_partkey")))
    entries = c.raw("lineitem").select((F.col("l_orderkey") % 97).cast("string").alias("path"), name.alias("name"), F.lit(False).alias("is_directory"))
    return files.placed(files.path_tree(entries)).select("path", "node", "is_directory", F.col("place").cast("int").alias("place"))


def titled_tables(c: Catalog) -> DataFrame:
    """Tables with a title row, a header with a blank and a repeated name, tabs between cells, and a footer."""
    line = F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.lit("x"), F.lit("y"))
    body = c.raw("nation").groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda r: r["l"]), "\n").alias("b"))
    content = F.encode(F.concat(F.lit("人口の表\t\t\t\nkey\t\tname\tName\n"), "b", F.lit("\n出典: 統計局\t\t\t\n")), "UTF-8")
    cells = files.extract_tables(files.with_encoding(body.select("path", content.alias("content"))))
    return cells.select("path", F.col("row_index").cast("long").alias("row_index"), F.array_join("columns", "|").alias("names"), F.array_join("cells", "|").alias("cells"))


def small_functions(c: Catalog) -> DataFrame:
    """Charsets, license labels, markdown, encoded names and upload hashes, over packages."""
    number = F.col("id").cast("long") % 4
    enc = F.get(F.array(*[F.lit(x) for x in ("SJIS", "EUCJP", "UTF8", "other")]), number.cast("int"))
    mark = F.concat(F.lit("**"), "title", F.lit("** [link](u) `code` &lt;b&gt; &amp;amp;"))
    return c.package_core.select(
        "id",
        s.charset(enc).alias("charset"),
        s.license_label(F.when(number == 0, F.lit("translated")), F.when(number == 1, F.col("title")), F.col("license_id")).alias("label"),
        s.license_key(F.concat(F.col("license_id"), F.lit("-2.0.1"))).alias("key"),
        s.plain_markdown(mark).alias("plain"),
        s.percent_encode(F.concat(F.col("title"), F.lit(" ü/表.csv"))).alias("encoded"),
        files.upload_hash(F.when(number == 2, F.lit("sha256:old")), F.col("title").cast("binary")).alias("hash"),
    )


def licenses(c: Catalog) -> DataFrame:
    """Packages with the titles of their licenses, whatever the case of the id; an unknown one is its own title."""
    given = F.get(F.array(*[F.lit(x) for x in ("CC-BY-4.0", "odbl-1.0", "NOTSPECIFIED", "house-rules", "gjstu-2.0")]), (F.col("id").cast("long") % 5).cast("int"))
    return lookup.with_license(c.package_core.select("id", given.alias("license_id")))


SPARK = {
    "content_chunks_split": chunks_split,
    "ranked_index_page": lambda c: index_page(c, "1"),
    "ranked_index_page_by_tag": lambda c: index_page(c, "Brand#1"),
    "ranked_japanese": japanese_scan,
    "ranked_index_japanese": japanese_index,
    "ranked_index_after_changes": index_after_changes,
    "ranked_fragments": shown_fragments,
    "ranked_fetch_highlights": fetched_highlights,
    "ranked_resource_highlights": resource_marks,
    "documents_after_changes": documents_after_changes,
    "documents_affected": documents_affected,
    "jobs_transitions": lambda c: job_transitions(c).select("event_id", "before", "accepted", "after"),
    "jobs_status": lambda c: transitions.current(job_transitions(c), "job"),
    "jobs_steps_kept": lambda c: transitions.steps_kept(job_transitions(c), "job").select("job", "event_id"),
    "search_by_grams": by_grams,
    "source_preview_rows": preview_rows,
    "source_tree_places": tree_places,
    "source_tables_titled": titled_tables,
    "scalar_small": small_functions,
    "lookup_licenses": licenses,
    "lookup_chunk_listing": lambda c: admin.chunk_listing(c.content_lines, "17").select("resource_id", "chunk_index", "chunk_size"),
    "search_organization_ids": lambda c: search.organization_ids(c, "3"),
    "change_reorder": lambda c: mutations.reorder(c.resource_positions.where("package_id = '7'").select("id", F.col("position").cast("int").alias("position")), [r.id for r in c.resource_positions.where("package_id = '7'").orderBy(F.desc("position")).select("id").limit(100).collect()]),
}

_TREE_NAME = "[" + ", ".join(f"'{n}'" for n in NAMES) + f"][{{0}} % {len(NAMES)} + 1]"

SQL = {
    "content_chunks_split": _CHUNKS,
    "ranked_index_page": more_queries.page_sql("1", ["1"]),
    "ranked_index_page_by_tag": more_queries.page_sql("Brand#1", ["brand", "1"]),
    "ranked_japanese": _japanese_sql("japanese", _JAPANESE, _ASKED),
    "ranked_index_japanese": _japanese_sql("japanese", _JAPANESE, _ASKED),
    "ranked_index_after_changes": _japanese_sql("changed", _CHANGED, {"東京": [("東京", True)], "港": [("港", True)]}),
    "ranked_fragments": f"WITH {_fragments_sql(FRAGMENT)} SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(start AS INTEGER) AS start, sha256(fragment) AS hash FROM shown",
    "ranked_fetch_highlights": f"WITH {_fragments_sql(300, 'doc_id BETWEEN 0 AND 199')} SELECT doc_id || '_chunk_0' AS chunk_id, fragment FROM shown",
    "ranked_resource_highlights": query("""SELECT id AS resource_id, '<mark>order</mark>' || substr(name, 6) AS highlighted_name, replace(description, 'URGENT', '<mark>URGENT</mark>') AS highlighted_description
        FROM resource WHERE state = 'active' AND description ILIKE '%urgent%'"""),
    "documents_after_changes": query("""SELECT p.id, p.title, o.name AS organization,
        coalesce((SELECT string_agg(DISTINCT upper(format), ',' ORDER BY upper(format)) FROM resource_b r WHERE r.package_id = p.id AND state = 'active' AND format <> ''), '') AS formats,
        (SELECT count(*) FROM resource_b r WHERE r.package_id = p.id AND state = 'active') AS resource_count,
        coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM tag_b t WHERE t.package_id = p.id), '') AS tags,
        coalesce((SELECT string_agg(g.name || ':' || g.title, ',' ORDER BY g.name || ':' || g.title) FROM package_group x JOIN grp g ON g.id = x.group_id WHERE x.package_id = p.id), '') AS groups
        FROM package_b p LEFT JOIN organization_b o ON o.id = p.owner_org WHERE p.state = 'active'""", _AFTER),
    "documents_affected": query("""SELECT 'tag' AS kind, package_id AS id FROM package_tag WHERE tag = 'Brand#7' UNION ALL SELECT 'grp', package_id FROM package_group WHERE group_id = '2'
        UNION ALL SELECT 'organization', id FROM package_core WHERE owner_org IN ('1', '24')"""),
    "jobs_transitions": f"{_JOBS} SELECT event_id, before, accepted, after FROM told",
    "jobs_status": f"{_JOBS} SELECT job, arg_max(after, n) AS status, count(*) FILTER (WHERE NOT accepted) AS illegal FROM told GROUP BY job",
    "jobs_steps_kept": f"{_JOBS} SELECT t.job, t.event_id FROM told t WHERE accepted AND event = 'step' AND n > (SELECT max(n) FROM told u WHERE u.job = t.job AND u.accepted AND u.event = 'processing')",
    "search_by_grams": query(" UNION ALL ".join(f"SELECT '{q}' AS q, id FROM package_core WHERE contains(lower(name), '{q.lower()}') OR contains(lower(title), '{q.lower()}')" for q in GRAM_Q)),
    "source_preview_rows": """SELECT CAST(o_custkey AS VARCHAR) AS path, row_index, o_orderkey || '|' || o_orderpriority || ', x|' || o_orderstatus AS cells
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_index FROM orders) WHERE row_index BETWEEN 3 AND 5""",
    "source_tree_places": f"""WITH entries AS (SELECT CAST(l_orderkey % 97 AS VARCHAR) AS path, CASE WHEN l_linenumber % 3 = 0 THEN {_TREE_NAME.format('l_suppkey')} END AS dir, {_TREE_NAME.format('l_partkey')} AS name FROM lineitem),
        nodes AS (SELECT path, coalesce(dir || '/', '') || name AS node, coalesce(dir, '') AS parent, name, false AS is_directory FROM entries UNION ALL SELECT path, dir, '', dir, true FROM entries WHERE dir IS NOT NULL),
        known AS (SELECT path, node, parent, name, bool_or(is_directory) AS is_directory FROM nodes GROUP BY ALL)
        SELECT path, node, is_directory, CAST(row_number() OVER (PARTITION BY path, parent ORDER BY is_directory DESC, name COLLATE de, name) AS INTEGER) AS place FROM known""",
    "source_tables_titled": """SELECT CAST(n_regionkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_index, 'key|column_1|name|Name_2' AS names,
        n_nationkey || '|' || n_name || '|x|y' AS cells FROM nation""",
    "scalar_small": query("""SELECT id, ['shift_jis', 'euc-jp', 'utf-8', 'utf-8'][CAST(id AS BIGINT) % 4 + 1] AS charset,
        CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'translated' WHEN 1 THEN title ELSE license_id END AS label, license_id || '-2_0_1' AS key, title || ' link code <b> &amp;' AS plain,
        url_encode(title || ' ü/表.csv') AS encoded, CASE WHEN CAST(id AS BIGINT) % 4 = 2 THEN 'sha256:old' ELSE 'sha256:' || sha256(title) END AS hash FROM package_core"""),
    "lookup_licenses": query("""SELECT p.id, g.license_id, coalesce(l.title, g.license_id) AS license_title, l.url AS license_url FROM package_core p,
        LATERAL (SELECT ['CC-BY-4.0', 'odbl-1.0', 'NOTSPECIFIED', 'house-rules', 'gjstu-2.0'][CAST(p.id AS BIGINT) % 5 + 1] AS license_id) g
        LEFT JOIN (VALUES ('cc-by-4.0', 'Creative Commons Attribution 4.0', 'https://creativecommons.org/licenses/by/4.0/'),
            ('odbl-1.0', 'Open Data Commons Open Database License 1.0', 'https://opendefinition.org/licenses/odc-odbl'), ('notspecified', 'License Not Specified', ''),
            ('gjstu-2.0', 'Government of Japan Standard Terms of Use (Version 2.0)', 'https://www.kantei.go.jp/jp/singi/it2/densi/kettei/gl2_betten_1.pdf')) l(id, title, url) ON l.id = lower(g.license_id)"""),
    "lookup_chunk_listing": """SELECT CAST(doc_id AS VARCHAR) AS resource_id, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(strlen(line) AS INTEGER) AS chunk_size
        FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id = 17)) WHERE i <= 100""",
    "search_organization_ids": query("SELECT organization_id FROM membership WHERE user_id = '3'"),
    "change_reorder": query("""SELECT id, CAST(CASE WHEN n <= 100 THEN n - 1 ELSE position END AS INTEGER) AS position
        FROM (SELECT id, position, row_number() OVER (ORDER BY position DESC) AS n FROM resource_positions WHERE package_id = '7')"""),
}
