"""Queries over whole files that are made from the tables: archives, office texts, other encodings, previews; and counts of what a change touched."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.batches import batched, rows_of
from ..operators import incremental, listing, lookup, mutations
from ..sources import files
from ..sources.catalog import Catalog
from . import index_queries, more_queries
from .views import query

PREVIEW_BYTES = 100
CODECS = ("ascii", "utf-8", "cp932", "euc_jp", "iso2022_jp")


def _files(c: Catalog, write) -> DataFrame:
    """(path, content, format): a file for each document, by ``write(doc_id, text)``."""

    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("format", pa.string())])

    def make(batches):
        return batched(((str(doc), *write(int(doc), text or "")) for doc, text in rows_of(batches, ["doc_id", "text"])), schema)

    return c.raw("documents").select("doc_id", "text").mapInArrow(make, "path string, content binary, format string")


def _archive(doc: int, text: str) -> tuple[bytes, str]:
    """A folder, and a file for each line."""
    data, when = io.BytesIO(), (1980 + doc % 40, 1 + doc % 12, 1 + doc % 28, 10, doc % 60, 30)
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(zipfile.ZipInfo(f"{doc % 5}/", when), "")
        for i, line in enumerate(text.split("\n"), 1):
            z.writestr(zipfile.ZipInfo(f"{doc % 5}/行{i}.txt", when), line)
    return data.getvalue(), "zip"


def _office(doc: int, text: str) -> tuple[bytes, str]:
    """Every second document as paragraphs in XML, the others as RTF."""
    if doc % 2 == 0:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", "<w:body>" + "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n")) + "</w:body>")
        return data.getvalue(), "docx"
    shown = text.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}").replace("\n", "\\par\n")
    units = lambda ch: [int.from_bytes(ch.encode("utf-16-le")[i : i + 2], "little", signed=True) for i in range(0, len(ch.encode("utf-16-le")), 2)]
    body = "".join(ch if ord(ch) < 128 else "".join(f"\\u{u}?" for u in units(ch)) for ch in shown)
    return ("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}{\\*\\generator made;}\\f0 " + body + "\\par}").encode(), "rtf"


def zipped(c: Catalog) -> DataFrame:
    return files.zip_entries(_files(c, _archive))


@F.pandas_udf(BinaryType())
def _encoded(text: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([t.encode(k) for t, k in zip(text, codec, strict=True)])


def _codec(number, codecs=CODECS):
    return F.get(F.array(*[F.lit(k) for k in codecs]), (number % len(codecs)).cast("int"))


def _encoded_files(df: DataFrame) -> DataFrame:
    """(path, content) of texts (path, text, codec), each encoded once.

    As a step of its own: a column by ``_encoded`` is put in place of its name wherever that is used, and encoded there anew.
    """
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def make(batches):
        return batched(((path, text.encode(codec)) for path, text, codec in rows_of(batches, ["path", "text", "codec"])), schema)

    return df.select("path", "text", "codec").mapInArrow(make, "path string, content binary")


def reencoded(c: Catalog) -> DataFrame:
    """Titles with Japanese words in each encoding, told and decoded again."""
    number = F.col("id").cast("long")
    text = F.when(number % 5 == 0, F.col("title")).otherwise(F.concat(F.lit("人口統計データの一覧 "), "title", F.lit(" これは東京都の公園です。")))
    made = c.package_core.select(F.col("id").alias("path"), _encoded(text, _codec(number)).alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    told = files.with_encoding(made)
    return files.text_preview(told).join(told.select("path", "encoding"), "path").select("path", "encoding", "charset", "text", "truncated")


def reencoded_tables(c: Catalog) -> DataFrame:
    """Orders of each customer as a table in one of four encodings: a title row, Japanese names, cells with commas, a footer."""
    plain = more_queries._csv(c).select("path", F.decode("content", "UTF-8").alias("t"))
    text = F.concat(F.lit("注文の一覧表です,,\n"), F.replace("t", F.lit("key,priority,status"), F.lit("番号,優先度の名前,状態")))
    made = _encoded_files(plain.select("path", text.alias("text"), _codec(F.col("path").cast("long"), CODECS[1:]).alias("codec")))
    cells = files.extract_tables(files.with_encoding(made))
    return cells.select("path", F.col("row_index").cast("long").alias("row_index"), F.array_join("columns", "|").alias("names"), F.array_join("cells", "|").alias("cells"))


def previews(c: Catalog) -> DataFrame:
    """The first bytes of every document, also where they end within a character."""
    return files.text_preview(files.with_encoding(more_queries._objects(c)), limit=PREVIEW_BYTES)


def reset_counts(c: Catalog) -> DataFrame:
    """How many rows each table has once all but the users are gone."""
    tables = {"user": c.user, "package": c.package_core, "resource": c.resource, "package_tag": c.package_tag, "package_group": c.package_group, "pipeline": c.pipeline}
    return lookup.index_counts(**mutations.reset(tables))


def touched_counts(c: Catalog) -> DataFrame:
    """How many documents a change of the catalog makes anew and takes away, and how many jobs and steps a restart touches."""
    after, changes = index_queries.changed_catalog(c)
    ids = incremental.affected(c, after, changes)
    stored = listing.package_documents(c).select("id").join(ids, "id", "left_semi")
    new = listing.package_documents(incremental.restricted(after, ids)).select("id")
    asked = more_queries._asked(c)
    return lookup.index_counts(written=new, removed=stored.join(new, "id", "left_anti"), queued=asked, steps_gone=c.step.join(asked.select(F.col("id").alias("resource_id")), "resource_id", "left_semi"))


SPARK = {
    "source_zip_entries": zipped,
    "source_zip_manifests": lambda c: files.zip_manifest(zipped(c), 10),
    "source_zip_tree": lambda c: files.placed(files.path_tree(zipped(c))).select("path", "node", "is_directory", F.col("place").cast("int").alias("place")),
    "source_office_texts": lambda c: files.document_texts(_files(c, _office)).select("path", F.sha2("text", 256).alias("hash"), "error"),
    "source_reencoded": reencoded,
    "source_reencoded_tables": reencoded_tables,
    "source_preview_cut": previews,
    "change_reset_counts": reset_counts,
    "lookup_touched_counts": touched_counts,
}

_ENTRIES = """lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    entries AS (SELECT doc_id, doc_id % 5 || '/行' || i || '.txt' AS name, strlen(line) AS size, false AS is_directory FROM lines UNION ALL SELECT doc_id, doc_id % 5 || '/', 0, true FROM documents)"""

SQL = {
    "source_zip_entries": query("""SELECT CAST(doc_id AS VARCHAR) AS path, name, CAST(size AS BIGINT) AS size, CAST(size AS BIGINT) AS compressed_size,
        printf('%04d-%02d-%02dT10:%02d:30', 1980 + doc_id % 40, 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 60) AS last_modified, is_directory FROM entries""", _ENTRIES),
    "source_zip_manifests": query("""SELECT CAST(doc_id AS VARCHAR) AS path, count(*) FILTER (WHERE NOT is_directory) AS files, CAST(sum(size) AS BIGINT) AS size, CAST(sum(size) AS BIGINT) AS compressed, count(*) > 10 AS truncated
        FROM entries GROUP BY doc_id""", _ENTRIES),
    # a directory's entry and the one that its files imply are the same node
    "source_zip_tree": query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN is_directory THEN rtrim(name, '/') ELSE name END AS node, is_directory,
        CAST(row_number() OVER (PARTITION BY doc_id, is_directory ORDER BY name) AS INTEGER) AS place FROM entries""", _ENTRIES),
    "source_office_texts": r"""SELECT CAST(doc_id AS VARCHAR) AS path, NULL AS error,
        sha256(coalesce(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10)), '')) AS hash FROM documents""",
    "source_reencoded": query("""SELECT id AS path, ['ASCII', 'UTF8', 'SJIS', 'EUCJP', 'JIS'][n % 5 + 1] AS encoding, ['utf-8', 'utf-8', 'shift_jis', 'euc-jp', 'iso-2022-jp'][n % 5 + 1] AS charset,
        CASE WHEN n % 5 = 0 THEN title ELSE '人口統計データの一覧 ' || title || ' これは東京都の公園です。' END AS text, false AS truncated FROM (SELECT id, title, CAST(id AS BIGINT) AS n FROM package_core)"""),
    "source_reencoded_tables": """SELECT CAST(o_custkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_index, '番号|優先度の名前|状態' AS names,
        o_orderkey || '|' || o_orderpriority || ', x|' || o_orderstatus AS cells FROM orders""",
    "source_preview_cut": f"""SELECT CAST(doc_id AS VARCHAR) AS path, substr(text, 1, k) || CASE WHEN strlen(text) > {PREVIEW_BYTES} AND strlen(substr(text, 1, k)) < {PREVIEW_BYTES} THEN chr(65533) ELSE '' END AS text,
        'utf-8' AS charset, strlen(text) > {PREVIEW_BYTES} AS truncated
        FROM (SELECT doc_id, text, list_max(list_filter(range(0, {PREVIEW_BYTES} + 1), lambda k: strlen(substr(text, 1, k)) <= {PREVIEW_BYTES})) AS k FROM documents)""",
    "change_reset_counts": query("SELECT 'user' AS index, count(*) AS n FROM users UNION ALL SELECT unnest(['package', 'resource', 'package_tag', 'package_group', 'pipeline']), 0"),
    "lookup_touched_counts": query("""SELECT 'written' AS index, count(*) AS n FROM touched JOIN package_b USING (id) WHERE state = 'active'
        UNION ALL SELECT 'removed', count(*) FROM touched JOIN package_core p USING (id) JOIN package_b b USING (id) WHERE p.state = 'active' AND b.state <> 'active'
        UNION ALL SELECT 'queued', count(*) FROM resource WHERE state = 'deleted' UNION ALL SELECT 'steps_gone', count(*) FROM step WHERE resource_id IN (SELECT id FROM resource WHERE state = 'deleted')""",
        f"{more_queries._STEP}, {index_queries._AFTER}" + """, touched AS (SELECT id FROM package_core WHERE owner_org = '3' OR CAST(id AS BIGINT) % 50 = 7 OR CAST(id AS BIGINT) % 53 = 0
        UNION SELECT package_id FROM resource WHERE CAST(id AS BIGINT) % 211 = 0 UNION SELECT package_id FROM package_tag WHERE CAST(package_id AS BIGINT) % 59 = 0 AND tag = 'Brand#1')"""),
}
