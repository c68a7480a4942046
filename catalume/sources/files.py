"""Raw files: objects, byte ranges, text previews, delimited tables, archives, GeoJSON, office texts.

Files are rows of Spark's binary source, so they are read and processed in parallel; whole-file parsing
is a small Arrow-batched helper that never fails a task, but returns an error for the row.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import batched, rows_of
from ..functions.scalars import charset, escape_html, prefixed_sha256
from ..functions.text import decode_bytes, detect_encoding
from .archives import zip_entries  # noqa: F401
from .rtf import rtf_text

#: Limits of the job: bytes of a source, of a preview and of an encoding sample; columns; entries kept of an archive.
MAX_FETCH, PREVIEW, SAMPLE, MAX_COLUMNS, MAX_ENTRIES, ROWS_PER_FILE = 100 << 20, 1 << 20, 64 << 10, 500, 10_000, 5_000

# Fixed value: the centre of a map without features (latitude, longitude).
CENTRE = (36.0, 138.0)

# How a footer row's first cell begins, in lower case.
FOOTER_PREFIXES = ("合計", "注", "※", "出典", "備考", "計", "total", "note", "source")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def fetched(df: DataFrame) -> DataFrame:
    """Hash and size of each object, or why it can't be taken."""
    large = F.col("length") > MAX_FETCH
    return df.select("path", F.when(~large, prefixed_sha256(F.col("content"))).alias("hash"), F.col("length").alias("size"), F.when(large, "too large").alias("error"))


def upload_hash(old: Column, content: Column) -> Column:
    """Only what has no hash yet is hashed."""
    return F.when(old.isNull(), prefixed_sha256(content)).otherwise(old)


def byte_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Bytes ``start`` to ``end`` (inclusive, no further than the last), with the range and the total size."""
    last = F.least(F.lit(end), F.col("length") - 1).cast("long")
    part = F.substring(F.col("content"), F.lit(start + 1), F.greatest(last - start + 1, F.lit(0)).cast("int"))
    return df.select("path", part.alias("part"), F.lit(start).cast("long").alias("start"), last.alias("end"), F.col("length").alias("total_size"))


def text_preview(df: DataFrame, encoding: str = "encoding", limit: int = PREVIEW) -> DataFrame:
    """The first bytes as text, by the encoding found before, and whether more follow."""
    part = F.substring(F.col("content"), F.lit(1), F.lit(limit))
    return df.select("path", decode_bytes(part, F.col(encoding)).alias("text"), charset(F.col(encoding)).alias("charset"), (F.col("length") > limit).alias("truncated"))


def with_encoding(df: DataFrame) -> DataFrame:
    """``df`` with the encoding of its content, from a sample of its beginning."""
    return df.withColumn("encoding", detect_encoding(F.substring(F.col("content"), F.lit(1), F.lit(SAMPLE))))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def table_rows(text: str) -> list[list[str]]:
    """The rows of a delimited text: delimiter found, empty lines, title rows and footer rows dropped; header first.

    Title rows are leading rows with at most one cell that isn't blank, where some row has more. Footer
    rows, from the bottom: the first cell is blank or begins with a known word; the header stays.
    """
    text = text.removeprefix("\ufeff")
    head = "\n".join(text.splitlines()[:20])
    delimiter = max(",\t;|", key=lambda d: (head.count(d), -",\t;|".index(d)))
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r and any(r) or len(r) > 1]
    filled = [sum(bool(c.strip()) for c in r) for r in rows]
    if rows and max(filled) > 1:
        rows = rows[next(i for i, n in enumerate(filled) if n > 1) :]
    while len(rows) > 1:
        first = rows[-1][0].strip().lower() if rows[-1] else ""
        if len(rows[0]) > 1 and (not first or first.startswith(FOOTER_PREFIXES)):
            rows.pop()
        else:
            break
    return rows


def column_names(header: list[str]) -> list[str]:
    """Names of a header; blank ones by place, repeated ones with a number."""
    out: list[str] = []
    for i, cell in enumerate(header):
        name = base = cell.strip() or f"column_{i}"
        n = 1
        while name.lower() in {x.lower() for x in out}:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def extract_tables(df: DataFrame) -> DataFrame:
    """(path, row_index, columns, cells, error) of delimited files with ``content`` and ``encoding``.

    Short rows are filled up with empty cells, extra cells ignored. Files differ in their columns, so a
    row carries its names and cells as arrays; ``typed_rows`` gives one file's table.
    """

    schema = pa.schema([("path", pa.string()), ("row_index", pa.int64()), ("columns", pa.list_(pa.string())), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def parsed(rows):
        from ..functions.text import decoded

        for path, content, encoding in rows:
            try:
                table = table_rows(decoded(content, encoding))
                names = column_names(table[0]) if table else []
                if len(names) > MAX_COLUMNS:
                    raise ValueError(f"more than {MAX_COLUMNS} columns")
                for i, r in enumerate(table[1:]):
                    yield path, i, names, (r + [""] * len(names))[: len(names)], None
            except (ValueError, csv.Error) as error:
                yield path, -1, [], [], str(error)

    def parse(batches):
        return batched(parsed(rows_of(batches, ["path", "content", "encoding"])), schema)

    return df.select("path", "content", "encoding").mapInArrow(parse, "path string, row_index long, columns array<string>, cells array<string>, error string")


def typed_rows(tables: DataFrame, path: str) -> DataFrame:
    """One file's table: a string column for each of its names, and ``row_index``."""
    own = tables.where((F.col("path") == path) & F.col("error").isNull())
    first = own.select("columns").first()
    return own.select("row_index", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(first["columns"] if first else [])])


def write_preview(table: DataFrame, path: str, rows: int = ROWS_PER_FILE) -> None:
    """A table as Parquet, in row order, ``rows`` rows a page; a page is a folder, named by its number.

    Many files' tables (``path``) may be written at once; a page of them is spread over several files.
    """
    of = [c for c in ("path",) if c in table.columns]
    paged = table.withColumn("page", F.floor(F.col("row_index") / F.lit(rows)).cast("int"))
    paged.repartitionByRange("page", *of).sortWithinPartitions("page", *of, "row_index").write.partitionBy("page").parquet(path)


def read_rows(df: DataFrame, start: int, end: int, rows: int = ROWS_PER_FILE) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) of a preview; only the pages that hold them are opened."""
    own = (F.col("row_index") >= start) & (F.col("row_index") < end)
    if "page" in df.columns:
        own = own & F.col("page").between(start // rows, max(start, end - 1) // rows)
    return df.where(own).drop("page").orderBy("row_index", *[c for c in ("path",) if c in df.columns])


def zip_manifest(entries: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """(path, files, size, compressed, truncated) of each archive, over all entries."""
    return entries.groupBy("path").agg(
        F.count_if(~F.col("is_directory")).alias("files"),
        F.sum("size").alias("size"),
        F.sum("compressed_size").alias("compressed"),
        (F.count("*") > most).alias("truncated"),
    )


def kept_entries(entries: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """The first ``most`` entries of each archive, by name; the manifest's totals are over all of them."""
    along = Window.partitionBy("path").orderBy("name")
    return entries.withColumn("place", F.row_number().over(along)).where(F.col("place") <= most).drop("place")


def write_manifest(manifests: DataFrame, path: str) -> None:
    """Each archive's manifest as a line of JSON."""
    manifests.select(F.to_json(F.struct(*manifests.columns)).alias("value")).write.text(path)


def table_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(rows, columns) of a Parquet table, from its footers alone."""
    df = spark.read.parquet(path)
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(",".join(df.columns)))


def split_lines(df: DataFrame, text: str = "text", to: str = "line") -> DataFrame:
    """A row a line with its place; what follows the last newline is a line only if it isn't empty."""
    parts = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n", -1)
    return df.where(F.col(text) != "").select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("at", to))


def collated(name: Column) -> Column:
    """A name to order by as readers expect it: accents beside their letters, small letters before capital ones."""
    return F.collate(name, "UNICODE")


def tree_order(tree: DataFrame) -> DataFrame:
    """A tree's nodes in the order in which they are shown: directories first, then by name as readers order names."""
    return tree.orderBy("path", F.col("is_directory").desc(), collated(F.col("node")), "node")


def placed(tree: DataFrame) -> DataFrame:
    """A tree's nodes with ``parent``, ``name`` and their place among the parent's children in the shown order."""
    at = F.length("node") - F.length(F.substring_index("node", "/", -1))
    named = tree.select("*", F.substring(F.col("node"), F.lit(1), F.greatest(at - 1, F.lit(0))).alias("parent"), F.substring_index("node", "/", -1).alias("name"))
    shown = Window.partitionBy("path", "parent").orderBy(F.col("is_directory").desc(), collated(F.col("name")), "name")
    return named.withColumn("place", F.row_number().over(shown))


def path_tree(entries: DataFrame, by_range: bool = False) -> DataFrame:
    """(path, node, is_directory): entries and the directories they imply; order directories first, then by name.

    With ``by_range`` entries are dealt by ranges of the path before they become nodes, which then are gathered
    and ordered where they are: for many archives whose nodes are mostly distinct.
    """
    from ..functions.scalars import path_prefixes

    own = F.regexp_replace("name", "/+$", "")
    dealt = entries.repartitionByRange("path") if by_range else entries
    nodes = dealt.select("path", own.alias("full"), "is_directory", F.explode(path_prefixes(own)).alias("node"))
    return nodes.groupBy("path", "node").agg(F.max((F.col("node") != F.col("full")) | F.col("is_directory")).alias("is_directory"))


def geojson_features(df: DataFrame, text: str = "text") -> DataFrame:
    """(path, at, geometry, properties as map) of each feature of GeoJSON texts."""
    schema = "struct<type:string,features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"
    parsed = F.from_json(F.col(text), schema)
    return df.select("path", F.posexplode(parsed["features"]).alias("at", "f")).select("path", "at", F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"))


def property_table(features: DataFrame) -> DataFrame:
    """(path, at, rows): the properties of each feature as rows of an HTML table, escaped; null and empty values are left out, and features without any."""
    shown = F.filter(F.map_entries("properties"), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    cell = lambda e: F.concat(F.lit("<tr><td>"), escape_html(e["key"]), F.lit("</td><td>"), escape_html(e["value"]), F.lit("</td></tr>"))
    return features.select("path", "at", F.array_join(F.transform(shown, cell), "").alias("rows")).where("rows <> ''")


def bounds_or_centre(bounds: DataFrame, paths: DataFrame, centre: tuple[float, float] = CENTRE) -> DataFrame:
    """The bounds of every file of ``paths``; one without coordinates is shown around the centre (latitude, longitude)."""
    lat, lon = centre
    return paths.select("path").distinct().join(bounds, "path", "left").na.fill({"west": lon, "east": lon, "south": lat, "north": lat})


def feature_bounds(features: DataFrame) -> DataFrame:
    """(path, west, south, east, north) over all coordinates of a file's features."""
    pairs = F.regexp_extract_all(F.col("geometry.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*-?[0-9.eE+-]+"), F.lit(1))
    lats = F.regexp_extract_all(F.col("geometry.coordinates"), F.lit(r"\[\s*-?[0-9.eE+-]+\s*,\s*(-?[0-9.eE+-]+)"), F.lit(1))
    flat = features.select("path", F.explode(F.arrays_zip(pairs.alias("x"), lats.alias("y"))).alias("p")).select("path", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    return flat.groupBy("path").agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


_PARTS = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml", "odt": r"content\.xml", "ods": r"content\.xml", "odp": r"content\.xml"}


def office_text(content: bytes, fmt: str) -> str | None:
    """The text of an office file that is an archive of XML, or of an RTF file; null for other formats."""
    if (fmt or "").lower() == "rtf":
        return rtf_text(content)
    pattern = _PARTS.get((fmt or "").lower())
    if not pattern:
        return None
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if re.fullmatch(pattern, n)]
        shared = []
        for name in sorted(names, key=lambda n: ([0] if "shared" in n else [1, *map(int, re.findall(r"\d+", n))])):
            xml = archive.read(name).decode("utf-8", "replace")
            if name.endswith("sharedStrings.xml"):
                shared = [unescape("".join(re.findall(r"<t[^>]*>([\s\S]*?)</t>", s))) for s in re.findall(r"<si>([\s\S]*?)</si>", xml)]
                continue
            if fmt.lower() == "xlsx":
                for attributes, body in re.findall(r"<c\b([^>]*?)(?:/>|>([\s\S]*?)</c>)", xml):
                    value = re.search(r"<(v|t)\b[^>]*>([\s\S]*?)</\1>", body or "")
                    if value:
                        v = unescape(value[2]).strip()
                        kind = re.search(r"\bt=[\"']([A-Za-z]+)[\"']", attributes)
                        out.append(shared[int(v)].strip() if kind and kind[1].lower() == "s" and v.isdigit() and int(v) < len(shared) else v)
                continue
            for block in re.split(r"</(?:w:p|a:p|text:p|text:h)>", xml):
                plain = unescape(re.sub(r"<[^>]+>", "", block)).strip()
                if plain:
                    out.append(plain)
    return "\n".join(out)


def document_texts(df: DataFrame) -> DataFrame:
    """(path, text, error) of office files with ``content`` and ``format``."""

    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def texts(rows):
        for path, content, fmt in rows:
            try:
                text = office_text(content, fmt)
                yield path, text, None if text is not None else "unsupported"
            except (zipfile.BadZipFile, KeyError, OSError, ValueError) as error:
                yield path, None, str(error)

    def read(batches):
        return batched(texts(rows_of(batches, ["path", "content", "format"])), schema)

    return df.select("path", "content", "format").mapInArrow(read, "path string, text string, error string")
