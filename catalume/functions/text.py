"""Text helpers: encodings (by codecs, in Arrow batches), byte limits and chunks (by JVM functions)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CHUNK_BYTES = 500 * 1024
_CODECS = {"UTF8": "utf-8", "ASCII": "utf-8", "UNICODE": "utf-8", "SJIS": "cp932", "EUCJP": "euc_jp", "JIS": "iso2022_jp"}
_DECLARED = re.compile(rb"""<\?xml[^>]*encoding=["']([A-Za-z0-9_.:-]+)["']""", re.I)
_NAMES = {"utf-8": "UTF8", "utf8": "UTF8", "shift_jis": "SJIS", "shift-jis": "SJIS", "sjis": "SJIS", "windows-31j": "SJIS", "euc-jp": "EUCJP", "iso-2022-jp": "JIS"}


def encoding_of(data: bytes) -> str:
    """ASCII, UTF8, JIS, SJIS or EUCJP; an XML declaration in the first 200 bytes decides; empty is UTF8."""
    declared = _DECLARED.search(data[:200])
    if declared:
        return _NAMES.get(declared[1].decode().lower(), "UTF8")
    if not data:
        return "UTF8"
    if b"\x1b$" in data or b"\x1b(J" in data:
        return "JIS"
    if max(data) < 128:
        return "ASCII"
    best, most = "UTF8", -1.0
    for name in ("UTF8", "EUCJP", "SJIS"):
        for cut in range(4):  # a sample may end within a character
            try:
                text = data[: len(data) - cut].decode(_CODECS[name])
            except UnicodeDecodeError:
                continue
            if name == "UTF8":
                return name
            kana = sum("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in text)
            odd = sum("\uff61" <= c <= "\uff9f" or "\ue000" <= c <= "\uf8ff" for c in text)
            if (score := (kana - 2 * odd) / max(1, len(text))) > most:
                best, most = name, score
            break
    return best


def decoded(data: bytes, encoding: str) -> str:
    return data.decode(_CODECS.get(encoding, "utf-8"), "replace")


@F.pandas_udf(StringType())
def _detected(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else encoding_of(bytes(b)))


@F.pandas_udf(StringType())
def _decoded(data: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decoded(bytes(b), e) for b, e in zip(data, encoding, strict=True)])


def detect_encoding(data: Column) -> Column:
    """The encoding of bytes, by ``encoding_of``; bytes that are plainly ASCII or UTF-8 don't go to Python."""
    plain = F.decode(data, "ISO-8859-1")
    open_ = plain.rlike(r"(?i)<\?xml|\x1b(?:\$|\(J)")
    ascii_ = F.octet_length(F.encode(plain, "UTF-8")) == F.octet_length(data)
    whole = lambda cut: F.is_valid_utf8(F.substring(data, F.lit(1), F.greatest(F.octet_length(data) - cut, F.lit(0))).cast("string"))
    known = F.when(F.octet_length(data) == 0, "UTF8").when(open_, None).when(ascii_, "ASCII").when(whole(0) | whole(1) | whole(2) | whole(3), "UTF8")
    return F.coalesce(known, _detected(F.when(known.isNull(), data)))


def decode_bytes(data: Column, encoding: Column) -> Column:
    """Bytes as text, by ``decoded``; valid UTF-8 doesn't go to Python."""
    text = data.cast("string")
    known = F.when(F.coalesce(encoding, F.lit("")).isin("SJIS", "EUCJP", "JIS"), None).when(F.is_valid_utf8(text), text)
    return F.coalesce(known, _decoded(F.when(known.isNull(), data), encoding))


_CUT = "array<struct<at:int,n:int,long:boolean>>"


def _char_end(data: Column, start: Column, limit: int) -> Column:
    """Where a piece of at most ``limit`` bytes from ``start`` ends, no character split."""
    end = F.least(start + limit, F.octet_length(data))
    free = lambda p: (p >= F.octet_length(data)) | ~F.hex(F.substring(data, p + 1, F.lit(1))).between("80", "BF")
    return F.when(free(end), end).when(free(end - 1), end - 1).when(free(end - 2), end - 2).otherwise(end - 3)


def _pieces(line: Column, limit: int, whole: bool) -> Column:
    """A line cut off at ``limit`` bytes, or with ``whole`` cut up at it."""
    cut = lambda data, start, end: F.decode(F.substring(data, start + 1, end - start), "UTF-8")

    def of(data: Column) -> Column:
        if not whole:
            return F.array(cut(data, F.lit(0), _char_end(data, F.lit(0), limit)))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, _: Column) -> Column:
            end = F.transform(F.array(_char_end(data, acc["at"], limit)), lambda e: F.struct(e.alias("at"), F.concat(acc["out"], F.array(cut(data, acc["at"], e))).alias("out")))[0]
            return F.when(acc["at"] < F.octet_length(data), end).otherwise(acc)

        most = F.ceil(F.octet_length(data) / F.lit(limit - 3)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), begin, step, lambda acc: acc["out"])

    return F.transform(F.array(F.encode(line, "UTF-8")), of)[0]


def chunked(text: Column, limit: int = CHUNK_BYTES, most: int | None = None, whole: bool = False, last_break: bool = True) -> Column:
    """An array of chunks of whole lines, as many in each as its ``limit`` in bytes (4 at least) holds.

    A line counts with its newline; without ``last_break``, the newline at a chunk's end doesn't count. A
    longer line is a chunk of its own: cut off at the limit, or with ``whole`` cut up at it, so that the
    chunks hold all of the text. A text within the limit, also an empty one, is a single chunk. One fold over
    the lines' sizes finds where chunks begin, and they are cut out once.
    """
    lines = F.split(text, "\n", -1)
    room = limit + (not last_break)
    begin = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("open"), F.lit(0).alias("used"), F.array().cast(_CUT).alias("cuts"))
    cut = lambda at, n, long: F.array(F.struct(at.alias("at"), n.alias("n"), F.lit(long).alias("long")))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] >= 0, F.concat(acc["cuts"], cut(acc["open"], acc["i"] - acc["open"], False))).otherwise(acc["cuts"])

    def step(acc: Column, size: Column) -> Column:
        at = lambda open_, used, cuts: F.struct((acc["i"] + 1).alias("i"), open_.alias("open"), used.alias("used"), cuts.alias("cuts"))
        alone = at(F.lit(-1), F.lit(0), F.concat(closed(acc), cut(acc["i"], F.lit(1), True)))
        full = at(acc["i"], size + 1, closed(acc))
        return F.when(size + int(last_break) > limit, alone).when((acc["open"] < 0) | (acc["used"] + size + 1 > room), full).otherwise(at(acc["open"], acc["used"] + size + 1, acc["cuts"]))

    def parts(ls: Column) -> Column:
        cuts = F.aggregate(F.transform(ls, F.octet_length), begin, step, closed)
        out = F.flatten(F.transform(cuts, lambda c: F.when(c["long"], _pieces(F.get(ls, c["at"]), limit, whole)).otherwise(F.array(F.array_join(F.slice(ls, c["at"] + 1, c["n"]), "\n")))))
        return out if most is None else F.slice(out, 1, most)

    return F.when(F.octet_length(text) <= limit, F.array(text)).otherwise(F.transform(F.array(lines), parts)[0])


def content_chunks(df: DataFrame, limit: int = CHUNK_BYTES, most: int | None = None, whole: bool = True, last_break: bool = True) -> DataFrame:
    """(resource_id, package_id, content_type, chunk_index, chunk_size, extracted_text) of texts.

    ``df`` has resource_id, package_id, content_type and text; null texts have no chunk. Texts are split by
    ``chunked``.
    """
    columns = [F.col(c).cast("string").alias(c) for c in ("resource_id", "package_id", "content_type")]
    found = df.where("text IS NOT NULL").select(*columns, F.posexplode(chunked(F.col("text"), limit, most, whole, last_break)).alias("chunk_index", "extracted_text"))
    return found.select("resource_id", "package_id", "content_type", "chunk_index", F.octet_length("extracted_text").alias("chunk_size"), "extracted_text")


def chunk_totals(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """(resource_id, chunks, indexed, original): how many chunks and bytes of each text went to the index, and how many bytes it has."""
    of = chunks.groupBy("resource_id").agg(F.count("*").alias("chunks"), F.sum("chunk_size").cast("long").alias("indexed"))
    own = texts.where("text IS NOT NULL").select("resource_id", F.octet_length("text").cast("long").alias("original"))
    return own.join(of, "resource_id")


def truncate_column(c: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes of a text, no character split."""
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.transform(F.array(F.encode(c, "UTF-8")), lambda d: F.decode(F.substring(d, F.lit(1), _char_end(d, F.lit(0), limit)), "UTF-8"))[0])
