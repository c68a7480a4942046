"""ZIP archives: their directories as rows, read by JVM functions; nothing is unpacked.

An archive is a row of Spark's binary source. Its end record says where the directory is, the directory is
cut at the signatures of its entries, and every field of an entry is a column expression. Python only sees
names in an encoding that the JVM functions don't have.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Signatures of the end record, of its 64-bit form, of that one's locator, and of an entry; how
# long the end record is with the longest comment; what a number holds that stands in its 64-bit form elsewhere.
END, END64, LOCATOR64, ENTRY = "PK\x05\x06", "PK\x06\x06", "PK\x06\x07", "PK\x01\x02"
END_BYTES, ELSEWHERE, ELSEWHERE_SHORT = 22 + 65_535, 0xFFFFFFFF, 0xFFFF
#: Bytes of an entry after its signature and before its name.
HEAD = 42
#: What an entry without a valid time has.
NO_TIME = "1970-01-01T00:00:00"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _number(data: Column, at: Column | int, n: int) -> Column:
    """The unsigned little-endian number of ``n`` bytes at an offset; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    turned = lambda h: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])
    held = F.octet_length(data) >= at + n
    return F.when(held, F.conv(_once(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(n))), turned), 16, 10).cast("decimal(20,0)").cast("long"))


def _plain(data: Column) -> Column:
    """Bytes as characters of the same number, for functions of texts."""
    return F.decode(data, "ISO-8859-1")


def _bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def _directory(content: Column) -> Column:
    """The bytes of an archive's directory; null without an end record."""
    tail = _plain(F.substring(content, F.lit(-END_BYTES), F.lit(END_BYTES)))

    def found(tail: Column) -> Column:
        rest = F.substring_index(tail, END, -1)
        record, at = _bytes(rest), F.octet_length(content) - F.length(rest) - len(END)
        size, offset, entries = _number(record, 8, 4), _number(record, 12, 4), _number(record, 6, 2)
        part = lambda begin, n: F.when((begin >= 0) & (n >= 0), F.substring(content, (begin + 1).cast("int"), n.cast("int")))
        # the locator and the record before it, of 20 and 56 bytes
        wide = ((size == ELSEWHERE) | (offset == ELSEWHERE) | (entries == ELSEWHERE_SHORT)) & (_plain(F.substring(content, at - 19, F.lit(4))) == LOCATOR64) & (at >= 76)
        wide = wide & (_plain(F.substring(content, at - 75, F.lit(4))) == END64)
        size64 = _number(content, at - 76 + 40, 8)
        return F.when(F.contains(tail, F.lit(END)) & size.isNotNull(), F.when(wide, part(at - 76 - size64, size64)).otherwise(part(at - size, size)))

    return _once(tail, found)


def _needed(data: Column) -> Column:
    """How many bytes an entry has by its own account; null if that is cut off."""
    return HEAD + _number(data, 24, 2) + _number(data, 26, 2) + _number(data, 28, 2)


def _entries(directory: Column) -> Column:
    """The entries of a directory, each without its signature; null if it doesn't begin with one.

    A signature can also stand within an entry, as in its name or comment. Then a piece is shorter than it
    says, and pieces are put together again until they have that length.
    """
    whole = lambda p: F.coalesce(F.length(p) >= _needed(_bytes(p)), F.lit(False))

    def again(pieces: Column) -> Column:
        begin = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, piece: Column) -> Column:
            one = F.when(acc["held"].isNull(), piece).otherwise(F.concat(acc["held"], F.lit(ENTRY), piece))
            more = lambda p: F.when(whole(p), F.struct(F.lit(None).cast("string").alias("held"), F.concat(acc["out"], F.array(p)).alias("out"))).otherwise(F.struct(p.alias("held"), acc["out"].alias("out")))
            return _once(one, more)

        return F.aggregate(pieces, begin, step, lambda acc: acc["out"])

    def cut(parts: Column) -> Column:
        pieces = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.when(F.get(parts, F.lit(0)) == "", F.when(F.forall(pieces, whole), pieces).otherwise(again(pieces)))

    return _once(F.split(_plain(directory), ENTRY, -1), cut)


def _wide_sizes(extra: Column) -> Column:
    """Where the 64-bit sizes stand in an entry's extra records, or null."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        found = F.coalesce(acc["found"], F.when(_number(extra, acc["at"], 2) == 1, acc["at"] + 4))
        return F.struct((acc["at"] + 4 + F.coalesce(_number(extra, acc["at"] + 2, 2), F.lit(0))).alias("at"), found.alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.octet_length(extra) / 4).cast("int")), begin, step, lambda acc: acc["found"])


@F.pandas_udf(StringType())
def _old_name(data: pd.Series) -> pd.Series:
    """Names that aren't UTF-8: Shift_JIS, else as the format has it."""

    def one(b):
        try:
            return bytes(b).decode("cp932")
        except UnicodeDecodeError:
            return bytes(b).decode("cp437")

    return data.map(lambda b: None if b is None else one(b))


def zip_entries(df: DataFrame) -> DataFrame:
    """(path, name, size, compressed_size, last_modified, is_directory): all entries of each archive, from its directory alone.

    A name is UTF-8 by its flag or by trial, else Shift_JIS. An archive that can't be read, or is null, has
    no entry; a time that doesn't exist is that of ``NO_TIME``.
    """
    found = df.select("path", F.explode(_entries(_directory(F.col("content")))).alias("text")).select("path", _bytes(F.col("text")).alias("e"))
    e = F.col("e")
    numbers = found.select("path", "e", *[_number(e, at, n).alias(name) for name, at, n in (("flags", 4, 2), ("t", 8, 2), ("d", 10, 2), ("packed", 16, 4), ("full", 20, 4), ("n", 24, 2), ("m", 26, 2))])
    cut = numbers.select("*", F.substring(e, F.lit(HEAD + 1), F.col("n").cast("int")).alias("raw"), F.substring(e, (F.col("n") + HEAD + 1).cast("int"), F.col("m").cast("int")).alias("extra"))
    # sizes of 64 bits: first that of the file, if it is there, then that of its packed form
    at = F.when((F.col("full") == ELSEWHERE) | (F.col("packed") == ELSEWHERE), _wide_sizes(F.col("extra")))
    wide = cut.withColumn("at", at)
    full = F.when(F.col("full") == ELSEWHERE, F.coalesce(_number(F.col("extra"), F.col("at"), 8), "full")).otherwise(F.col("full"))
    second = F.col("at") + F.when(F.col("full") == ELSEWHERE, 8).otherwise(0)
    packed = F.when(F.col("packed") == ELSEWHERE, F.coalesce(_number(F.col("extra"), second, 8), "packed")).otherwise(F.col("packed"))
    t, d = F.col("t").cast("int"), F.col("d").cast("int")
    shown = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", F.shiftright(d, 9) + 1980, F.shiftright(d, 5).bitwiseAND(15), d.bitwiseAND(31), F.shiftright(t, 11), F.shiftright(t, 5).bitwiseAND(63), t.bitwiseAND(31) * 2)
    text, flagged = F.col("raw").cast("string"), F.col("flags").bitwiseAND(0x800) != 0
    name = F.when(flagged, F.make_valid_utf8(text)).when(F.is_valid_utf8(text), text).otherwise(F.col("old"))
    rows = wide.select("path", "raw", "flags", full.alias("size"), packed.alias("compressed_size"), F.when(F.try_to_timestamp(shown, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNull(), NO_TIME).otherwise(shown).alias("last_modified"))
    named = rows.withColumn("old", _old_name(F.when(~flagged & ~F.is_valid_utf8(text), F.col("raw")))).withColumn("name", name)
    return named.select("path", "name", "size", "compressed_size", "last_modified", F.endswith("name", F.lit("/")).alias("is_directory"))
