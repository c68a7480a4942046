"""Document fingerprints from closed syncmers of words.

A text is cut into tokens: each character of a script that is written without spaces is one, and so is
each run of other characters without white space, whatever else the text holds. Of every five-token k-mer,
the four two-token s-mers inside it are hashed; the k-mer is an anchor (a closed syncmer) if its smallest
s-mer is the first or the last one. That depends on nothing outside the k-mer, so two texts that share
a passage share its anchors wherever the passage stands. About half of all k-mers are anchors.

The fingerprint is the ``SKETCH`` smallest distinct anchor hashes (16 hexadecimal digits each, joined);
the likeness of two fingerprints estimates the Jaccard similarity of the two anchor sets from the
smallest hashes of their union. A text of fewer than five tokens, or without an anchor, is represented
by the hash of its whole token sequence; a text without tokens (null, empty, white space) has the empty
fingerprint. Two empty fingerprints have likeness 1, an empty and another one 0.

Everything is DataFrame functions; the text crosses one shuffle, for the neighbour in document order.

Edge cases: equal ids go by their texts where the next document is sought, and a null id comes last;
repeated rows are all returned, and each is the other's neighbour; a very long text has a fingerprint of
the same bounded size; an empty table gives an empty result; columns other than the id and the text are
not read by ``fingerprint_edits``, and ``sketch``, ``anchors`` and ``likeness`` replace a column of the
name they are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

K, S = 5, 2
SKETCH = 128
#: Rows of a block in which neighbours are looked up, and the most blocks there are.
ROWS_PER_BLOCK, MAX_BLOCKS = 64, 16_384

_LOWEST = -(2**63)
#: Scripts that are written without spaces between words.
_DENSE = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))


def _hashes(df: DataFrame, text: str, to: str) -> DataFrame:
    """``to``_w: hashes of the tokens, ``to``_s: of the s-mers."""
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(rf"[{_DENSE}]|[^\s{_DENSE}]++"), F.lit(0))
    tokens = F.when(F.octet_length(t) == F.length(t), F.split(t, r"\s+")).otherwise(found)  # the same for plain letters, in less time
    df = df.withColumn(f"{to}_w", F.transform(F.array_remove(tokens, ""), lambda w: F.xxhash64(w)))
    w = F.col(f"{to}_w")
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return df.withColumn(f"{to}_s", pairs)


def _closed(to: str) -> Column:
    """Of each k-mer its hash if it is a closed syncmer, else null."""
    w, s = F.col(f"{to}_w"), F.col(f"{to}_s")

    def at(i: Column) -> Column:
        edges, inner = F.least(F.get(s, i), F.get(s, i + 3)), F.least(F.get(s, i + 1), F.get(s, i + 2))
        return F.when(edges <= inner, F.xxhash64(F.get(s, i), F.get(s, i + 2), F.get(w, i + 4)))

    return F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), at)).otherwise(F.array().cast("array<bigint>"))


def anchors(df: DataFrame, text: str = "text", to: str = "anchors") -> DataFrame:
    """``df`` with an array of (position in tokens, hash) of the text's anchors, in text order."""
    out = _hashes(df.withColumn("__t", text_or_empty(text)), "__t", "__a").withColumn("__c", _closed("__a"))
    found = F.filter(F.transform(F.col("__c"), lambda h, i: F.struct(i.alias("position"), h.alias("hash"))), lambda a: a["hash"].isNotNull())
    return out.withColumn(to, found).drop("__t", "__a_w", "__a_s", "__c")


def sketch(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the sorted sketch of a text column that holds no nulls, as array<bigint>."""
    df = _hashes(df, text, to).withColumn(f"{to}_c", F.array_distinct(F.filter(_closed(to), lambda h: h.isNotNull())))
    w, c = F.col(f"{to}_w"), F.col(f"{to}_c")
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(to, F.slice(F.when(F.size(c) > 0, F.sort_array(c)).otherwise(whole), 1, SKETCH)).drop(f"{to}_w", f"{to}_s", f"{to}_c")


def hexed(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """``df`` with the estimated Jaccard similarity (0 to 1) of the anchor sets behind two sketches."""
    df = df.withColumn("__u", F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH))
    both = F.size(F.array_intersect("__u", F.array_intersect(a, b)))
    return df.withColumn(to, F.when(F.size("__u") == 0, F.lit(1.0)).otherwise(both / F.size("__u"))).drop("__u")


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _count_at_least(bounds: list[int], k: Column) -> Column:
    """How many of the descending ``bounds`` are >= k, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    group = F.size(F.filter(_longs(bounds[::step]), lambda b: b >= k))
    within = F.slice(_longs(bounds), F.greatest(group - 1, F.lit(0)) * step + 1, step)
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + F.size(F.filter(within, lambda b: b >= k)))


def deal_to_blocks(df: DataFrame, order: str, tie: str):
    """``df`` dealt to blocks of neighbours by descending ``order``, and a window over each block.

    The order column is cut into blocks at quantiles of itself (a null counts as the smallest, equal
    values go by ``tie``). The first row of each block is copied to the end of the block before it, and
    that of the first block to the end of the last, so a ``lead`` over the window finds every row's
    successor and no task gathers more than its blocks. Rows with ``__copy`` = 1 are the copies.
    """
    k = F.coalesce(F.col(order), F.lit(_LOWEST))
    n = df.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // ROWS_PER_BLOCK)))
    cuts = [i / blocks for i in range(1, blocks)] or [0.5]
    found = df.select(k.alias("k")).agg(F.max("k").alias("top"), F.percentile_approx("k", cuts, max(10_000, 20 * blocks)).alias("cuts")).first()
    top = _LOWEST if found["top"] is None else found["top"]
    bounds = sorted({c for c in found["cuts"] or [] if c < top} if blocks > 1 else (), reverse=True)
    keyed = df.withColumn("__k", k).withColumn("__b", _count_at_least(bounds, F.col("__k")))
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("copy"))
    before = F.struct(F.pmod(F.col("__b") - 1, F.lit(len(bounds) + 1)).alias("b"), F.lit(1).alias("copy"))
    first = F.get(_longs([top, *bounds]), F.col("__b")) == F.col("__k")
    dealt = keyed.withColumn("__d", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.withColumns({"__block": F.col("__d.b"), "__copy": F.col("__d.copy")}).drop("__d", "__b").repartition("__block")
    by = F.when(F.col("__copy") == 1, F.lit(_LOWEST)).otherwise(F.col("__k"))
    return dealt, Window.partitionBy("__block").orderBy(by.desc(), "__copy", tie)


def fingerprint_edits(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has the last floor(n/2) of the n code points replaced by the first as many (or all)
    of the next document by descending id. Returns the id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next; a single document is its own successor.
    """
    docs = df.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    dealt, window = deal_to_blocks(docs, "doc_id", "text")
    both = sketch(dealt, "text", "sk").withColumns({"next": F.lead("text").over(window), "next_sk": F.lead("sk").over(window)}).where("__copy = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    out = sketch(both.withColumn("edited", edited), "edited", "edited_sk")
    out = likeness(likeness(out, "sk", "edited_sk", "near_edited"), "sk", "next_sk", "near_next")
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        hexed(F.col("sk")).alias("fingerprint"),
        hexed(F.col("edited_sk")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
