"""A kept inverted index: postings by term, so that a search reads its terms' rows and no text.

A posting is (term, id, field, text, len, tf, at). Each document has a row with the empty term for each field: the
key of its text and how many words that has, so that means and counts over any set of documents need no text either.
The words belong to the text, not to the document: a row (term, text, tf, at) tells how often a text holds a word,
and where if it is a pair of Han or kana, as only these are asked for in a row. Fields and documents with the same text share these rows, so the index grows with what is distinct.
Each file of postings is written in order of terms, so that a filter on terms skips all other pages of it.

Documents are added, changed and removed by a new table of postings in which only theirs are replaced; only texts
that changed are read. Words of texts that no document has any more stay until ``compacted``, and are not found.
Scores are those of ``ranked.bm25`` over the same documents.

Edge cases: null fields have no words and count with length 0; a document is known by its id, and of several rows
with one id each field counts once, with the frequencies of the best and the length of the longest; a query without
words gives no rows. A text of less than 32 bytes is its own key; two longer texts would be taken for one if their SHA-256 agreed.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis
from ..sources.shared import materialise

K1, B = 1.2, 0.75
#: Texts that hold a query's terms: so many may go to all tasks with their counts, at some 100 bytes each.
FEW = 100_000
#: The bytes of a key by SHA-256; the key of a text without a character.
KEY_BYTES, NO_TEXT = 32, b""


def texts_of(df: DataFrame, id: str, fields: Mapping[str, Column] | list[str]) -> DataFrame:
    """(id, field, body) of documents; ``fields`` are columns with texts."""
    columns = dict(fields) if isinstance(fields, Mapping) else {f: F.col(f) for f in fields}
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(c, F.lit("")).alias("body")) for f, c in columns.items()])
    return df.select(F.col(id).cast("string").alias("id"), F.explode(each).alias("f")).select("id", "f.field", "f.body")


def _key(body: Column) -> Column:
    return F.when(F.octet_length(body) < KEY_BYTES, body.cast("binary")).otherwise(F.unhex(F.sha2(body, 256)))


def held(texts: DataFrame, id: str) -> DataFrame:
    """(``id``, field, text, len): which text each field of a document holds, by its key, and how many words that has."""
    return texts.select(F.col("id").alias(id), "field", _key(F.col("body")).alias("text"), analysis.length(F.col("body")).alias("len"))


def postings_from(owners: DataFrame, texts: DataFrame) -> DataFrame:
    """The postings of documents (id, field, text, len) whose texts are among ``texts`` (``body``); equal texts are cut to words once.

    Texts are dealt by their keys, so a text's words are gathered where it is.
    """
    none = F.array().cast("array<bigint>")
    out = owners.select(F.lit("").alias("term"), "id", "field", "text", "len", F.lit(0).alias("tf"), none.alias("at"))
    word = lambda df: df.select("term", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("field"), "text", F.lit(None).cast("int").alias("len"), "tf", "at")
    for some in _distinct(texts):
        plain = some.select("text", F.explode(analysis.plain_words(F.col("body"))).alias("term")).groupBy("text", "term")
        out = out.unionByName(word(plain.agg(F.count("*").cast("int").alias("tf")).withColumn("at", none)))
    for some in _distinct(texts.where(analysis.has_pairs(F.col("body")))):
        placed = some.select("text", F.explode(analysis.placed_pairs(F.col("body"))).alias("w")).select("text", "w.term", "w.at").groupBy("text", "term")
        out = out.unionByName(word(placed.agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("at")).alias("at"))))
    return out


def _distinct(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text, body) of short texts, which are their own keys, and of long ones; each once, and none without a character."""
    size = F.octet_length("body")
    short = texts.where((size > 0) & (size < KEY_BYTES)).select(F.col("body").cast("binary").alias("text")).distinct()
    long = texts.where(size >= KEY_BYTES).groupBy(_key(F.col("body")).alias("text")).agg(F.first("body").alias("body"))
    return short.withColumn("body", F.col("text").cast("string")), long


def postings_of(df: DataFrame, id: str, fields: Mapping[str, Column] | list[str]) -> DataFrame:
    """The postings of documents; ``fields`` are columns with texts."""
    texts = texts_of(df, id, fields)
    return postings_from(held(texts, "id"), texts)


def write_postings(postings: DataFrame, path: str) -> None:
    postings.sortWithinPartitions("term").write.option("compression", "zstd").mode("errorifexists").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, id string, field string, text binary, len int, tf int, at array<bigint>").parquet(path)


def compacted(postings: DataFrame) -> DataFrame:
    """The postings without words of texts that no document has any more, and without words that are there twice."""
    live = postings.where("term = ''").select("text").distinct()
    return postings.where("term = ''").unionByName(postings.where("term <> ''").dropDuplicates(["text", "term"]).join(live, "text", "left_semi").select(*postings.columns))


def replaced(postings: DataFrame, changed: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The postings after documents are added or changed (their new postings) and removed (``id``)."""
    gone = [df.select("id").distinct() for df in (changed, removed) if df is not None]
    kept = postings.join(reduce(DataFrame.unionByName, gone).distinct(), "id", "left_anti") if gone else postings
    return kept if changed is None else kept.unionByName(changed)


def _words(postings: DataFrame, wanted: list[analysis.Asked]) -> DataFrame:
    """The rows of the query's terms; a filter that the scan takes over."""
    terms = {p for a in wanted for p in ([a.text] if not a.dense else a.pairs if len(a.text) > 1 else [])}
    held = F.col("term").isin(*sorted(terms))
    for a in wanted:
        if a.dense and len(a.text) == 1:
            held = held | F.col("term").startswith(a.text)
    return postings.where(held)


def _frequency(a: analysis.Asked) -> Column:
    """An aggregate over a text's rows, of which some may be there twice: how often it holds what is asked for."""
    if not a.dense:
        return F.max(F.when(F.col("term") == a.text, F.col("tf")))
    if len(a.text) == 1:
        each = F.collect_set(F.when(F.col("term").startswith(a.text), F.struct("term", "tf")))
        return F.aggregate(each, F.lit(0), lambda n, x: n + x["tf"])
    places = [F.coalesce(F.max(F.when(F.col("term") == p, F.col("at"))), F.array().cast("array<bigint>")) for p in a.pairs]
    back = lambda k: lambda x: x - k
    begins = [F.transform(c, back(k)) for k, c in enumerate(places)]
    return F.size(reduce(F.array_intersect, begins))


def search(postings: DataFrame, q: str, boosts: Mapping[str, float], ids: DataFrame | None = None) -> DataFrame:
    """(id, score) of the documents (of ``ids``, if given) that hold all that ``q`` asks for.

    A term counts by its best field, with the largest document frequency of the fields; means and
    frequencies are those of the documents asked. Documents get the counts of their texts where they are
    read (``FEW`` texts at most go to all tasks, more are joined), and meet ``ids`` in the one shuffle that gathers their fields.
    """
    wanted = analysis.asked(q)
    none = postings.sparkSession.createDataFrame([], "id string, score double")
    if not wanted:
        return none
    terms, fields = range(len(wanted)), range(len(boosts))
    held_by = _words(postings, wanted).groupBy("text").agg(*[F.coalesce(_frequency(a), F.lit(0)).alias(f"tf{i}") for i, a in enumerate(wanted)])
    held_by = held_by.where(reduce(or_, [F.col(f"tf{i}") > 0 for i in terms]))
    few = held_by.limit(FEW + 1).count() <= FEW  # one number
    own = postings.where(F.col("term") == "").where(F.col("field").isin(*boosts)).select("id", "field", "text", "len")
    own = own.join(F.broadcast(held_by) if few else held_by, "text", "left")
    counts = {f"len_{k}": F.when(F.col("field") == f, F.col("len")) for k, f in enumerate(boosts)}
    counts |= {f"tf_{k}_{i}": F.when(F.col("field") == f, F.col(f"tf{i}")) for k, f in enumerate(boosts) for i in terms}
    rows = own.select("id", F.lit(ids is None).alias("asked"), *[c.alias(name) for name, c in counts.items()])
    if ids is not None:
        rows = rows.unionByName(ids.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.lit(True).alias("asked")), allowMissingColumns=True)
    by = rows.groupBy("id").agg(F.max("asked").alias("asked"), *[F.max(name).alias(name) for name in counts]).where("asked").drop("asked")
    by = materialise(by, "counts")  # gathered once, for the means and for the scores
    sums = [x for k in fields for x in (F.count(f"len_{k}").alias(f"n_{k}"), F.avg(f"len_{k}").alias(f"mean_{k}"))]
    seen = by.agg(*sums, *[_largest([F.count_if(F.col(f"tf_{k}_{i}") > 0) for k in fields]).alias(f"most_{i}") for i in terms])  # one row
    scored = by.where(reduce(and_, [reduce(or_, [F.coalesce(F.col(f"tf_{k}_{i}"), F.lit(0)) > 0 for k in fields]) for i in terms])).join(F.broadcast(seen))
    parts = []
    for i in terms:
        of_field = []
        for k, boost in enumerate(boosts.values()):
            tf, idf = F.col(f"tf_{k}_{i}"), F.log(1 + (F.col(f"n_{k}") - F.col(f"most_{i}") + 0.5) / (F.col(f"most_{i}") + 0.5))
            norm = K1 * (1 - B + B * F.col(f"len_{k}") / F.coalesce(F.nullif(f"mean_{k}", F.lit(0.0)), F.lit(1.0)))
            of_field.append(F.lit(float(boost)) * idf * tf / (tf + norm))
        parts.append(_largest(of_field))
    best = scored.select("id", *[c.alias(f"s{i}") for i, c in enumerate(parts)])
    return best.where(reduce(and_, [F.col(f"s{i}") > 0 for i in terms])).select("id", reduce(add, [F.col(f"s{i}") for i in terms]).alias("score"))


def _largest(columns: list[Column]) -> Column:
    """The largest of some columns that isn't null."""
    return F.greatest(*columns) if len(columns) > 1 else columns[0]
