"""Ranked search: BM25 over packages, resources and text chunks, merged to one ranking.

Without an index a query is answered by two scans: one counts documents, mean lengths and document
frequencies of the query's terms (a single row), a second one scores the rows that hold the terms. With a
kept ``SearchIndex`` the rows of its terms are read in place of texts, and the scores are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis, fragments
from ..sources.catalog import Catalog
from ..sources.shared import materialise
from . import postings as index
from .listing import package_list
from .search import Filters, keep_order, matching

K1, B = 1.2, 0.75
RESOURCE_WEIGHT, CONTENT_SCORE = 0.4, 0.4


def tokens(c: Column) -> Column:
    """Words in lower case, with runs of Han and kana as pairs."""
    return analysis.words(c)


def query_terms(q: str) -> list[str]:
    return [a.text for a in analysis.asked(q)]


def _count_names(field: str, terms: int) -> list[str]:
    return [f"__len_{field}", *[f"__tf_{field}_{i}" for i in range(terms)]]


def counted(df: DataFrame, q: str, fields: Iterable[str]) -> DataFrame:
    """``df`` with the number of words of each field, and how often it holds each term of ``q``."""
    terms = analysis.asked(q)
    columns = {f: [analysis.length(F.col(f)), *[analysis.occurrences(F.col(f), t) for t in terms]] for f in fields}
    return df.withColumns({n: c for f, cs in columns.items() for n, c in zip(_count_names(f, len(terms)), cs, strict=True)})


def with_note_counts(catalog: Catalog, packages: DataFrame, q: str) -> DataFrame:
    """Packages with the counts of their notes, of which each is read once, however many packages share it."""
    names = _count_names("notes", len(analysis.asked(q)))
    told = counted(catalog.note, q, ["notes"]).select("at", *names)
    return catalog.with_note_key(packages).join(told, "at", "left").drop("at").na.fill(0, names)


def bm25(df: DataFrame, q: str, fields: dict[str, float], to: str = "score") -> DataFrame:
    """The rows of ``df`` that hold every term of ``q`` in one of the fields, with their score.

    A term counts by its best field, with the largest document frequency of the fields, as they are
    searched as one. A field whose counts stand beside it already (``counted``) needs no text.
    """
    terms = analysis.asked(q)
    if not terms:
        return df.withColumn(to, F.lit(0.0))
    counts = [c for f in fields for c in _count_names(f, len(terms))]
    made = [f for f in fields if _count_names(f, 0)[0] not in df.columns]
    held = counted(df, q, made)
    sums = [F.count("*").alias("n")] + [F.avg(f"__len_{f}").alias(f"len_{f}") for f in fields]
    sums += [F.count_if(F.col(f"__tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f in fields for i in range(len(terms))]
    stats = held.agg(*sums).first()  # one row
    total, hit = F.lit(0.0), F.lit(True)
    for i in range(len(terms)):
        n = max(stats[f"df_{f}_{i}"] for f in fields)
        idf = math.log(1 + (stats["n"] - n + 0.5) / (n + 0.5))
        scores = []
        for f, boost in fields.items():
            tf, mean = F.col(f"__tf_{f}_{i}").cast("double"), stats[f"len_{f}"] or 1.0
            norm = K1 * (1 - B + B * F.col(f"__len_{f}") / F.lit(mean))
            scores.append(F.lit(boost * idf) * tf / (tf + norm))
        best = F.greatest(*scores, F.lit(0.0))
        total, hit = total + best, hit & (best > 0)
    for i, term in enumerate(terms):  # what no field holds isn't measured
        held_by = [F.contains(F.lower(f), F.lit(term.text)) if f in made else F.col(f"__tf_{f}_{i}") > 0 for f in fields]
        df = df.where(reduce(or_, held_by))
    return counted(df, q, made).withColumn(to, total).where(hit).drop(*counts)


def keyword_score(boost: float, n: Column, df: Column) -> Column:
    """BM25 of a field that is one token: its length doesn't count."""
    return F.lit(boost / (1 + K1)) * F.log(1 + (n - df + 0.5) / (df + 0.5))


def package_leg(packages: DataFrame, q: str, tags: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(id, score): all terms in title or notes, or the whole query equal to the name or to a tag (package_id, tag); the best of them.

    With ``words``, postings of title and notes, no text is read.
    """
    boosts = {"title": 3.0, "notes": 1.0}
    legs = bm25(packages, q, boosts).select("id", "score") if words is None else index.search(words, q, boosts, packages)
    n = packages.agg(F.count("*").alias("n"))  # one row, like the counts below
    named = packages.where(F.col("name") == q).select("id", F.lit(2.0).alias("boost"))
    for hits in (named, *([tags.where(F.col("tag") == q).select(F.col("package_id").alias("id"), F.lit(1.0).alias("boost")).join(packages.select("id"), "id", "left_semi")] if tags is not None else ())):
        known = hits.agg(F.count("*").alias("df"), F.max("boost").alias("by"))
        score = F.col("by") * keyword_score(1.0, F.col("n"), F.col("df"))
        legs = legs.unionByName(hits.join(F.broadcast(known)).join(F.broadcast(n)).select("id", score.alias("score")))
    return legs.groupBy("id").agg(F.max("score").alias("score"))


def _best(found: DataFrame, key: str, top: int | None) -> DataFrame:
    """The best ``top`` rows by score and key; None: all."""
    return found if top is None else found.orderBy(F.desc("score"), key).limit(top)


def resource_leg(resources: DataFrame, q: str, top: int | None = None, words: DataFrame | None = None) -> DataFrame:
    """(id, package_id, score) of the resources that match (with ``top``, of the best of them); with ``words``, postings of name and description, no text is read."""
    boosts = {"name": 3.0, "description": 2.0}
    found = bm25(resources, q, boosts) if words is None else resources.select("id", "package_id").join(index.search(words, q, boosts, resources), "id")
    return _best(found, "id", top).select("id", "package_id", "score")


def content_leg(chunks: DataFrame, q: str, top: int | None = None, words: DataFrame | None = None) -> DataFrame:
    """(resource_id, package_id, chunk_index, score): the best chunk that holds all terms, a row a resource (with ``top``, of the best of them).

    With ``words``, postings of chunks by ``chunk_id``, no text is read.
    """
    boosts = {"extracted_text": 1.0}
    if words is None:
        found = bm25(chunks, q, boosts)
    else:
        keyed = chunks.select("resource_id", "package_id", "chunk_index", chunk_id("resource_id", "chunk_index").alias("id"))
        found = keyed.join(index.search(words, q, boosts, keyed), "id")
    best = Window.partitionBy("resource_id").orderBy(F.desc("score"), "chunk_index")
    first = found.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return _best(first, "resource_id", top).select("resource_id", "package_id", "chunk_index", "score")


@dataclass(frozen=True)
class SearchIndex:
    """Kept postings of packages, resources and chunks, and the chunks' keys (resource_id, package_id, chunk_index)."""

    packages: DataFrame
    resources: DataFrame
    content: DataFrame
    chunks: DataFrame


def write_index(catalog: Catalog, path: str, chunks: DataFrame | None = None) -> SearchIndex:
    """The index of a catalog's searchable texts, written under ``path`` and read back."""
    content = (catalog.content if chunks is None else chunks).withColumn("chunk_id", chunk_id("resource_id", "chunk_index"))
    titles = index.texts_of(catalog.package_core, "id", ["title"])
    notes = index.texts_of(catalog.note, "at", ["notes"])
    shared = catalog.with_note_key(catalog.package_core.select("id")).join(index.held(notes, "at").withColumn("at", F.col("at").cast("long")), "at", "left")
    owners = index.held(titles, "id").unionByName(shared.select("id", F.lit("notes").alias("field"), F.coalesce("text", F.lit(index.NO_TEXT)).alias("text"), F.coalesce("len", F.lit(0)).alias("len")))
    index.write_postings(index.postings_from(owners, titles.unionByName(notes)), f"{path}/packages")
    index.write_postings(index.postings_of(catalog.resource, "id", ["name", "description"]), f"{path}/resources")
    index.write_postings(index.postings_of(content, "chunk_id", ["extracted_text"]), f"{path}/content")
    content.select("resource_id", "package_id", "chunk_index").write.parquet(f"{path}/chunks")
    read = lambda name: index.read_postings(catalog.spark, f"{path}/{name}")
    return SearchIndex(read("packages"), read("resources"), read("content"), catalog.spark.read.parquet(f"{path}/chunks"))


def merge_legs(packages: DataFrame, resources: DataFrame, content: DataFrame) -> DataFrame:
    """(id, score, source): one ranking of packages, before paging.

    A package has its own score and the best of its resources' by ``RESOURCE_WEIGHT``; one that only a
    chunk matched has ``CONTENT_SCORE``. ``source`` names the leg that brought it in.
    """
    legs = packages.select("id", F.lit("package").alias("leg"), "score")
    legs = legs.unionByName(resources.select(F.col("package_id").alias("id"), F.lit("resource").alias("leg"), "score"))
    legs = legs.unionByName(content.select(F.col("package_id").alias("id"), F.lit("content").alias("leg"), "score"))
    best = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("score")))
    by = legs.groupBy("id").agg(best("package").alias("p"), best("resource").alias("r"), best("content").alias("c"))
    own = F.coalesce("p", F.lit(0.0)) + F.coalesce(F.col("r") * RESOURCE_WEIGHT, F.lit(0.0))
    score = F.when(F.col("p").isNull() & F.col("r").isNull(), F.lit(CONTENT_SCORE)).otherwise(own)
    source = F.when(F.col("p").isNotNull(), "package").when(F.col("r").isNotNull(), "resource").otherwise("content")
    return by.select("id", score.alias("score"), source.alias("source"))


def ranked_search(catalog: Catalog, q: str, filters: Filters, chunks: DataFrame | None = None, kept: SearchIndex | None = None, top: int | None = None) -> DataFrame:
    """All matching packages (id, score, source, updated); order by score, then the last update. With a ``kept`` index no text is read."""
    packages, resources, content = search_legs(catalog, q, filters, chunks, kept, top)
    return merge_legs(packages, resources, content).join(matching(catalog, filters).select("id", "updated"), "id")


def search_legs(catalog: Catalog, q: str, filters: Filters, chunks: DataFrame | None = None, kept: SearchIndex | None = None, top: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the query finds in the visible packages, in their active resources, and in their chunks of content; with ``top``, of these two only the best."""
    packages = matching(catalog, filters, None if filters.q else catalog.package_core).drop("notes")  # no leg asks for dates
    keys = packages.select(F.col("id").alias("package_id"))
    own = lambda df: df.join(keys, "package_id", "left_semi")
    content = kept.chunks if kept else catalog.content if chunks is None else chunks
    return (
        package_leg(packages if kept or not query_terms(q) else with_note_counts(catalog, packages, q), q, catalog.package_tag, kept and kept.packages),
        resource_leg(own(catalog.resource.where("state = 'active'")), q, top, kept and kept.resources),
        content_leg(own(content), q, top, kept and kept.content),
    )


def ranked_page(catalog: Catalog, q: str, filters: Filters, offset: int = 0, limit: int = 20, chunks: DataFrame | None = None, kept: SearchIndex | None = None, top: int | None = None) -> DataFrame:
    """One page (rank, id, score, source, total): one ranking of all packages by score, last update and id, cut after the merge.

    Without a query: the latest packages, with score 0.
    """
    if query_terms(q):
        found = materialise(ranked_search(catalog, q, filters, chunks, kept, top), "ranking")  # searched once, for the total and the page
    else:
        found = matching(catalog, filters, catalog.package).select("id", F.lit(0.0).alias("score"), F.lit("package").alias("source"), "updated")
    total = found.agg(F.count("*").alias("total"))  # one row
    order = (F.desc("score"), F.col("updated").desc_nulls_last(), F.asc("id"))
    shown = found.orderBy(*order).offset(offset).limit(limit)  # a page at most
    ranks = shown.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset)
    return ranks.join(F.broadcast(total)).select("rank", "id", "score", "source", "total")


def matched_resources(resources: DataFrame, content: DataFrame, ids: DataFrame, cap: int = 100) -> DataFrame:
    """(package_id, resource_id, match_source, chunk_id, place) for the packages ``ids`` of a page, the best ``cap`` of each.

    ``match_source`` is content wherever a chunk matched, also of a resource that its name or description brought in.
    """
    left = resources.select("package_id", F.col("id").alias("resource_id"), F.col("score").alias("own"))
    right = content.select("package_id", "resource_id", F.col("score").alias("inside"), chunk_id("resource_id", "chunk_index").alias("chunk_id"))
    both = left.join(right, ["package_id", "resource_id"], "full").join(ids.select(F.col("id").alias("package_id")), "package_id", "left_semi")
    order = Window.partitionBy("package_id").orderBy(F.col("own").desc_nulls_last(), F.col("inside").desc_nulls_last(), "resource_id")
    source = F.when(F.col("chunk_id").isNotNull(), "content").otherwise("metadata")
    placed = both.select("package_id", "resource_id", source.alias("match_source"), "chunk_id", F.row_number().over(order).alias("place"))
    return placed.where(F.col("place") <= cap)


def chunk_id(resource: str, index: str) -> Column:
    return F.concat_ws("_chunk_", F.col(resource), F.col(index).cast("string"))


def resource_highlights(matched: DataFrame, resources: DataFrame, q: str) -> DataFrame:
    """Matched resources with their marked name and description; null where nothing is marked."""
    marked = lambda c: F.when(F.contains(c, F.lit("<mark>")), c)
    own = resources.withColumnRenamed("id", "resource_id").join(matched.select("resource_id"), "resource_id", "left_semi")
    texts = own.select("resource_id", marked(highlight(F.col("name"), q)).alias("highlighted_name"), marked(highlight(F.col("description"), q)).alias("highlighted_description"))
    return matched.join(texts, "resource_id", "left")


def with_highlights(shown: DataFrame, packages: DataFrame, q: str) -> DataFrame:
    """A page's rows with the marked title and the best stretch of the notes; null where nothing is marked."""
    marked = lambda c: F.when(F.contains(c, F.lit("<mark>")), c)
    texts = packages.join(shown.select("id"), "id", "left_semi").select("id", marked(highlight(F.col("title"), q)).alias("highlighted_title"), fragment(F.col("notes"), q).alias("highlighted_notes"))
    return shown.join(texts, "id", "left")


def with_snippets(matched: DataFrame, chunks: DataFrame, q: str, size: int = 300) -> DataFrame:
    """Matched resources with the best stretch of their chunk; null where no chunk matched."""
    asked = matched.where("chunk_id IS NOT NULL").select("chunk_id")
    texts = chunks.withColumn("chunk_id", chunk_id("resource_id", "chunk_index")).join(asked, "chunk_id", "left_semi")
    return matched.join(texts.select("chunk_id", fragment(F.col("extracted_text"), q, size).alias("snippet")), "chunk_id", "left")


def enriched_page(catalog: Catalog, shown: DataFrame) -> DataFrame:
    """A page's ids with their rows and aggregates, in the page's order; ids that are gone are skipped."""
    rows = package_list(catalog, catalog.package.join(shown.select("id"), "id", "left_semi"))
    return keep_order(shown, rows)


def highlight(text: Column, q: str) -> Column:
    """``text`` with every query term marked, whatever the case, and no tag but the marks."""
    return fragments.marked(text, q)


def fragment(text: Column, q: str, size: int = 200) -> Column:
    """The stretch of at most ``size`` characters with the most query terms (the first of equals), marked; null without one."""
    return fragments.fragment(text, q, size)["fragment"]


def fetch_highlights(chunks: DataFrame, ids: list[str], q: str, size: int = 300) -> DataFrame:
    """(chunk_id, fragment) of the chunks asked for (200 at most)."""
    if len(ids) > 200:
        raise ValueError("at most 200 chunks")
    keyed = chunks.withColumn("chunk_id", chunk_id("resource_id", "chunk_index"))
    some = keyed.where(F.col("chunk_id").isin(*ids)) if ids and query_terms(q) else keyed.limit(0)
    return some.select("chunk_id", fragment(F.col("extracted_text"), q, size).alias("fragment")).where("fragment IS NOT NULL") if query_terms(q) else some.select("chunk_id", F.lit(None).cast("string").alias("fragment"))
