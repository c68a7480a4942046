"""Personal data in texts, and terms that give it away.

Base spans are matches of fixed patterns (email, ip, card, phone), found per kind from left to right without
overlap; matches that fail the kind's test (parts at most 255; 12 to 19 digits with a right Luhn sum; 9 to
15 digits) are dropped.

The method then asks the corpus which other terms reveal a protected entity, as one that always stands
in documents with one address does. For each entity (kind and value) and each term that stands outside the
base spans of a document with the entity, texts with both are counted; so are, over the whole corpus, the
texts of the term and of the entity. Copies of a text are no further evidence and count once. P(e|t) is
(n(t,e) + A P(e)) / (n(t) + A) with A = ``PRIOR`` texts, so that a term of few texts is drawn towards no
information. A term discloses an entity if it leaves at most ``LEFT`` bits, -log2 P(e|t), of the entity open,
and tells at least ``GAINS`` bits, log2(P(e|t) / P(e)), about it; the second bound keeps out entities that
stand in a large share of all texts. Neither the prior nor the bounds depend on the number of documents: with
two texts of prior and one bit, a term of a single text never discloses anything, one of two does if both
hold the entity, one of four if three do. Such a term is a term span (kind ``term``) wherever it occurs outside
base spans. Sanitising generalises every span to its kind, as in ``[EMAIL]`` or ``[TERM]``.

Base spans, terms and hashes of all rows are written once, and everything after reads them. Counting is
bounded without a loss: an entity or a term that couldn't reach the bounds whatever the rest is left out
before pairs are made. The terms' places are found without spreading the corpus: texts with entities are
known from the count; the others are searched only for terms that occur outside of those, and only words that
pass a sieve go through a shuffle. A sieve is a table of ``CELLS`` x 64 bits, whatever the data, with a bit set
for each key; it keeps all keys and few others, and the join behind it decides. Texts that hold such a term
pass a sieve likewise, so the rest of the corpus isn't shuffled.

Everything is DataFrame functions. A term is counted once a text by partial sums. Texts are told apart
by 128 bits of hash.

Edge cases: null and empty texts have no spans; a null id is kept; equal texts have equal
spans; a text may be one long line or one long word; positions are code points, ends exclusive; an empty
table gives an empty result; other columns are kept as they are by ``all_spans`` and ``sanitise``, but
for ``base`` and ``spans``, which ``all_spans`` replaces.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sieved, text_or_empty

#: Kinds in order, and their patterns. Each start is tried where a run begins (or the last
#: match ended) and runs aren't given back: the same matches as the plain patterns, in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PRIOR, LEFT, GAINS = 2.0, 1.0, 2.0
_OPEN, _CLOSE = "", ""  # marks around a match; where a text holds them they count as "|"
_TERM = r"\p{L}[\p{L}\p{M}\p{N}_]*+"


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is right."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


def _found(text: Column, kind: str, pattern: str, check) -> Column:
    """Matches of a pattern as (kind, start, end, match): the text is cut at marks set around them."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), part.alias("match"))
        hit = (acc["i"] % 2 == 1) & check(part)
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.when(hit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def base_spans(df: DataFrame, text: str = "text", to: str = "base") -> DataFrame:
    """``df`` with the base spans of a text column, by start and kind."""
    plain = F.replace(F.replace(text_or_empty(text), F.lit(_OPEN), F.lit("|")), F.lit(_CLOSE), F.lit("|"))
    df = df.withColumn("__plain", plain)
    t, none, found = F.col("__plain"), F.array().cast(_SPAN), []
    some = {
        "email": F.contains(t, F.lit("@")),
        "ip": F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": F.contains(t, F.lit("+")) & t.rlike(r"\+[0-9]"),
    }
    for kind in KINDS:
        found.append(F.when(some[kind], _found(t, kind, PATTERNS[kind], functools.partial(_valid, kind))).otherwise(none))
    return df.withColumn(to, _sorted(F.concat(*found))).drop("__plain")


def _sorted(spans: Column) -> Column:
    """Spans by start, then kind."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"), s["match"].alias("match"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))


def _replaced(text: Column, spans: str, by) -> Column:
    """A text with its spans replaced; of overlapping spans the first counts."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        more = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), by(s))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["parts"], more).alias("parts"))).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def _words(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _prepared(df: DataFrame, text: str) -> DataFrame:
    """``df`` with base spans, its distinct terms, those outside base spans, a number and two hashes of the text; written once."""
    bare = F.when(F.size("base") > 0, _words(_replaced(text_or_empty(text), "base", lambda s: F.lit(" "))))
    k1, k2 = F.xxhash64(F.col(text)).alias("__k1"), F.xxhash64(F.lit(1), F.col(text)).alias("__k2")
    made = base_spans(df, text).select("*", k1, k2, _words(text_or_empty(text)).alias("__terms"), bare.alias("__bare"), F.monotonically_increasing_id().alias("__doc"))
    return materialise(made, "spans")


def _once(made: DataFrame) -> DataFrame:
    """One row of each text; only rows that pass a sieve of the further copies are shuffled."""
    slim = made.select("__doc", "__k1", "__k2")
    first = slim.groupBy("__k1", "__k2").agg(F.min("__doc").alias("__doc"))
    more = materialise(slim.select("__doc").join(first.select("__doc"), "__doc", "left_anti"), "copies")
    held = sieved(made.select("__doc", "__k1", "__k2", "base", "__terms", "__bare"), F.xxhash64("__doc"), more.select(F.xxhash64("__doc").alias("key")))
    return held.where("NOT __maybe").unionByName(held.where("__maybe").join(more, "__doc", "left_anti")).drop("__maybe")


def _counted(made: DataFrame, prior: float, left: float, gains: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts; (k1, k2, term, n_term) of those with entities, for terms that may disclose one; (term, n_term, ratio, n_held) of those that do.

    ``n_held`` is in how many texts with entities the term stands outside base spans.
    """
    entity = lambda s: F.concat_ws(":", s["kind"], F.lower(s["match"]))
    texts = _once(made)
    n = float(made.select("__k1", "__k2").distinct().count())
    docs = texts.where(F.size("base") > 0)
    held = docs.select(F.col("__doc").alias("doc"), F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    n_entity = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # the most texts that a term may have: P(e|t) >= the least that discloses, with n(t,e) <= n(e)
    share = F.col("n_entity") / F.lit(max(n, 1.0))
    enough = F.greatest(share * 2.0**gains, F.lit(2.0**-left))
    most = (F.col("n_entity") + prior * share) / enough - prior + 1e-6
    asked = materialise(held.join(n_entity.withColumn("most", most).where("most >= 1"), "entity"), "asked")
    bound = asked.agg(F.max("most")).first()[0]
    words = texts.select(F.explode("__terms").alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") <= F.lit(0.0 if bound is None else bound))
    inside = docs.join(asked.select(F.col("doc").alias("__doc")).distinct(), "__doc", "left_semi")
    rare = materialise(inside.select(F.col("__doc").alias("doc"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.explode("__bare").alias("term")).join(terms, "term"), "rare")
    pairs = rare.join(asked, "doc").where(F.col("n_term") <= F.col("most"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    given = (F.col("n_both") + prior * share) / (F.col("n_term") + F.lit(prior))
    scored = together.where((F.log2(given / share) >= gains - 1e-9) & (-F.log2(given) <= left + 1e-9)).withColumn("ratio", F.log(given / share) / F.log(1 / share))
    found = scored.groupBy("term").agg(F.max("ratio").alias("ratio"))
    n_held = rare.groupBy("term").agg(F.first("n_term").alias("n_term"), F.count("*").alias("n_held"))
    return texts, rare.drop("doc"), found.join(n_held, "term")


def disclosing_terms(df: DataFrame, text: str = "text", prior: float = PRIOR, left: float = LEFT, gains: float = GAINS) -> DataFrame:
    """(term, ratio) of the terms that reveal an entity, with the largest share of an entity's information that each tells."""
    return _counted(_prepared(df.drop("base", "spans"), text), prior, left, gains)[2].select("term", "ratio")


def all_spans(df: DataFrame, text: str = "text", prior: float = PRIOR, left: float = LEFT, gains: float = GAINS) -> DataFrame:
    """``df`` with ``base`` and ``spans`` (base and term spans): arrays of (kind, start, end, match).

    Columns of these names are replaced.
    """
    made = _prepared(df.drop("base", "spans"), text)
    texts, rare, terms = _counted(made, prior, left, gains)
    terms = materialise(terms, "terms")
    inside = rare.join(terms.select("term"), "term").select("k1", "k2", "term")
    # terms of texts without a word of an entity beside them: these are searched
    abroad = materialise(terms.where("n_held < n_term").select("term", F.xxhash64("term").alias("key")), "abroad")
    words = texts.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.explode("__terms").alias("term"))
    outside = sieved(words, F.xxhash64("term"), abroad).where("__maybe").select("k1", "k2", "term").join(abroad.select("term"), "term")
    hits = inside.unionByName(outside.select("k1", "k2", "term")).distinct().groupBy("k1", "k2").agg(F.collect_list("term").alias("__hits"))
    hits = materialise(hits.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), "hits")
    passed = sieved(made.drop("__terms", "__bare", "__doc"), F.col("__k1"), hits.select(F.col("__k1").alias("key")))
    clear = passed.where("NOT __maybe").drop("__maybe", "__k1", "__k2").withColumn("spans", F.col("base"))
    held = passed.where("__maybe").drop("__maybe").join(hits, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    own = F.filter(
        _found(F.replace(F.replace(text_or_empty(text), F.lit(_OPEN), F.lit("|")), F.lit(_CLOSE), F.lit("|")), "term", _TERM, lambda m: F.array_contains("__hits", F.lower(m))),
        lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])),
    )
    marked = held.withColumn("spans", F.when(F.size("__hits") > 0, _sorted(F.concat("base", own))).otherwise(F.col("base"))).drop("__hits")
    return clear.unionByName(marked)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with its spans replaced in the text: base spans by ``[KIND]``, terms by ``[TERM]``.

    Of overlapping spans the first is replaced. Columns keep their names and order; null texts stay null.
    """
    spanned = all_spans(df, text, **options)
    whole = _replaced(F.col(text), "spans", lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return spanned.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(F.col(text))).select(*[F.col(f"`{c}`") for c in df.columns])


def report(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    found = all_spans(df.select(F.col(id).alias("doc_id"), F.col(text).alias("text")))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
