"""The best stretch of a text for a query, from the places of its words.

Each hit (a query's word, whatever the case) has a start and an end in characters. Of the windows of
``size`` characters that begin with a hit the one with the most whole hits is taken, the first of equals; it
is then moved to the left by half of what is spare, and its hits are marked. A text is read once, and no
window is cut out but the one that is shown.

Edge cases: a null text, one without a hit and a query without words give null; a hit longer than the window
counts for nothing; tags other than marks are taken out before, so that none is cut in half; characters that
are used as marks inside are replaced by "|" where a text holds them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import analysis
from .scalars import strip_tags_but_mark

_OPEN, _CLOSE = "\ue000", "\ue001"  # marks around a hit inside
_HIT = "array<struct<start:int,end:int>>"


def pattern(q: str) -> str | None:
    """A pattern for the query's words; those of scripts with spaces as whole words only."""
    found = sorted(analysis.asked(q), key=lambda a: -len(a.text))
    dense = [re.escape(a.text) for a in found if a.dense]
    letter = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]"
    plain = [rf"{w}(?<!{letter}{w})" for w in (re.escape(a.text) for a in found if not a.dense)]  # its letters first, what is around only where they are
    parts = [f"(?:{'|'.join(dense)})"] if dense else []
    parts += [rf"(?:{'|'.join(plain)})(?!{letter})"] if plain else []
    return f"(?iu)({'|'.join(parts)})" if parts else None


def marked(text: Column, q: str) -> Column:
    """``text`` with every hit marked, and no tag but the marks."""
    found = pattern(q)
    return F.regexp_replace(strip_tags_but_mark(text), found, "<mark>$1</mark>") if found else strip_tags_but_mark(text)


def _clean(text: Column) -> Column:
    return F.regexp_replace(strip_tags_but_mark(text), f"[{_OPEN}{_CLOSE}]", "|")


def hits(text: Column, q: str) -> Column:
    """(start, end) of each hit, in order; ``text`` without tags."""
    parts = F.split(F.regexp_replace(text, pattern(q) or "(?!)", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(_HIT).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, begin, step, lambda acc: acc["found"])


def window(found: Column, length: Column, size: int) -> Column:
    """(n, start, end) of the best window over hits in order; null without a hit that fits in one."""

    # the window of hits ``left`` to ``i`` grows by a hit that fits or moves on by one, and never shrinks
    begin = F.struct(F.lit(0).alias("left"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(acc: Column, h: Column) -> Column:
        fits = h["end"] <= F.get(found, acc["left"])["start"] + size
        more = F.struct(acc["left"].alias("left"), (acc["i"] + 1).alias("i"), (acc["i"] - acc["left"] + 1).alias("n"), F.get(found, acc["left"])["start"].alias("start"), h["end"].alias("end"))
        same = F.struct((acc["left"] + 1).alias("left"), (acc["i"] + 1).alias("i"), acc["n"].alias("n"), acc["start"].alias("start"), acc["end"].alias("end"))
        return F.when(F.coalesce(fits, F.lit(False)), more).otherwise(same)

    best = F.aggregate(found, begin, step)
    spare = F.lit(size) - (best["end"] - best["start"])
    start = F.greatest(F.lit(0), best["start"] - F.floor(spare / 2).cast("int"))
    return F.when(best["n"] > 0, F.struct(best["n"].alias("n"), start.alias("start"), F.least(length, start + size).alias("end")))


def fragment(text: Column, q: str, size: int = 200) -> Column:
    """(n, start, end, fragment): the best window of a text with its hits marked; null without one."""
    if not analysis.asked(q):
        return F.lit(None).cast("struct<n:int,start:int,end:int,fragment:string>")

    def shown(t: Column) -> Column:
        """From a text bound once, its hits bound once, and the window bound once."""
        of_hits = F.transform(F.array(hits(t, q)), lambda found: F.struct(found.alias("found"), window(found, F.length(t), size).alias("w")))
        return F.transform(of_hits, lambda x: F.when(x["w"].isNotNull(), F.struct(x["w"]["n"].alias("n"), x["w"]["start"].alias("start"), x["w"]["end"].alias("end"), cut(t, x["found"], x["w"]).alias("fragment"))))[0]

    def cut(t: Column, found: Column, w: Column) -> Column:
        inside = F.filter(found, lambda h: (h["start"] >= w["start"]) & (h["end"] <= w["end"]))
        begin = F.struct(w["start"].alias("at"), F.lit("").alias("out"))

        def step(acc: Column, h: Column) -> Column:
            out = F.concat(acc["out"], F.substring(t, acc["at"] + 1, h["start"] - acc["at"]), F.lit("<mark>"), F.substring(t, h["start"] + 1, h["end"] - h["start"]), F.lit("</mark>"))
            return F.struct(h["end"].alias("at"), out.alias("out"))

        return F.aggregate(inside, begin, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, w["end"] - acc["at"])))

    return F.transform(F.array(_clean(text)), shown)[0]
