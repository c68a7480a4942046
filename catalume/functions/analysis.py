"""Words of texts for search, with or without spaces between them.

Runs of letters and digits are words, in lower case. A run of Han or kana has no spaces to be cut at: it
becomes overlapping pairs of characters, and its last character alone, so that every stretch of it is a
sequence of neighbouring pairs. A query's run of Han or kana is asked for as such a sequence (a phrase); a
single character is asked for as the beginning of a pair.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: scripts that are written without spaces, with the mark that lengthens a vowel.
_SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
_PLAIN_RUN = rf"[\p{{L}}\p{{N}}&&[^{_SCRIPTS}]]"
RUNS = rf"[{_SCRIPTS}]+|{_PLAIN_RUN}+"
#: Fixed value: no character of these scripts comes before this one.
_FIRST = 0x2E80
_DENSE_SET = "々-〇ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ\U00020000-\U0003ffff"
_PLAIN = re.compile(f"[{_DENSE_SET}]+|[^\\W_{_DENSE_SET}]+")
_DENSE = re.compile(f"[{_DENSE_SET}]")
#: A word's place is the number of its run, shifted, plus its place in the run.
RUN_BITS = 32


@dataclass(frozen=True)
class Asked:
    """What a query asks for: a word as it is, or a stretch of Han or kana."""

    text: str

    @property
    def dense(self) -> bool:
        return _DENSE.match(self.text) is not None

    @property
    def pairs(self) -> list[str]:
        return [self.text[i : i + 2] for i in range(max(1, len(self.text) - 1))]


def asked(q: str) -> list[Asked]:
    """The distinct words and stretches of a query, in order."""
    return [Asked(t) for t in dict.fromkeys(_PLAIN.findall(q.lower()))]


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _ascii(text: Column) -> Column:
    """Whether a text has ASCII characters alone, for which a short class tells what the long ones do."""
    return F.octet_length(text) == F.length(text)


def runs(text: Column) -> Column:
    low = _lower(text)
    return F.when(_ascii(low), F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))).otherwise(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0)))


def _words(run: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(2)))
    return F.when((F.ascii(run) >= _FIRST) & run.rlike(rf"^[{_SCRIPTS}]"), pairs).otherwise(F.array(run))


def words(text: Column) -> Column:
    """The words of a text: an array of strings."""
    return F.flatten(F.transform(runs(text), _words))


def plain_words(text: Column) -> Column:
    """The words that aren't pairs of Han or kana: an array of strings."""
    low = _lower(text)
    return F.when(_ascii(low), F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))).otherwise(F.regexp_extract_all(low, F.lit(rf"{_PLAIN_RUN}+"), F.lit(0)))


def has_pairs(text: Column) -> Column:
    """Whether a text has Han or kana."""
    return ~_ascii(text) & text.rlike(f"[{_SCRIPTS}]")


def placed_pairs(text: Column) -> Column:
    """The pairs of Han and kana with their places: an array of (term, at); neighbours in one run have neighbouring places."""
    of_run = lambda run, j: F.transform(_words(run), lambda w, i: F.struct(w.alias("term"), (F.shiftleft(j.cast("long"), RUN_BITS) + i).alias("at")))
    return F.flatten(F.transform(F.regexp_extract_all(_lower(text), F.lit(f"[{_SCRIPTS}]+"), F.lit(0)), of_run))


def length(text: Column) -> Column:
    """How many words a text has; they are only counted."""
    low = _lower(text)
    return F.when(_ascii(low), F.regexp_count(low, F.lit("[a-z0-9]++"))).otherwise(F.regexp_count(low, F.lit(rf"[{_SCRIPTS}]|{_PLAIN_RUN}++")))


def occurrences(text: Column, a: Asked) -> Column:
    """How often a text holds what is asked for, without its words being made: a word between others, or a stretch at any place."""
    low, asked = _lower(text), re.escape(a.text)
    pattern = rf"(?={asked})" if a.dense else rf"{asked}(?<!{_PLAIN_RUN}{asked})(?!{_PLAIN_RUN})"  # its letters first, what is around only where they are
    return F.when(F.contains(low, F.lit(a.text)), F.regexp_count(low, F.lit(pattern))).otherwise(F.lit(0))
