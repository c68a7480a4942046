"""Quality rules, line by line first: lines that fail go, then documents that lost too much.

A line with a word is held against rules in three sets:

- punctuation: it holds no end of a sentence; more than ``SYMBOLS`` of its characters in words are symbols;
  or more than half of its words end in doubled marks;
- navigation: at least ``LINKS`` of its words are bare separators, and these are at least a sixth of all its
  words; or the whole line is an entry of a menu;
- boilerplate: it has at most ``NOTICE`` words, among them a phrase of notices (rights, licenses, cookies,
  scripts, subscriptions), or it repeats an earlier line of the document.

What fails is taken out, and a document is rejected if its lines lost more than ``LOST`` of its words. Rules on
the whole text come before that (too few words, too much repetition); they reject whatever the lines say.

Words are runs without ASCII white space, lines are what newlines separate. Each document is one row, so
nothing is shuffled; a batch is taken in portions of bounded text.

Edge cases: null and empty texts have no words and fail the rules on the whole text; a line without a word is
kept and counts for nothing; one line or word of any length is taken whole; equal rows are judged alike; other
columns are kept as they are, but for those of ``JUDGED``, which are replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import portions

#: Least words of a document, and the most of them (of 100) that may stand in repeated windows.
LEAST_WORDS, REPEATED, WINDOW = 50, 50, 3
SYMBOLS, LINKS, NOTICE, LOST = 0.1, 3, 40, 0.5
JUDGED = "cleaned string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, base_failed boolean, kept boolean"

_SYMBOL = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+").findall
_ENDED = re.compile(r"[.!?…。！？:;][\"'’”»)\]]*(?=[ \t\x0b\x0c\r]|\Z)").search
_DOUBLED = re.compile(r"[!?]{2,}(?=[ \t\x0b\x0c\r]|\Z)").findall
_ODD = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@+]").findall
_BARE = frozenset(["|", "||", "/", ">", ">>", "<", "<<", "»", "«", "·", "•", "›", "→", "*", "-", "::"])
_MENU = re.compile(
    r"(?i)[^0-9a-z]*(?:home|menu|search|log ?in|log ?out|sign (?:in|up)|register|next(?: page)?|previous(?: page)?|back(?: to top)?|read more|learn more|more|"
    r"click here|skip to (?:main )?content|share(?: this)?|print|contact(?: us)?|about(?: us)?|site ?map|help|faq|subscribe|top)[^0-9a-z]*"
).fullmatch
_NOTICE = re.compile(
    r"(?i)all rights reserved|copyright (?:\(c\)|©|[0-9]{4})|© ?[0-9]{4}|licen[sc]ed under|released under the|terms of (?:use|service)|privacy policy|"
    r"(?:uses?|accept) (?:of )?cookies|enable javascript|lorem ipsum|click here to|sign up for our|subscribe to our|powered by "
).search


def line_fault(line: str, words: list[str], seen: bool) -> str | None:
    """Which set of rules a line with these words fails, if any; ``seen`` if it repeats an earlier line."""
    bare = sum(w in _BARE for w in words)
    if _MENU(line) or bare >= LINKS and 6 * bare >= len(words):
        return "navigation"
    if seen or len(words) <= NOTICE and _NOTICE(line):
        return "boilerplate"
    if not _ENDED(line) or 2 * len(_DOUBLED(line)) > len(words) or len(_ODD(line)) > SYMBOLS * len(line):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of words that is found twice or more."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    own = ids
    for k in range(1, window):  # windows by number: pairs of a shorter window and the next word
        own = np.unique(own[: len(words) - k] * len(numbers) + ids[k:], return_inverse=True)[1]
    twice = np.bincount(own)[own] > 1
    held = np.zeros(len(words), bool)
    for k in range(window):
        held[k : k + len(twice)] |= twice
    return int(held.sum())


@dataclass
class Judged:
    """One text's counts, what is left of it, and the verdict."""

    cleaned: str | None
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lost_words: int
    base_failed: bool
    kept: bool


def judge(text: str | None) -> Judged:
    whole = text or ""
    words = whole.encode("utf-8", "replace").split()
    seen: set[str] = set()
    stay, repeats, lost = [], 0, 0
    for line in whole.split("\n"):
        own = _WORDS(line)
        if not own:
            stay.append(line)
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        if line_fault(line, own, again) is None:
            stay.append(line)
        else:
            lost += len(own)
    repeated = repeated_words(words)
    base = len(words) < LEAST_WORDS or 100 * repeated > REPEATED * len(words)
    chars = len(whole) - sum(whole.count(c) for c in _SPACE)
    return Judged(
        None if text is None else "\n".join(stay),
        len(words),
        chars,
        sum(whole.count(c) for c in _SYMBOL),
        repeats,
        repeated,
        lost,
        base,
        not base and lost <= LOST * len(words),
    )


def _judged(rows: DataFrame, text: str, new: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` and those of the verdict that ``new`` names."""
    kinds = dict(c.split() for c in JUDGED.split(", "))
    fields = [f for f in rows.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} {kinds[c]}" for c in new)])

    def each(batches):
        for whole in batches:
            lengths = pc.fill_null(pc.utf8_length(whole.column(text)), 0).to_pylist()
            for part in portions(lengths, 3_000_000):
                batch = whole.slice(part.start, part.stop - part.start)
                found = [judge(t) for t in batch.column(text).to_pylist()]
                arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
                more = [pa.array([getattr(j, c) for j in found], arrow[kinds[c]]) for c in new]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *more], names=[*(f.name for f in fields), *new])

    return rows.mapInArrow(each, schema)


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of ``JUDGED``: the text without failed lines, counts, and whether the document stays."""
    new = [c.split()[0] for c in JUDGED.split(", ")]
    return _judged(df.drop(*new), text, new, [c for c in df.columns if c not in new])


def verdicts(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, base_failed, kept)."""
    new = [c.split()[0] for c in JUDGED.split(", ")][1:]
    return _judged(df.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", new, ["doc_id"])
