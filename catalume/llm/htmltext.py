"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines at block elements. Two rules decide which of them are the site's own.

What stands in a menu, header, footer, sidebar, form, notice, advert or comment by its element, role or
class goes, whether another page shares it or not: most of it changes from page to page, and some pages are
alone on their host. An ``article`` isn't left out by its class, nor is an element with ``WRAPS`` or more of
the page's characters.

Of all other lines, differencing decides. Within each host, pages are ordered by URL path; each is paired
with the neighbour whose path has the longer common prefix (the one before, if equal). The lines that both
share, as a longest common subsequence of all lines, are deleted. Lines in menus and the like take part in
that alignment as anchors, but never match a line of the text, and nothing else comes of them. Of lines inside
an ``article`` or ``main`` element, whose sentences may be quoted by another page, only those are deleted that
both neighbours share, where there are two. If a pair shares nearly all of what could be text (copies of a
page), that neighbour isn't asked; copies on both sides delete nothing. What is left is the text.

The pairing moves only hashes of lines; the text of pages crosses one join.

Edge cases: null html is empty; a null or odd URL counts as host '' with the URL as its path; rows equal in
all three columns are paired once and each get the same text; a page alone on its host keeps its lines;
text that isn't closed ends with the page; input columns other than the three are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Share of a page's characters from which a pair counts as copies, and from which an element that a class
#: word names holds the page and stays.
COPY, WRAPS = 0.8, 0.8

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|math|canvas|object)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:\s++[^\s=>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)\s*+/?>"""
    r"|<(/?)([A-Za-z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
#: Elements without an end, elements that end no line, elements that are no main text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_OUT = frozenset("head nav header footer aside form button select dialog menu noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_OUT_CLASS = re.compile(
    r"(?:^|[\s_-])(?<!\bno[_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|widgets?|footer|masthead|topbar|toolbar|pagination|pager|"
    r"comments?|disqus|replies|respond|share|sharing|social|related|recommended|skip)(?:$|[\s_-])",
    re.I,
)
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)")


def _left_out(name: str, attributes: str) -> str:
    """Why an element is left out: "element" by its name, role or hiding, "class" by its class or id, or ""."""
    if name in _OUT:
        return "element"
    why = ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if name not in ("html", "body", "main") else ():
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
            return "element"
        if key in ("class", "id") and name != "article" and _OUT_CLASS.search(value):
            why = "class"
    return why


def lines(page: str) -> tuple[list[str], list[bool], list[bool]]:
    """The lines of a page; of each whether it stands in an article, and whether in something that is no main text by its element, role or class."""
    out, inside, held, within, left = [], [], [], [], []
    skip, depth, article = "", 0, 0
    # elements left out by class: of each its parent; those open now as [name, depth, number]
    parents: list[int] = []
    wraps: list[list] = []

    def end() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append(text)
                inside.append(article > 0)
                left.append(bool(skip))
                within.append(wraps[-1][2] if wraps else -1)
            held.clear()

    at = 0
    for m in _MARKUP.finditer(page):
        held.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                held.append(" ") if m[1].lower() == "svg" else end()
            continue
        closing = bool(m[2] or m[5])
        if not closing and not article and name != skip and (skip or wraps) and (name == "main" or name == "article" and not _left_out(name, m[4] or "")):
            end()
            skip = ""  # what was left out was never closed
            wraps.clear()
        if name not in _INLINE or name == skip:
            end()
        if skip:
            if name == skip and name not in _VOID:
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
            continue
        if wraps and name == wraps[-1][0]:
            wraps[-1][1] += -1 if closing else 1
            if not wraps[-1][1]:
                end()
                wraps.pop()
        if closing:
            if name in ("article", "main"):
                article = max(0, article - 1)
        elif name not in _VOID and not (name == "header" and article) and (why := _left_out(name, m[4] or "")):
            end()
            if why == "class":
                if wraps and name == wraps[-1][0]:
                    wraps[-1][1] -= 1  # its end closes this element
                wraps.append([name, 1, len(parents)])
                parents.append(wraps[-2][2] if len(wraps) > 1 else -1)
            else:
                if wraps and name == wraps[-1][0]:
                    wraps[-1][1] -= 1
                skip, depth = name, 1
        elif name in ("article", "main"):
            article += 1
    held.append(page[at:])
    end()
    if not parents:
        return out, inside, left
    sizes = [0] * len(parents)
    for text, wrap, gone in zip(out, within, left, strict=True):
        if wrap >= 0 and not gone:
            sizes[wrap] += len(text)
    for wrap in range(len(parents) - 1, -1, -1):
        if parents[wrap] >= 0:
            sizes[parents[wrap]] += sizes[wrap]
    least, stays = WRAPS * sum(len(x) for x, gone in zip(out, left, strict=True) if not gone), []
    for wrap, parent in enumerate(parents):
        stays.append(sizes[wrap] >= least and (parent < 0 or stays[parent]))
    return out, inside, [gone or wrap >= 0 and not stays[wrap] for gone, wrap in zip(left, within, strict=True)]


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    m = _URL.match(url or "")
    return (m[1].lower(), m[2] or "/") if m else ("", url or "")


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, by bit vectors over ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[int, int] = {}
    for j, x in enumerate(mid_b):
        where[x] = where.get(x, 0) | 1 << j
    full, rows = (1 << len(mid_b)) - 1, []
    row = full  # a zero bit at j: the subsequence grows by one at mid_b[j]
    for x in mid_a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, j = [], len(mid_b)
    for i in range(len(mid_a) - 1, -1, -1):
        here = (~rows[i] & full) & ((1 << j) - 1)
        above = (~rows[i - 1] & full if i else 0) & ((1 << j) - 1)
        if here.bit_count() > above.bit_count():
            found.append(head + i)
            # the match is the last place below j where this row, and not the one above, counts it
            own = where.get(mid_a[i], 0) & ((1 << j) - 1)
            while own:
                k = own.bit_length() - 1
                if ((~rows[i - 1] & full if i else 0) & ((1 << k) - 1)).bit_count() + 1 == here.bit_count():
                    break
                own &= ~(1 << k)
            j = k
    return [*range(head), *reversed(found), *range(len(a) - tail, len(a))]


def _prefix(a: str | None, b: str | None) -> int:
    n = min(len(a or ""), len(b or ""))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _cut(own, sizes, inside, path, pairs) -> list[int]:
    """Which lines of a page are the site's, given (path, lines) of its neighbours on the same host.

    ``sizes`` is 0 for lines that are no main text anyway; ``inside`` tells lines of an article.
    """
    shared = []
    for _, _, other in sorted(((_prefix(path, p), -i, list(h)) for i, (p, h) in enumerate(pairs)), reverse=True):
        at = common_lines(own, other)
        if sum(sizes[i] for i in at) < COPY * sum(sizes) or not any(sizes):
            shared.append(at)
    if not shared:
        return []
    both = set(shared[-1])
    return [i for i in shared[0] if i in both or not inside[i]]


_KEY = "row long, host string, path string"


def _parsed(pages: DataFrame) -> DataFrame:
    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    rows = pages.select(*cols)
    return rows.withColumn("row", F.xxhash64(F.struct("page_id", "url", "html")))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    rows = _parsed(pages)

    def hashed(batches):
        for batch in batches:
            out = []
            for row, url, page in zip(batch["row"], batch["url"], batch["html"], strict=True):
                text, inside, left = lines(page or "")
                marks = [xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), gone) - 2**63 for x, gone in zip(text, left, strict=True)]
                out.append((row, *place(url), marks, [0 if gone else len(x) for x, gone in zip(text, left, strict=True)], inside))
            yield pd.DataFrame(out, columns=["row", "host", "path", "lines", "sizes", "inside"])

    marks = rows.mapInPandas(hashed, _KEY + ", lines array<long>, sizes array<int>, inside array<boolean>").dropDuplicates(["row"])
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = marks.repartitionByRange(parts, "host", "path", "row").withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "pages")
    seen = F.struct("host", "path", "lines")
    within = Window.partitionBy("part").orderBy("host", "path", "row")
    # of the first and the last page of each part, the one beside it in the next part: keys first, their lines after
    key = F.struct("host", "path", "row")
    ends = ordered.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    along = Window.orderBy("part")  # a row a part, without lines
    ends = ends.select("part", F.lag("last").over(along)["row"].alias("row_before"), F.lead("first").over(along)["row"].alias("row_after"))
    ends = materialise(ends, "ends")
    lines_of = ordered.join(ends.select(F.explode(F.array("row_before", "row_after")).alias("row")).distinct(), "row", "left_semi").select("row", seen.alias("seen"))
    for side in ("before", "after"):
        ends = ends.join(lines_of.toDF(f"row_{side}", "last_before" if side == "before" else "first_after"), f"row_{side}", "left")
    near = ordered.withColumns({"before": F.lag(seen).over(within), "after": F.lead(seen).over(within)}).join(ends, "part")
    pairs = near.select("row", "host", "path", "lines", "sizes", "inside", F.coalesce("before", "last_before").alias("before"), F.coalesce("after", "first_after").alias("after"))
    pairs = pairs.where(F.size("lines") > 0)

    def cuts(batches):
        for batch in batches:
            out = []
            for row, host, path, own, sizes, inside, *beside in batch.itertuples(index=False):
                drop = _cut(list(own), list(sizes), list(inside), path, [(p["path"], p["lines"]) for p in beside if p is not None and p["host"] == host])
                if drop := [i for i in drop if sizes[i]]:  # the others go by what they stand in
                    out.append((row, drop))
            yield pd.DataFrame(out, columns=["row", "drop"])

    deleted = materialise(pairs.mapInPandas(cuts, "row long, drop array<int>"), "cuts")

    def texts(batches):
        for batch in batches:
            found = [[None if gone else x for x, gone in zip(text, left, strict=True)] for text, _, left in (lines(page or "") for page in batch["html"])]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "row": batch["row"], "lines": found})

    shown = rows.mapInPandas(texts, "page_id long, url string, row long, lines array<string>")
    # a small list of deletions goes to every task, a large one by a shuffle
    deleted = F.broadcast(deleted) if deleted.count() <= 20_000 else deleted
    joined = shown.join(deleted, "row", "left")
    left = F.filter("lines", lambda _, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False)))
    text = F.array_join(F.when(F.col("drop").isNull(), F.col("lines")).otherwise(left), " ")  # nulls are skipped
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
