import os

import numpy as np
import pytest

from catalume.llm import htmltext

SCHEMA = "page_id long, url string, html string, row string, text string, host string"


def run(spark, pages):
    df = spark.createDataFrame([(*p, "r", "t", "h") for p in pages], SCHEMA)
    return {r.page_id: r.text for r in htmltext.main_text(df).collect()}


def kept(page):
    text, inside, left = htmltext.lines(page)
    return [x for x, gone in zip(text, left, strict=True) if not gone], [i for i, gone in zip(inside, left, strict=True) if not gone]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><nav>menu</nav><article><h1>Title &amp; more</h1><p>One\n  two<br>three</p></article><footer>foot</footer>", "Title & more One two three"),
        ("<article><header><h1>Head</h1></header><p>Text</p><aside>side</aside><form><input>x</form></article>", "Head Text"),
        ("<main><p>a<script>var x='</p>'</script>b</p><style>p{}</style><div class='comments'><p>reader</p></div></main>", "a b"),
        ("<p>caf&eacute; &#x1F600; &lt;tag&gt; &nbsp; x</p>", "café \U0001f600 <tag> x"),
        ("<div class='cookie-notice'>accept</div><div id=sidebar>s</div><p>kept</p>", "kept"),
        ("<p>unclosed <b>bold <p>next", "unclosed bold next"),
        ("<!-- c --><p title='a>b'>x</p><!-- open", "x"),
        ("plain text", "plain text"),
        ("", ""),
        (None, ""),
        ("<p>" + "word " * 50_000 + "</p>", "word " * 49_999 + "word"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<" * 20_000, "<" * 20_000),
    ],
)
def test_one_page(page, want):
    text, inside = kept(page or "")
    assert " ".join([x for x, i in zip(text, inside, strict=True) if i] if any(inside) else text) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div style='overflow:hidden'><p title='hidden treasure' data-id='nav'>text</p></div><p hidden>gone</p>", "text"),
        ("<article class='hentry category-social'><p>one</p></article><article class='post comments-open' style='overflow:hidden'>two</article>", "one two"),
        ("<div class='content no-sidebar'><p>body of the page</p></div><p>end</p>", "body of the page end"),
        ("<div class='page widget'><p>a long body of the page</p><div class='sidebar'>side</div></div>", "a long body of the page"),
        ("<div id=share><div>x</div>y</div><div class='sidebar'><div class='menu'>m</div>s</div><p>the text of the page is longer</p>", "the text of the page is longer"),
    ],
)
def test_main_text_is_not_left_out_by_loose_words(page, want):
    assert " ".join(kept(page)[0]) == want


def longest(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(1, 8), rng.integers(0, 25)).tolist() for _ in range(2))
        at = htmltext.common_lines(a, b)
        assert at == sorted(set(at)) and len(at) == longest(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at)


def site(k, body):
    return f"<div>Our site</div><div>Home | About</div><p>{body}</p><div>Written by {k}</div><div>All rights kept</div>"


def test_lines_shared_with_the_nearest_page_go(spark):
    pages = [(i, f"https://a.example/x/{i}", site(i, f"Body of page {i} is its own text")) for i in range(30)]
    pages += [(100, "https://alone.example/only", site(100, "alone")), (101, None, site(101, "no url")), (102, "https://a.example/empty", None)]
    got = run(spark, pages)
    for i in range(30):
        assert got[i] == f"Body of page {i} is its own text Written by {i}"
    assert got[100].startswith("Our site") and "alone" in got[100] and got[102] == ""


def test_copies_delete_nothing_of_each_other(spark):
    same = "<p>first line of text</p><p>second line of text</p>"
    got = run(spark, [(1, "https://b.example/a", same), (2, "https://b.example/b", same), (2, "https://b.example/b", same)])
    assert got == {1: "first line of text second line of text", 2: "first line of text second line of text"}


def test_whole_table_against_plain_differencing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_text(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        text, inside = kept(r.html)
        want = " ".join(x for x, i in zip(text, inside, strict=True) if i)
        assert want and got[r.page_id] == (want, len(want))


def test_lines_inside_articles_are_differenced_too(spark):
    page = "<article><p>Follow us</p><p>{0} has a text of its own, about {0}</p></article><article>teaser {0}</article><p>also main {0}</p>"
    got = run(spark, [(i, f"https://c.example/{i}", page.format(f"story{i}")) for i in range(6)])
    assert got == {i: f"story{i} has a text of its own, about story{i} teaser story{i} also main story{i}" for i in range(6)}


def paired(rows):
    """Of each page by brute force over its host: (id, lines, inside, left out, neighbours' lines by nearness)."""
    pages = sorted((*htmltext.place(r["url"]), r["page_id"], *htmltext.lines(r["html"] or "")) for r in rows)
    for k, (host, path, page, text, inside, left) in enumerate(pages):
        beside = [(-len(os.path.commonprefix([path, pages[j][1]])), n, list(zip(pages[j][3], pages[j][5], strict=True))) for n, j in enumerate((k - 1, k + 1)) if 0 <= j < len(pages) and pages[j][0] == host]
        yield page, text, inside, left, [x for *_, x in sorted(beside)]


def in_common(a, b):
    """Places in ``a`` of a longest common subsequence, by the plain table."""
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i, j] = table[i + 1, j + 1] + 1 if a[i] == b[j] else max(table[i + 1, j], table[i, j + 1])
    return int(table[0, 0])


def test_whole_table_against_differencing_by_brute_force(spark):
    """The deleted lines are shared with the paired page, as many as can be, and inside articles with both neighbours."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    rows = [r.asDict() for r in df.collect()]
    shared = 0
    for page, text, inside, left, beside in paired(rows):
        free = [i for i, gone in enumerate(left) if not gone]
        asked = [b for b in beside if sum(len(text[i]) for i in free if (text[i], False) in b) < htmltext.COPY * sum(len(text[i]) for i in free)]
        stays = [text[i] for i in free if not asked or (text[i], False) not in asked[0] or inside[i] and any((text[i], False) not in b for b in asked)]
        most = [text[i] for i in free]
        assert len(" ".join(stays)) <= len(got[page]) <= len(" ".join(most))
        if not any((text[i], False) in b for b in asked for i in free):
            assert got[page] == " ".join(most)
        shared += sum(in_common(list(zip(text, left, strict=True)), b) for b in asked[:1])
    assert len(got) == len(rows) and shared > 20


def test_sentences_that_one_page_quotes_stay_in_an_article(spark):
    page = "<div>Site line</div><article><p>Follow us</p><p>{0} has a text of its own</p>{1}</article>"
    quote = "<p>A sentence that two pages hold</p>"
    got = run(spark, [(i, f"https://d.example/{i}", page.format(f"story{i}", quote if i in (2, 3) else "")) for i in range(6)])
    assert got == {i: f"story{i} has a text of its own" + (" A sentence that two pages hold" if i in (2, 3) else "") for i in range(6)}


def test_empty_table(spark):
    assert htmltext.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


class Tree:
    """A page by the standard library's parser, as a tree of [name, attributes, children]; written apart from the operator."""

    VOID = set("area base br col embed hr img input link meta param source track wbr".split())
    SILENT = set("script style noscript template svg iframe textarea title math canvas object".split())

    def __init__(self, page):
        from html.parser import HTMLParser

        root = ["", {}, []]
        stack = [root]

        class Parser(HTMLParser):
            def handle_starttag(self, tag, attrs):
                node = [tag, {k: v or "" for k, v in attrs}, []]
                stack[-1][2].append(node)
                if tag not in Tree.VOID:
                    stack.append(node)

            def handle_startendtag(self, tag, attrs):
                stack[-1][2].append([tag, dict(attrs), []])

            def handle_endtag(self, tag):
                names = [n[0] for n in stack]
                if tag in names[1:]:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]

            def handle_data(self, data):
                stack[-1][2].append(data)

        Parser().feed(page)
        self.root = root

    def lines(self):
        """(text, in an article, left out) of each block."""
        out, held = [], []

        def flush(article, gone):
            text = " ".join("".join(held).split())
            if text:
                out.append((text, article, gone))
            held.clear()

        def walk(node, article, gone):
            name, attrs, children = node
            block = name not in htmltext._INLINE
            if name in Tree.SILENT:
                return
            if block:
                flush(article, gone)
            words = " ".join([attrs.get("class", ""), attrs.get("id", "")])
            inner = gone or name in htmltext._OUT and not (name == "header" and article) or attrs.get("role", "") in htmltext._ROLES or "hidden" in attrs
            inner = inner or name not in ("html", "body", "main", "article") and bool(htmltext._OUT_CLASS.search(words))
            into = article or name in ("article", "main")
            for child in children:
                if isinstance(child, str):
                    held.append(child)
                else:
                    if child[0] not in htmltext._INLINE:
                        flush(into, inner)
                    walk(child, into, inner)
                    if child[0] not in htmltext._INLINE:
                        flush(into, inner)
            if block:
                flush(into, inner)

        walk(self.root, False, False)
        flush(False, False)
        return out


def plain_texts(pages):
    """Every page's text: lines by a tree, neighbours by a sort, common lines by a table."""
    from urllib.parse import urlsplit

    read = []
    for page_id, url, page in pages:
        parts = urlsplit(url or "")
        read.append((parts.netloc.lower() if parts.netloc else "", parts.path or "/", page_id, Tree(page or "").lines()))
    out, order = {}, sorted(read, key=lambda r: r[:3])
    for i, (host, path, page_id, own) in enumerate(order):
        shared = []
        beside = [(order[j], j - i) for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][0] == host]
        beside.sort(key=lambda b: (-len(os.path.commonprefix([path, b[0][1]])), b[1]))
        for (_, _, _, other), _ in beside:
            at = common_places([(t, g) for t, _, g in own], [(t, g) for t, _, g in other])
            size = lambda k: 0 if own[k][2] else len(own[k][0])
            whole = sum(map(size, range(len(own))))
            if not whole or sum(map(size, at)) < 0.8 * whole:
                shared.append(at)
        drop = set()
        if shared:
            drop = {k for k in shared[0] if k in set(shared[-1]) or not own[k][1]}
        out[page_id] = " ".join(t for k, (t, _, gone) in enumerate(own) if not gone and k not in drop)
    return out


def common_places(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_whole_table_against_another_parser_and_a_plain_table(spark):
    """Texts of all pages; where two alignments are equally long the choice may differ, and no more than that."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = plain_texts([(r.page_id, r.url, r.html) for r in pages.collect()])
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    assert got.keys() == want.keys() and any(want.values())
    differ = [i for i in got if got[i] != want[i]]
    assert len(differ) <= 0.01 * len(got), [(got[i][:300], want[i][:300]) for i in differ[:2]]
