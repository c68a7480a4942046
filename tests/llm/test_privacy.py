import hashlib
import random
import re

import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from catalume.llm import common, privacy

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def check(df, rows):
    got = privacy.report(df).collect()
    found = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got)
    want = []
    for i, t in rows:
        spans = base(t)
        n = [sum(s.startswith(k + ":") for s in spans) for k in PLAIN]
        want.append((str(i), hashlib.sha256(",".join(spans).encode()).hexdigest(), *n))
    assert found == sorted(want)
    return got


ODD = [
    "a@b.c.d@e.f x@y x@@y.z .@-.- a@b..c _%@a.b-.c \U0001f600 u@v.w",
    "1.2.3.4.5.6.7.8 0001.02.3.255 256.1.1.1 1.2.3. 1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 411111111111 0000000000000000 00000000000000000000",
    "+1 (202) 555-0147 ++49 30 1234567 +1)23456789 +12345678 +1 . 2 +123456789012345 +1234567890123456 +4 ((((((((9",
    "secret@x.y 5500 0000 0000 0004 +33 1 23 45 67 89",
    "9" * 30_000,
    "a." * 20_000 + "@x.y",
    "1." * 20_000,
    "+1" + "(" * 20_000,
    "x@" * 10_000,
]


def test_base_spans_equal_the_plain_patterns(spark, odd_rows):
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(ODD))]
    check(documents(spark, rows), rows)


def test_whole_table_at_the_smallest_size(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


@pytest.fixture(scope="module")
def revealing(spark):
    """Zyx always stands next to one address; common words don't give it away."""
    rows = [(i, f"Please ask Zyxel via z@corp.example about order {i}.\nThe weather is fine today.") for i in range(8)]
    rows += [(100 + i, f"Please ask anyone about order {i}. The weather is fine via ship.") for i in range(60)]
    rows += [(300, "Only Zyxel knows."), (301, None)]
    return documents(spark, rows)


def test_a_revealing_term_is_found_wherever_it_stands(revealing):
    got = {r.doc_id: r.spans for r in privacy.report(revealing).collect()}
    assert got[300] == "term:5:10" and "term:11:16" in got[0] and "email" in got[0]
    assert got[100] == "" and got[301] == ""


def test_a_crowded_sieve_changes_nothing(revealing, monkeypatch):
    want = sorted((r.doc_id, r.spans) for r in privacy.report(revealing).collect())
    monkeypatch.setattr(common, "CELLS", 1)
    assert sorted((r.doc_id, r.spans) for r in privacy.report(revealing).collect()) == want


def plain_spans(rows):
    """Spans by a plain count over the documents, for texts whose words are separate."""
    import math
    from collections import Counter

    mails = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\w+@x\.y", t)] for _, t in rows]
    words = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[a-zA-Z]\w*", t)] for _, t in rows]
    free = [[w for w in ws if not any(w[0] < e and s < w[1] for s, e, _ in ms)] for ws, ms in zip(words, mails, strict=True)]
    n, nt, ne, both = len({t for _, t in rows}), Counter(), Counter(), Counter()
    once = {t: k for k, (_, t) in enumerate(rows)}  # copies of a text are one text
    for ws, fs, ms in ((words[k], free[k], mails[k]) for k in once.values()):
        own = {m for _, _, m in ms}
        nt.update({w for *_, w in ws}), ne.update(own), both.update((e, w) for e in own for w in {w for *_, w in fs})
    given = {(e, w): (k + 2 * ne[e] / n) / (nt[w] + 2) for (e, w), k in both.items()}
    terms = {w for (e, w), g in given.items() if g >= 0.5 - 1e-12 and math.log2(g * n / ne[e]) >= 2 - 1e-12}
    out = []
    for (i, _), fs, ms in zip(rows, free, mails, strict=True):
        spans = sorted([(s, 0, e, "email") for s, e, _ in ms] + [(s, 1, e, "term") for s, e, w in fs if w in terms])
        out.append((i, ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)))
    return sorted(out), terms


def test_spans_equal_a_plain_count(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(12)]
        if i % 9 == 0:
            e = rng.randrange(60)
            words[3:3] = [f"Name{e}", f"e{e}@x.y"]
        if i % 50 == 1:
            words.append(f"name{rng.randrange(60)}")
        rows.append((i, " ".join(words)))
    rows += [(i, rows[i][1]) for i in range(0, 90, 9)]  # repeated rows
    want, terms = plain_spans(rows)
    got = sorted((r.doc_id, r.spans) for r in privacy.report(documents(spark, rows)).collect())
    assert got == want and any("term" in s for i, s in got if i % 50 == 1 and i % 9) and len(terms) > 30


def test_a_word_of_two_documents_stays_in_the_one_without_an_entity_at_every_size(spark):
    for n in (300, 20_000):
        rows = [(i, f"common words here and v{i % 97}") for i in range(n)] + [(-1, "tullow a@b.example.org"), (-2, "tullow alone")]
        got = {r.doc_id: r.spans for r in privacy.report(documents(spark, rows)).collect() if r.doc_id < 0}
        assert got == {-1: "email:7:22", -2: ""}


@pytest.mark.parametrize("n", [40, 900, 1_100, 100_000])
def test_few_texts_count_alike_at_every_size(spark, n):
    """A word of one text discloses nothing, however often the text is copied; one of two with the entity does, whatever the size."""
    rows = [(i, f"common words here and v{i % 37}") for i in range(n)]
    rows += [(-1, "harrow a@b.example.org"), (-2, "wexley c@d.example.org one"), (-3, "wexley c@d.example.org two")]
    rows += [(-4, "morrow e@f.example.org"), (-5, "morrow e@f.example.org")]
    got = {r.doc_id: r.spans for r in privacy.report(documents(spark, rows)).collect() if r.doc_id < 0}
    assert got == {-1: "email:7:22", -2: "term:0:6,email:7:22", -3: "term:0:6,email:7:22", -4: "email:7:22", -5: "email:7:22"}


def test_the_share_of_documents_with_terms_is_alike_at_both_sizes(spark):
    share = {}
    for size in ("sf0.01", "sf0.1"):
        df = privacy.report(spark.read.parquet(f"/root/testdata/{size}/documents.parquet"))
        share[size] = df.agg(F.avg(F.contains("spans", F.lit("term:")).cast("int"))).first()[0]
    assert abs(share["sf0.01"] - share["sf0.1"]) < 0.02 and max(share.values()) < 0.05, share


def test_sanitise_replaces_spans_and_keeps_columns(revealing):
    out = privacy.sanitise(revealing)
    assert out.columns == revealing.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[300] == "Only [TERM] knows." and "[EMAIL]" in texts[0] and texts[301] is None
    assert texts[100] == "Please ask anyone about order 0. The weather is fine via ship."


def test_terms_of_an_entity_are_found_in_its_whole_documents_and_at_low_counts(spark):
    rows = [(i, f"Write to q@corp.example now.\n{'filler ' * 60}\nQuorra signs number {i}.") for i in range(3)]
    rows += [(100 + i, f"Write filler now, anyone signs number {i}.") for i in range(2000)]
    rows += [(5000, "Quorra again."), (5001, "Call +1 (202) 555-0147 and filler.\nVesper waits."), (5002, "Write again.")]
    got = {r.doc_id: r.spans for r in privacy.report(documents(spark, rows)).collect()}
    assert got[5000] == "term:0:6" and "term" in got[0]
    assert got[5001] == "phone:5:22"  # a word of one document is no evidence
    assert got[5002] == got[100] == ""


def test_ratios_equal_a_plain_count(spark):
    import math
    from collections import Counter

    rows = [(i, f"w{i % 7} v{i % 50} u{i} common " + (f"e{i % 50}@x.y f{i % 7}@x.y" if i % 3 == 0 else "")) for i in range(300)]
    got = {r.term: r.ratio for r in privacy.disclosing_terms(documents(spark, rows), gains=1.0, left=1e3).collect()}
    n, nt, ne, both = len(rows), Counter(), Counter(), Counter()
    for _, t in rows:
        words, mails = set(re.findall(r"[a-z]\w*", t)), set(re.findall(r"\w+@x\.y", t))
        bare = set(re.findall(r"[a-z]\w*", re.sub(r"\w+@x\.y", " ", t)))
        nt.update(words), ne.update(mails), both.update((e, w) for e in mails for w in bare)
    want: dict = {}
    for (e, w), k in both.items():
        p = ne[e] / n
        given = (k + 2 * p) / (nt[w] + 2)
        if math.log2(given / p) >= 1:
            want[w] = max(want.get(w, -9), math.log(given / p) / math.log(1 / p))
    assert got.keys() == want.keys() and all(abs(got[w] - v) < 1e-9 for w, v in want.items())


def test_empty_table(spark):
    assert privacy.report(documents(spark, [])).count() == 0
    assert privacy.sanitise(documents(spark, [])).where(F.col("text").isNotNull()).count() == 0
