import hashlib
import unicodedata

import numpy as np
import xxhash
from conftest_llm import PROSE, documents

from catalume.llm import fingerprints as fp


def edited(rows):
    """By brute force: (doc_id, text) -> the edited text."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + nxt[:half], nxt))
    return out


def test_edits_and_equal_fingerprints(spark, odd_rows):
    got = fp.fingerprint_edits(documents(spark, odd_rows)).collect()
    want = edited(odd_rows)
    key = lambda i, n, h: (-1 if i is None else i, n, h)
    assert sorted(key(r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(key(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[6] == prints[7] and len(prints[7]) == 1
    assert prints[1] == prints[2] == prints[3] == {""}


def test_many_blocks_find_every_successor(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(500)]
    rows = [(int(i) * 3 - 700, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in rng.permutation(1500)]
    got = {r.doc_id: r.edited_sha256 for r in fp.fingerprint_edits(documents(spark, rows)).collect()}
    assert got == {i: hashlib.sha256(e.encode()).hexdigest() for i, _, e, _ in edited(rows)}


def test_likeness_follows_shared_text(spark):
    half = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(400))
    other = " ".join(f"gamma{i} delta{i * 5 % 11}" for i in range(400))
    df = spark.createDataFrame([(half, half, other), (half, half + " " + other, other)], "a string, b string, c string")
    for c in "abc":
        df = fp.sketch(df, c, f"s{c}")
    df = fp.likeness(fp.likeness(df, "sa", "sb", "near"), "sa", "sc", "far")
    first, second = sorted(df.select("near", "far").collect(), reverse=True)
    assert first.near == 1 and first.far == 0
    assert 0.35 < second.near < 0.65 and second.far == 0


def plain_sketch(text):
    """Closed syncmers by the rule, with plain XXH64: the smallest distinct hashes of a text, as signed numbers."""
    mask = 2**64 - 1
    signed = lambda h: h - 2**64 if h >> 63 else h

    def chain(numbers):
        h = 42
        for n in numbers:
            h = xxhash.xxh64_intdigest((n & mask).to_bytes(8, "little"), h)
        return signed(h)

    dense = lambda c: any(w in unicodedata.name(c, "") for w in ("CJK UNIFIED", "HIRAGANA", "KATAKANA", "THAI"))
    tokens, run = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\f\r" or dense(c):
            tokens += [run] * bool(run) + [c] * dense(c)
            run = ""
        else:
            run += c
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in tokens]
    s = [chain(p) for p in zip(w, w[1:], strict=False)]
    found = {chain((s[i], s[i + 2], w[i + 4])) for i in range(len(w) - 4) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])}
    if not found:
        found = {chain(w)} if w else set()
    return sorted(found)[: fp.SKETCH]


def plain_likeness(a, b):
    union = sorted(set(a) | set(b))[: fp.SKETCH]
    return len([h for h in union if h in a and h in b]) / len(union) if union else 1.0


def test_fingerprints_and_likenesses_by_brute_force(spark, odd_rows):
    rows = [*odd_rows, *((100 + i, " ".join(f"w{i * j % 41}" for j in range(n))) for i, n in enumerate((4, 5, 6, 30, 900))), (200, "漢字かなカナの文 with words ไทย in it 漢字かなカナの文")]
    hexed = lambda sk: "".join(f"{h & (2**64 - 1):016x}" for h in sk)
    want = []
    for i, t, e, nxt in edited(rows):
        a, b, c = plain_sketch(t), plain_sketch(e), plain_sketch(nxt)
        want.append((str(i), hashlib.sha256(e.encode()).hexdigest(), hexed(a), hexed(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = [(str(r.doc_id), r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprint_edits(documents(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_a_passage_keeps_its_anchors_in_a_text_of_another_script(spark):
    passage = "".join(chr(0x4E00 + i * 37 % 3000) for i in range(150))
    df = spark.createDataFrame([(passage,), (passage + " latin words follow it here" * 60,)], "text string")
    a, b = ({h.hash for h in r.anchors} for r in fp.anchors(df).collect())
    assert len(a) > 40 and a <= b


def test_anchors_are_context_free(spark):
    passage = " ".join(f"q{i * i % 997}" for i in range(120))
    df = spark.createDataFrame([("x y z " * 5 + passage,), ("other words before it " * 9 + passage + " and after",)], "text string")
    a, b = ({h.hash for h in r.anchors} for r in fp.anchors(df).collect())
    assert len(a & b) > 40


def test_empty_table_and_single_row(spark):
    assert fp.fingerprint_edits(documents(spark, [])).count() == 0
    (row,) = fp.fingerprint_edits(documents(spark, [(5, PROSE)])).collect()
    assert row.near_next == 1
