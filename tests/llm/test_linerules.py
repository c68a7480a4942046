from collections import Counter

import pytest
from conftest_llm import PROSE, documents

from catalume.llm import linerules

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(text):
    """The base columns by plain loops."""
    text = text or ""
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    repeats = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(held), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_columns_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = linerules.verdicts(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        assert base(r) == plain(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark, odd_rows):
    found = linerules.clean(documents(spark, odd_rows))
    assert found.columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "score", "row", "fp"]
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert base(r) == plain(r.text)
    assert next(r for r in rows if r.doc_id == 1).cleaned is None
    assert linerules.clean(documents(spark, [])).count() == 0
    big = (1 << 60) + 1  # ids beyond doubles, beside a null
    assert {r.doc_id for r in linerules.verdicts(documents(spark, [(big, "x"), (None, "y")])).collect()} == {big, None}


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("The harbour office opens at nine.", None),
        ("He said: “Come in!”", None),
        ("One sentence ends here. The next goes on", None),
        ("A heading without an end", "punctuation"),
        ("BUY!! NOW!! CHEAP!! THINGS!! HERE.", "punctuation"),
        ("the$$$ words### are&&& marked%%%.", "punctuation"),
        ("Home | News | Sport | Weather", "navigation"),
        ("Read more »", "navigation"),
        ("» Next page", "navigation"),
        ("a | table of two columns ends here.", None),
        ("Copyright 2024 The Harbour Office. All rights reserved.", "boilerplate"),
        ("This site uses cookies.", "boilerplate"),
        ("海が見える。", None),
    ],
)
def test_rules_of_a_line(line, fault):
    assert linerules.line_fault(line, words_of(line), False) == fault


def test_repeated_lines_and_rejection():
    lines = [" ".join(f"w{i}x{k}" for k in range(10)) + "." for i in range(12)]
    whole = linerules.judge("\n".join(lines))
    assert whole.kept and whole.cleaned == "\n".join(lines) and whole.n_lost_words == 0
    again = linerules.judge("\n".join([*lines, lines[0]]))
    assert again.cleaned == "\n".join(lines) and again.n_dup_lines == 1 and again.kept
    menu = [f"alpha{i} | beta{i} | gamma{i} | delta{i} | eps{i}" for i in range(30)]
    lost = linerules.judge("\n".join([*lines, *menu]))
    assert lost.cleaned == "\n".join(lines) and not lost.base_failed and not lost.kept
    half = linerules.judge("\n".join([*lines, *menu[:4]]))
    assert half.kept and half.n_lost_words == 36 and half.n_words == 156


def test_clean_prose_stays_and_marked_junk_goes(spark):
    """Of labelled documents that pass the rules on the whole text: nearly all good ones stay, nearly all bad ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = linerules.verdicts(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)
    assert linerules.judge(PROSE).n_lost_words == 0
