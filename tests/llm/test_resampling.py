import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from catalume.llm import resampling


def plain(rows, target, run, percent, least, buckets=10_000):
    """Runs joined as strings, counted by dictionaries."""

    def runs(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        n, found = runs(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    asked = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(asked[: len(asked) * percent // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_whole_table_against_joined_runs(spark, run):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows, [r.text for r in target.collect()], run, 30, 20)
    assert found(resampling.resample(docs, target, run=run, percent=30)) == want


def test_odd_rows(spark, odd_rows):
    target = spark.createDataFrame([(1, "the harbour office"), (2, None), (3, "")], "item_id long, text string")
    want = plain(odd_rows, ["the harbour office", None, ""], 1, 50, 2)
    assert found(resampling.resample(documents(spark, odd_rows), target, percent=50, least=2)) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(documents(spark, []), none).count() == 0
    assert found(resampling.resample(documents(spark, [(1, "a b")]), none, least=1, percent=100))[0][4] == 1


def test_the_ring_and_word_counts():
    for text in ("", "one", "one two", "One, TWO three-four é漢 5"):
        for run in (1, 2, 3, 5):
            crcs = resampling.run_crcs(text, run)
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            assert sorted(crcs) == sorted(zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, run + 1) for i in range(len(words) - k + 1))
            assert resampling._words_of(len(crcs), run) == len(words)


def test_ranks_over_many_parts(spark):
    rows = spark.range(5_000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("x"), "id")
    placed = resampling.ranked(rows, [F.desc("x"), F.asc("id")])
    assert [r["rank"] for r in placed.orderBy(F.desc("x"), "id").collect()] == list(range(1, 5_001))


def test_draws_follow_the_target(spark):
    """Documents of the target's words are drawn, others hardly."""
    near, far = "alpha beta gamma delta " * 10, "other words stand here now " * 10
    rows = [(i, near if i % 10 == 0 else far) for i in range(200)]
    target = spark.createDataFrame([(1, near)], "item_id long, text string")
    drawn = [r.doc_id for r in resampling.resample(documents(spark, rows), target).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 20 and sum(d % 10 == 0 for d in drawn) >= 19
