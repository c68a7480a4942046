import numpy as np
import pytest
from conftest_llm import documents

from catalume.llm import quality

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return quality.classify(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    held = scored[scored.held_out & scored.quality.notna()]
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.85
    assert (held.predicted == held.quality).mean() > 0.85


def test_calibration_and_ranges(scored):
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()
    held = scored[scored.held_out & scored.quality.notna()]
    assert abs(held.score.mean() - held.quality.mean()) < 0.1


def test_odd_rows(spark, odd_rows):
    docs = documents(spark, odd_rows)
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (8, 1), (9, 0), (9, 1), (None, 1), (77, 0), (10, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in got if r.doc_id in (6, 7)}) == 1


def test_one_kind_of_label_and_none_and_no_documents(spark, odd_rows):
    docs = documents(spark, odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(documents(spark, []), none).count() == 0


def test_score_replaces_a_clashing_column(spark, odd_rows):
    docs = documents(spark, odd_rows)
    pool = quality.Pooling(*quality.word_vectors(docs))
    out = quality.score(docs, pool, quality.Network().fit(np.zeros((1, pool.size)), np.full(1, 0.5)))
    assert dict(out.dtypes)["score"] == "double" and out.count() == len(odd_rows)


def test_equal_texts_score_alike_to_the_last_bit_in_any_batch(spark, odd_rows):
    docs = documents(spark, odd_rows)
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (8, 1), (9, 0), (11, 1), (12, 0)], "doc_id long, quality int")
    pool, network = quality.fit(docs, labels)
    texts = [t for _, t in odd_rows if len(t or "") < 10_000]
    whole = network.score(pool(texts * 40))
    for size in (1, 2, 3, 7, 64):
        for i in range(0, len(texts) * 2, size):
            got = network.score(pool((texts * 2)[i : i + size]))
            assert (got == whole[i : i + size][: len(got)]).all()


def test_vectors_and_features_by_plain_loops(spark, odd_rows):
    """Every word's neighbours added one by one, and every document pooled word by word."""
    import re
    import zlib

    texts = [t for _, t in odd_rows if len(t or "") < 20_000] + ["one two one three one two"]
    places, signs = quality._index_vectors()
    table, counts = np.zeros((quality.BUCKETS, quality.SIZE)), np.zeros(quality.BUCKETS)
    cut = [[zlib.crc32(w.encode()) % quality.BUCKETS for w in re.findall(r"\w+|[^\w\s]+", t or "")] for t in texts]
    for words in cut:
        for i, w in enumerate(words):
            counts[w] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    for at, sign in zip(places[words[j]], signs[words[j]], strict=True):
                        table[w, at] += sign
    mean = table.sum(0) / counts.sum()
    vectors = np.array([row - n * mean for row, n in zip(table, counts, strict=True)])
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1)), 1e-9)[:, None]
    got, n = quality.word_vectors(documents(spark, list(enumerate(texts))))
    assert (n == counts).all() and np.abs(got - vectors).max() < 1e-5

    pool = quality.Pooling(got, n)
    for features, words in zip(pool(texts), cut, strict=True):
        want = np.zeros(pool.size)
        if words:
            v = [got[w].astype(float) for w in words]
            rare = [1e-3 / (1e-3 + counts[w] / counts.sum()) for w in words]
            plain = sum(v) / len(v)
            weighted = sum(r * x for r, x in zip(rare, v, strict=True)) / sum(rare)
            beside = sum(float(a @ b) for a, b in zip(v, v[1:])) / max(len(v) - 1, 1)
            want = np.concatenate([plain, weighted, [beside, np.linalg.norm(plain), np.linalg.norm(weighted), np.log1p(len(v)) / 8, len(set(words)) / len(v)]])
        assert np.abs(features - want).max() < 1e-3
