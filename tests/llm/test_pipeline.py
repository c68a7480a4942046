"""The pipeline's stages on a small table, against plain versions of each."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from catalume.llm import quality

DOCS = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{DOCS}/documents.parquet")
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DOCS).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    k = min(5, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_columns_and_rows(stages):
    for df in stages[:-1]:
        assert df.columns == pipeline.COLUMNS
    counts = [df.count() for df in stages]
    assert counts[0] >= counts[1] == counts[2] and stages[3].select("doc_id").distinct().count() == counts[2]


def test_clean_documents_stay_and_junk_goes(spark, stages):
    labels = spark.read.parquet(f"{DOCS}/labels.parquet").toPandas()
    kept = set(stages[0].toPandas().doc_id)
    good = labels[labels.quality == 1].doc_id
    assert good.isin(kept).mean() > 0.9
    assert stages[0].where(quality.fold() == 1).count() > 0


def test_one_of_each_group_stays(stages):
    before, after = stages[0].toPandas(), stages[1].toPandas()
    kept, sets = set(after.doc_id), {i: shingles(t) for i, t in zip(before.doc_id, before.text, strict=True)}
    ids = sorted(sets)
    links = defaultdict(set)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            union = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / union if union else 1) >= 0.8:
                links[a].add(b)
                links[b].add(a)
    seen = set()
    for i in ids:
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += links[x]
        seen |= group
        assert kept & group == {min(group)}


def test_lengths_follow_the_text(stages):
    pdf = stages[2].toPandas()
    assert (pdf.text.fillna("").str.len() == pdf.n_chars).all() and not pdf.text.str.contains(r"[a-z]@[a-z]+\.[a-z]").any()


def test_run_equals_its_stages(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = pipeline.run(spark, DOCS).select(key).toPandas().sort_values(key).to_numpy()
    assert np.array_equal(got, stages[3].select(key).toPandas().sort_values(key).to_numpy())


def test_odd_and_empty_documents(spark, odd_rows, tmp_path):
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in odd_rows]
    for name, kept in (("odd", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        assert pipeline.run(spark, d).count() >= len(kept) * 0.5


def test_batches_of_whole_texts_are_small_and_freed_memory_goes_back(spark):
    from catalume.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def held(batches):
        def resident():
            with open("/proc/self/status") as file:
                return next(int(line.split()[1]) for line in file if line.startswith("VmRSS"))

        list(batches)
        before = resident()
        small = [bytes(2000) for _ in range(100_000)]
        kept = small[-1:]  # the last piece keeps all before it from going back by itself
        del small
        left = resident()
        common.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([left - before - len(kept)]), pa.array([resident() - before])], names=["left", "after"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with common.few_rows(spark):
        assert max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(common.giving_back(sizes), "n long").collect()) <= common.FEW
    assert spark.conf.get(key) == before
    got = spark.range(0, 1, 1, 1).mapInArrow(held, "left long, after long").first()
    assert got.left > 150_000 and got.after < 50_000
