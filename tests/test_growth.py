"""Steps that have to hold for tables far larger than the test data: no cuts, and work in proportion to what is distinct."""

import re

import pytest
from pyspark.sql import functions as F

from catalume.functions import analysis, fragments
from catalume.operators import incremental, postings, ranked, search, trigrams
from catalume.plans import file_queries, index_queries, more_queries, search_queries
from catalume.sources import files
from catalume.sources.catalog import Catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_highlights_of_all_matches_are_not_cut(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    for query in (index_queries.SPARK["ranked_resource_highlights"], search_queries.SPARK["ranked_content_match"], more_queries.SPARK["ranked_chunks"]):
        assert "GlobalLimit" not in plan(query(c))
    live = c.resource.where("state = 'active'")
    assert ranked.resource_leg(live, "urgent", 3).count() == 3
    assert ranked.resource_leg(live, "urgent", None).count() == live.where(F.col("description").contains("URGENT")).count() > 3


def test_equal_texts_share_their_postings(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("the harbour, the 東京都").alias("title"), F.when(F.col("id") % 2 == 0, "the harbour, the 東京都").alias("notes"))
    held = postings.postings_of(df, "id", ["title", "notes"])
    assert held.where("term <> ''").count() == 5 and held.where("term = ''").count() == 1000
    changed = postings.postings_of(df.where("id = '7'").withColumn("title", F.lit("the harbour, the 東京都")), "id", ["title", "notes"])
    after = postings.replaced(held, changed, df.where("id = '8'").select("id"))
    assert postings.compacted(after).where("term <> ''").count() == 5
    for q in ("harbour", "京", "東京都"):
        want = {r.id: round(r.score, 9) for r in ranked.bm25(df.where("id <> '8'"), q, {"title": 3.0, "notes": 1.0}).collect()}
        for kept in (after, postings.compacted(after)):
            assert {r.id: round(r.score, 9) for r in postings.search(kept, q, {"title": 3.0, "notes": 1.0}).collect()} == want


def test_notes_are_searched_once_each(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    assert "notes#" not in plan(search.matching(c, search.Filters(q="urgent")).agg(F.count("*")))
    packages, _, _ = ranked.search_legs(c, "the", search.Filters(allowed_orgs=None))
    assert "notes#" not in plan(packages).replace("__tf_notes_0", "").replace("__len_notes", "")
    assert search.matching(c, search.Filters(q="urgent")).columns == c.package_notes.columns


def test_short_classes_count_as_the_long_ones_do(spark):
    import re

    texts = ["", "a-b a_b ab a", "a1 a", "aa a", "éa a é a", "ａ a ー a 東a a", "A,a;a\na"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", analysis.occurrences(F.col("t"), analysis.Asked("a")).alias("n"), analysis.length(F.col("t")).alias("len"), F.size(analysis.runs(F.col("t"))).alias("runs")).collect()
    script = "々-〇ぁ-ゖゝ-ゟァ-ヺー-ヿ㐀-䶿一-鿿"
    for r in got:
        plain = re.findall(f"[^\\W_{script}]+", r.t.lower())
        assert r.n == plain.count("a") and r.len == len(plain) + len(re.findall(f"[{script}]", r.t)) and r.runs == len(plain) + len(re.findall(f"[{script}]+", r.t))


def test_small_files_share_batches():
    import pyarrow as pa

    from catalume.functions.batches import batched

    schema = pa.schema([("path", pa.string()), ("n", pa.int64()), ("cells", pa.list_(pa.string()))])
    rows = [(str(i), i, ["x" * 1000] * (i % 3)) for i in range(1_000)]
    got = list(batched(rows, schema, 100, 20_000))
    assert 30 < len(got) < 60 and max(b.num_rows for b in got) <= 100 and max(b.nbytes for b in got) < 30_000
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows


def test_encodings_of_plain_bytes_are_told_without_python(spark):
    import random

    from catalume.functions.text import decode_bytes, decoded, detect_encoding, encoding_of

    rng = random.Random(5)
    texts = ["", "plain", "人口統計", "é", "a\x1b(J", "<?XML version='1' encoding='euc-jp'?>é", "\x7f\x80"]
    given = [t.encode() for t in texts] + ["人口統計データ".encode(k) for k in ("cp932", "euc_jp", "iso2022_jp")] + ["統計".encode()[:n] for n in range(6)] + ["\U0001f600".encode()[:n] for n in range(5)] + [b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80"]
    given += [bytes(rng.choices([0x41, 0x80, 0xBF, 0xC2, 0xE3, 0x81, 0xF0, 0x9F, 0x1B, 0x24], k=rng.randrange(1, 7))) for _ in range(400)]
    df = spark.createDataFrame([(b,) for b in [*given, None]], "b binary").withColumn("e", detect_encoding(F.col("b"))).withColumn("t", decode_bytes(F.col("b"), F.col("e")))
    for r in df.collect():
        assert (r.e, r.t) == ((None, None) if r.b is None else (encoding_of(bytes(r.b)), decoded(bytes(r.b), r.e)))
    sent = df.where("e IN ('ASCII', 'UTF8')").select(F.count("*")).first()[0]
    assert sent > 20


def test_a_term_is_sought_by_its_rarest_gram(spark, tmp_path):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("customer-"), F.col("id").cast("string")).alias("name"))
    made = trigrams.grams(df.unionByName(df), "id", ["name"])
    assert made.count() == made.distinct().count()
    trigrams.write_grams(made, str(tmp_path / "g"))
    held = trigrams.read_grams(spark, str(tmp_path / "g"))
    for q in ("customer-299", "er"):  # no table of ids is made in memory
        assert "Aggregate" not in plan(trigrams.candidates(held, q))
    assert trigrams.candidates(held, "customer-299").count() == 1
    assert [r.id for r in trigrams.containing(df, held, "customer-299", "id", ["name"]).collect()] == ["299"]


def test_pages_of_many_tables_are_dealt_by_table(spark, tmp_path):
    table = spark.range(40_000).select(F.col("id").cast("string").alias("path"), F.lit(0).cast("long").alias("row_index"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so small a table would be put together again
    try:
        files.write_preview(table, str(tmp_path / "p"), 2)
    finally:
        spark.conf.unset(coalesce)
    held = spark.read.parquet(str(tmp_path / "p"))
    sizes = [r["count"] for r in held.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 20_000
    assert files.read_rows(held, 0, 1, 2).count() == 40_000


def test_a_tree_is_dealt_and_ordered_by_one_shuffle(spark):
    entries = spark.range(500).select((F.col("id") % 50).cast("string").alias("path"), F.concat(F.lit("d/e"), (F.col("id") % 3).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("name"), F.lit(False).alias("is_directory"))
    want = files.tree_order(files.path_tree(entries))
    got = files.tree_order(files.path_tree(entries, by_range=True))
    assert got.collect() == want.collect() and got.count() == 50 + 150 + 500
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_windows_of_many_hits_are_found_in_one_pass(spark):
    import random

    rng = random.Random(6)
    rows = []
    for _ in range(300):
        at, hits = 0, []
        for _ in range(rng.randrange(12)):
            start = at + rng.randrange(1, 9)
            at = start + rng.randrange(1, 14)
            hits.append((start, at))
        rows.append((hits,))
    for size in (5, 12, 40):
        df = spark.createDataFrame(rows, "f array<struct<start:int,end:int>>")
        for r in df.select("f", fragments.window(F.col("f"), F.lit(10_000), size).alias("w")).collect():
            tried = [(sum(h.start >= s.start and h.end <= s.start + size for h in r.f), -s.start) for s in r.f]
            n, start = max(tried, default=(0, 0))
            assert (r.w is None) == (n == 0) and (r.w is None or r.w.n == n)
            if n:
                end = max(h.end for h in r.f if h.start >= -start and h.end <= -start + size)
                assert r.w.start == max(0, -start - (size - (end + start)) // 2)
    assert "filter(" not in spark.createDataFrame(rows, df.schema).select(fragments.window(F.col("f"), F.lit(9), 5).alias("w"))._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_made_and_encoded_once(spark):
    made = plan(file_queries.reencoded_tables(Catalog(spark, "/root/testdata/sf0.001")))
    assert made.count("collect_list(") == 1 and "_encoded(" not in made
    texts = spark.createDataFrame([("a", "東京,1", "cp932"), ("b", "é", "utf-8")], "path string, text string, codec string")
    assert {r.path: bytes(r.content) for r in file_queries._encoded_files(texts).collect()} == {"a": "東京,1".encode("cp932"), "b": "é".encode()}


def test_an_index_search_gathers_documents_by_one_shuffle(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("harbour "), F.col("id") % 9).alias("title"), F.when(F.col("id") % 3 == 0, "the harbour, the 東京都").alias("notes"))
    held, some, boosts = postings.postings_of(df, "id", ["title", "notes"]), df.where("id % 2 = 0"), {"title": 3.0, "notes": 1.0}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [postings.search(held, q, boosts, some)._jdf.queryExecution().executedPlan().toString() for q in ("harbour 3", "東京")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("SortMergeJoin" in p or "hashpartitioning" in p for p in plans)
    for few in (postings.FEW, 1):  # more texts than go to all tasks are joined
        monkeypatch.setattr(postings, "FEW", few)
        for q in ("harbour 3", "東京", "the"):
            want = {r.id: round(r.score, 9) for r in ranked.bm25(some, q, boosts).collect()}
            assert want and {r.id: round(r.score, 9) for r in postings.search(held, q, boosts, some).collect()} == want
    assert not postings.search(held, "harbour", boosts, df.limit(0)).count()


def test_words_of_an_index_are_only_counted(spark):
    df = spark.createDataFrame([("1", "harbour x 東京 harbour 東京都", None), ("2", "harbour", ""), ("3", "東京の港", "harbour")], "id string, title string, notes string")
    held = postings.postings_of(df, "id", ["title", "notes"])
    got = sorted((len(r.text), r.term, r.tf, len(r.at)) for r in held.where("term IN ('harbour', 'x', '東京')").collect())
    assert got == [(7, "harbour", 1, 0), (12, "東京", 1, 1), (32, "harbour", 2, 0), (32, "x", 1, 0), (32, "東京", 2, 2)]
    assert {bytes(r.text) for r in held.where("term = ''").collect() if len(r.text) < 32} == {b"", b"harbour", "東京の港".encode()}


@pytest.mark.parametrize("name", ["ranked_enriched_page", "ranked_index_page", "ranked_matched_resources", "ranked_page_all_legs", "ranked_page_offset", "ranked_snippets"])
@pytest.mark.parametrize("name", ["ranked_enriched_page", "ranked_index_page", "ranked_matched_resources", "ranked_page_all_legs", "ranked_page_offset", "ranked_snippets"])
def test_pages_rank_all_that_match(spark, name):
    c = Catalog(spark, "/root/testdata/sf0.001")
    holds = lambda *texts: any("1" in re.findall(r"[^\W_]+", (t or "").lower()) for t in texts)
    live = {r.id: r for r in c.package_notes.where("state = 'active'").collect()}
    found = {(r.package_id, r.id) for r in c.resource.where("state = 'active'").collect() if r.package_id in live and holds(r.name, r.description)}
    inside = {(r.package_id, r.resource_id) for r in c.content_lines.collect() if r.package_id in live and holds(r.extracted_text)}
    total = len({i for i, r in live.items() if holds(r.title, r.notes)} | {p for p, _ in found | inside})
    page = ranked.ranked_page(c, "1", search.Filters(allowed_orgs=None), 0, 50, c.content_lines).collect()
    got, ids = {**more_queries.SPARK, **index_queries.SPARK}[name](c).collect(), [r.id for r in page]
    assert len(found) > 100 and len(ids) == 50 and {r.total for r in page} == {total}
    if name in ("ranked_matched_resources", "ranked_snippets"):
        assert {(r.package_id, r.resource_id) for r in got} == {(p, r) for p, r in found | inside if p in ids}
    else:
        assert [r.id for r in sorted(got)] == (ids[7:12] if name == "ranked_page_offset" else ids)
    assert "LIMIT 100" not in {**more_queries.SQL, **index_queries.SQL}[name]


def test_an_index_page_by_tag_ranks_all_that_match(spark, tmp_path, monkeypatch):
    c = Catalog(spark, "/root/testdata/sf0.001")
    named = incremental.with_tables(c, resource=c.resource.withColumn("name", F.lit("brand 1")))
    kept = ranked.write_index(named, str(tmp_path / "index"), named.content_lines)
    monkeypatch.setattr(index_queries, "kept_index", lambda c: kept)
    live, owned = named.package_core.where("state = 'active'").select("id"), named.resource.where("state = 'active'").select(F.col("package_id").alias("id"))
    tagged = named.package_tag.where("tag = 'Brand#1'").select(F.col("package_id").alias("id"))
    total, most = owned.unionByName(tagged).join(live, "id", "left_semi").distinct().count(), owned.join(live, "id", "left_semi").count()
    assert most > 100 and {r.total for r in index_queries.SPARK["ranked_index_page_by_tag"](named).collect()} == {total}
    _, resources, content = ranked.search_legs(named, "brand 1", search.Filters(allowed_orgs=None), named.content_lines, kept)
    assert resources.count() == most and not content.count()
