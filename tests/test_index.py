"""Kept indexes: postings, grams, fragments, previews by page, and names in the readers' order."""

import random

from pyspark.sql import functions as F

from catalume.functions import analysis, fragments
from catalume.operators import postings, ranked, search, trigrams
from catalume.sources import files
from catalume.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"
ALL = search.Filters(allowed_orgs=None)
BOOSTS = {"title": 3.0, "notes": 1.0}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(spark, n=400):
    rng = random.Random(1)
    words = ["harbour", "Register", "the", "and", "2024", "人口統計", "東京都", "の", "データ", "x"]
    rows = [(str(i), rng.choice([None, "", " ".join(rng.choices(words, k=3))]), "".join(rng.choice([w, w + " "]) for w in rng.choices(words, k=rng.randrange(9)))) for i in range(n)]
    return spark.createDataFrame(rows, "id string, title string, notes string")


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


def test_words_of_scripts_without_spaces(spark):
    def words(t):
        return spark.range(1).select(analysis.words(F.lit(t)).alias("w")).first().w

    assert words("東京都の Data-x カ") == ["東京", "京都", "都の", "の", "data", "x", "カ"]
    assert words("") == words("…") == []
    assert [a.text for a in analysis.asked("東京 Data 統 2024年 東京")] == ["東京", "data", "統", "2024", "年"]


def test_postings_score_as_the_scan_does(spark, tmp_path):
    df = made(spark)
    path = str(tmp_path / "p")
    postings.write_postings(postings.postings_of(df, "id", ["title", "notes"]), path)
    held = postings.read_postings(spark, path)
    for q in ("harbour", "the register", "人口統計", "東京 データ", "口", "データ 2024", "absent", "人統"):
        want = scores(ranked.bm25(df, q, BOOSTS))
        assert scores(postings.search(held, q, BOOSTS)) == want
        assert bool(want) == (q not in ("absent", "人統"))
        some = df.where("id % 3 = 0")
        assert scores(postings.search(held, q, BOOSTS, some)) == scores(ranked.bm25(some, q, BOOSTS))
    assert postings.search(held, "…", BOOSTS).count() == 0


def test_documents_are_added_changed_and_removed(spark, tmp_path):
    df = made(spark)
    held = postings.postings_of(df, "id", ["title", "notes"])
    new = spark.createDataFrame([("7", "harbour harbour", None), ("new", None, "東京の harbour")], "id string, title string, notes string")
    gone = spark.createDataFrame([("8",), ("9",)], "id string")
    after = postings.replaced(held, postings.postings_of(new, "id", ["title", "notes"]), gone)
    now = df.where("id NOT IN ('7', '8', '9')").unionByName(new)
    for q in ("harbour", "東京"):
        assert scores(postings.search(after, q, BOOSTS)) == scores(ranked.bm25(now, q, BOOSTS))


def test_a_page_from_the_index_reads_no_text(spark, tmp_path):
    c = Catalog(spark, SF)
    kept = ranked.write_index(c, str(tmp_path / "index"), c.content_lines)
    for q in ("1", "Brand#1", "the", "machinery"):
        want = ranked.ranked_page(c, q, ALL, 0, 30, c.content_lines).collect()
        assert [tuple(r)[:2] for r in ranked.ranked_page(c, q, ALL, 0, 30, None, kept).collect()] == [tuple(r)[:2] for r in want]
    assert any("documents.parquet" in f for f in ranked.ranked_search(c, "the", ALL, c.content_lines).inputFiles())
    assert not any("documents.parquet" in f for f in ranked.ranked_search(c, "the", ALL, None, kept).inputFiles())
    legs = kept.packages.where(F.col("term").isin("", "the"))
    assert "PushedFilters: [In(term" in legs._jdf.queryExecution().executedPlan().toString().replace("`", "")


def test_grams_find_what_the_scan_finds(spark):
    rng = random.Random(2)
    rows = [(str(i), rng.choice([None, "", "".join(rng.choices("abÄ%_\\ 東京", k=rng.randrange(12)))]), "".join(rng.choices("ABc", k=4))) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, name string, title string")
    held = trigrams.grams(df, "id", ["name", "title"])
    for q in ("", "a", "B", "ab", "%", "_", "\\", "%_", "abc", "京 東", "ä%", "ABCA", "aaaaaaaaaaaa"):
        want = sorted(i for i, n, t in rows if q.lower() in (n or "").lower() and n is not None or q.lower() in t.lower())
        assert sorted(r.id for r in trigrams.containing(df, held, q, "id", ["name", "title"]).collect()) == want
    assert "left semi" in plan(trigrams.containing(df, held, "abc", "id", ["name", "title"])).lower().replace("leftsemi", "left semi")


def plain_fragment(text, words, size):
    """The best window by trying every hit."""
    import re

    hits = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in words]
    best = max(((sum(s <= a and b <= s + size for a, b in hits), -s) for s, _ in hits), default=(0, 0))
    if not best[0]:
        return None
    s = -best[1]
    last = max(b for a, b in hits if a >= s and b <= s + size)
    start = max(0, s - (size - (last - s)) // 2)
    end, out, at = min(len(text), start + size), "", start
    for a, b in hits:
        if a >= start and b <= end:
            out, at = out + text[at:a] + f"<mark>{text[a:b]}</mark>", b
    return best[0], start, end, out + text[at:end]


def test_fragments_equal_a_plain_search(spark):
    rng = random.Random(3)
    words = ["harbour", "Register", "the", "of", "harbours", "x", "\U0001f600", "é,"]
    texts = ["", "harbour", None] + [" ".join(rng.choices(words, weights=[1, 1, 5, 5, 2, 9, 1, 3], k=rng.randrange(150))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size in (6, 30, 100):
        for r in df.select("t", fragments.fragment(F.col("t"), "harbour register", size).alias("f")).collect():
            assert (tuple(r.f) if r.f else None) == (plain_fragment(r.t, {"harbour", "register"}, size) if r.t else None)
    assert df.select(fragments.fragment(F.col("t"), "…").alias("f")).where("f IS NOT NULL").count() == 0


def test_resource_highlights(spark):
    matched = spark.createDataFrame([("p", "r1"), ("p", "r2")], "package_id string, resource_id string")
    resources = spark.createDataFrame([("r1", "Harbour list", None), ("r2", "x", "東京の<b>港</b>湾")], "id string, name string, description string")
    got = {r.resource_id: (r.highlighted_name, r.highlighted_description) for r in ranked.resource_highlights(matched, resources, "harbour 港").collect()}
    assert got == {"r1": ("<mark>Harbour</mark> list", None), "r2": (None, "東京の<mark>港</mark>湾")}


def test_a_page_of_a_preview_opens_its_files_alone(spark, tmp_path):
    table = spark.range(12_345).select(F.col("id").alias("row_index"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    files.write_preview(table, str(tmp_path / "p"))
    preview = spark.read.parquet(str(tmp_path / "p"))
    for start, end, opened in ((0, 10, 1), (4_990, 5_010, 2), (12_340, 20_000, 1), (5, 5, 0)):
        got = files.read_rows(preview, start, end)
        assert [r.v for r in got.collect()] == [f"v{i}" for i in range(start, min(end, 12_345))]
        physical = got._jdf.queryExecution().executedPlan().toString()
        assert not opened or "PartitionFilters: [isnotnull(page" in physical
        named = files.read_rows(preview.select("*", F.col("_metadata.file_path").alias("file")), start, end)
        assert named.select("file").distinct().count() == opened


def test_names_in_the_readers_order(spark):
    rows = [("z", n, 1, 1, "", n.endswith("/")) for n in ("Zebra", "apfel", "Äpfel", "Apfel", "éclair", "eclair", "Eclair", "b c", "bc", "zoo/", "Åland/x")]
    entries = spark.createDataFrame(rows, "path string, name string, size long, compressed_size long, last_modified string, is_directory boolean")
    tree = files.path_tree(entries)
    want = ["Åland", "zoo", "apfel", "Apfel", "Äpfel", "b c", "bc", "eclair", "Eclair", "éclair", "Zebra"]
    top = files.placed(tree).where("parent = ''").orderBy("place")
    assert [r.name for r in top.collect()] == want
    assert [r.place for r in files.placed(tree).where("parent = 'Åland'").collect()] == [1]
