"""Golden cases of files, texts, scalars, and the job stream."""

import io
import itertools
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalume.functions import scalars as s
from catalume.functions import text
from catalume.operators import mutations, ranked
from catalume.sources import files
from catalume.streaming import jobs


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def archive(names, **more):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in names:
            z.writestr(n, "" if n.endswith("/") else more.get("body", "hello"))
    return data.getvalue()


@pytest.mark.parametrize(
    ("data", "want"),
    [(b"a,b\n1,2", "ASCII"), ("人口,統計".encode("cp932"), "SJIS"), ("人口,統計".encode(), "UTF8"), ("人口統計データ".encode("euc_jp"), "EUCJP"), ("人口".encode("iso2022_jp"), "JIS"), (b"", "UTF8"), (b'<?xml version="1.0" encoding="Shift_JIS"?>', "SJIS")],
)
def test_encodings(data, want):
    assert text.encoding_of(data) == want


def test_tables_lose_title_and_footer_rows():
    rows = files.table_rows("Population\n\nname,count,\na,1\nb,2,3\nTotal,3\n※ note\n")
    assert rows == [["name", "count", ""], ["a", "1"], ["b", "2", "3"]]
    assert files.table_rows("a\tb\n1\t2\n") == [["a", "b"], ["1", "2"]]
    assert files.table_rows("only\none\ncolumn") == [["only"], ["one"], ["column"]]
    assert files.column_names(["a", "", "A", "a"]) == ["a", "column_1", "A_2", "a_3"]
    assert files.table_rows("") == []


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("名前,数\n東京,1\n大阪,2,9\n合計,3\n".encode("cp932"))
    (tmp_path / "wide.csv").write_text(",".join(f"c{i}" for i in range(501)) + "\n1\n")
    found = files.with_encoding(files.objects(spark, str(tmp_path)))
    tables = files.extract_tables(found)
    path = found.where("path LIKE '%t.csv'").first().path
    table = files.typed_rows(tables, path)
    assert table.columns == ["row_index", "名前", "数"] and sorted(r["名前"] for r in table.collect()) == ["大阪", "東京"]
    assert "columns" in tables.where("error IS NOT NULL").first().error
    files.write_preview(table, str(tmp_path / "preview"))
    assert [r["数"] for r in files.read_rows(spark.read.parquet(str(tmp_path / "preview")), 1, 2).collect()] == ["2"]
    (r,) = files.byte_range(found.where("path LIKE '%wide.csv'"), 3, 5).collect()
    assert bytes(r.part) == b"c1," and r.start == 3 and r.end == 5
    (r,) = files.text_preview(found.where("path LIKE '%t.csv'"), limit=4).collect()
    assert r.text == "名前" and r.truncated and r.charset == "shift_jis"
    assert files.fetched(found).where("hash LIKE 'sha256:%'").count() == 2


def test_archives(spark):
    rows = [("a.zip", archive(["x/", "x/one.txt", "two.txt"])), ("bad.zip", b"PK nothing"), ("empty.zip", archive([]))]
    entries = files.zip_entries(spark.createDataFrame(rows, "path string, content binary"))
    (m,) = files.zip_manifest(entries).collect()
    assert (m.path, m.files, m.size, m.truncated) == ("a.zip", 2, 10, False)
    tree = {(r.node, r.is_directory) for r in files.path_tree(entries).collect()}
    assert tree == {("x", True), ("x/one.txt", False), ("two.txt", False)}


def test_office_texts(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<si><t>shared\ntext</t></si>")
        z.writestr("xl/worksheets/sheet1.xml", '<c t="s"><v>0</v></c><c t="inlineStr"><is><t> in\nline </t></is></c><c><v>\n42\n</v></c><c/>')
    rows = [("a", data.getvalue(), "docx"), ("b", sheet.getvalue(), "XLSX"), ("c", b"x", "docx"), ("d", b"x", "pdf")]
    got = {r.path: (r.text, r.error is None) for r in files.document_texts(spark.createDataFrame(rows, "path string, content binary, format string")).collect()}
    assert got["a"] == ("One & two\nthree", True) and got["b"] == ("shared\ntext\nin\nline\n42", True)
    assert got["c"] == (None, False) and got["d"] == (None, False)


def test_geojson(spark):
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[139.7,35.6]},"properties":{"name":"a","n":1}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1.5,-2],[3,4]]},"properties":{}}]}'
    features = files.geojson_features(spark.createDataFrame([("f", doc)], "path string, text string"))
    assert features.orderBy("at").first().properties == {"name": "a", "n": "1"}
    assert tuple(files.feature_bounds(features).first()[1:]) == (1.5, -2.0, 139.7, 35.6)


def plain_chunks(whole, limit, last_break, keep):
    """Line by line: a chunk ends where the next line doesn't fit; without ``last_break`` its last newline is spared."""
    extra, out, held, size = 0 if last_break else 1, [], [], 0
    if len(whole.encode()) <= limit:
        return [whole]
    for line in whole.split("\n"):
        n = len(line.encode()) + 1
        if held and (size + n - extra > limit or n - extra > limit):
            out.append("\n".join(held))
            held, size = [], 0
        if n - extra > limit:
            piece, used = "", 0
            for ch in line:
                if used + len(ch.encode()) > limit:
                    out.append(piece)
                    piece, used = "", 0
                    if not keep:
                        break
                piece, used = piece + ch, used + len(ch.encode())
            out += [piece] if piece else []
        else:
            held.append(line)
            size += n
    return out + (["\n".join(held)] if held else [])


def test_chunks_equal_a_plain_fold(spark):
    rng = random.Random(4)
    texts = ["", "x" * 200, "line1\nline2\nline3", "\n" * 40, "日本語" * 9, "é\n" + "漢😀" * 20]
    texts += ["\n".join("".join(rng.choice("ab é漢😀") for _ in range(rng.choice((0, 1, 3, 8, 30)))) for _ in range(rng.randrange(1, 10))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit, keep, last_break in itertools.product((4, 9, 30), (True, False), (True, False)):
        for r in df.select("t", text.chunked(F.col("t"), limit, None, keep, last_break).alias("c"), text.chunked(F.col("t"), limit, 2, keep, last_break).alias("two")).collect():
            assert r.c == plain_chunks(r.t, limit, last_break, keep) and r.two == r.c[:2]
            assert all(len(c.encode()) <= limit for c in r.c)
            if keep:
                assert "".join(r.c).replace("\n", "") == r.t.replace("\n", "")
    assert one(spark, text.truncate_column(F.lit("日本語"), 4)) == "日" and one(spark, text.truncate_column(F.lit("日本語"), 9)) == "日本語"


def test_chunks_of_a_table_lose_nothing(spark):
    rows = [("r1", "p", "text", "one\ntwo\n" + "x" * 70 + "\n漢字 end"), ("r2", "p", "text", ""), ("r3", "p", "text", None), ("r4", "p", "text", "short")]
    df = spark.createDataFrame(rows, "resource_id string, package_id string, content_type string, text string")
    got = text.content_chunks(df, 20).orderBy("resource_id", "chunk_index").collect()
    assert [(r.resource_id, r.chunk_index) for r in got] == [*(("r1", i) for i in range(6)), ("r2", 0), ("r4", 0)]
    assert "".join(r.extracted_text for r in got[:6]).replace("\n", "") == rows[0][3].replace("\n", "")
    totals = {r.resource_id: (r.chunks, r.indexed, r.original) for r in text.chunk_totals(text.content_chunks(df, 20), df).collect()}
    assert totals["r2"] == (1, 0, 0) and totals["r4"] == (1, 5, 5) and totals["r1"][0] == 6


def test_manifests_and_trees(spark, tmp_path):
    rows = [("z", "b/file.txt", 3, 1, "2020", False), ("z", "A.txt", 4, 2, "2020", False), ("z", "a/", 0, 0, "2020", True)]
    entries = spark.createDataFrame(rows, "path string, name string, size long, compressed_size long, last_modified string, is_directory boolean")
    files.write_manifest(files.zip_manifest(entries, 2), str(tmp_path / "manifest"))
    assert [r.value for r in spark.read.text(str(tmp_path / "manifest")).collect()] == ['{"path":"z","files":2,"size":7,"compressed":3,"truncated":true}']
    assert [r.node for r in files.tree_order(files.path_tree(entries)).collect()] == ["a", "b", "A.txt", "b/file.txt"]
    assert [r.name for r in files.kept_entries(entries, 2).collect()] == ["A.txt", "a/"]


def test_scalars(spark):
    col = F.lit
    assert one(spark, s.strip_tags_but_mark(col("<script>x</script><mark>y</mark><img src=1>"))) == "x<mark>y</mark>"
    assert [one(spark, s.extension(col(n))) for n in ("a.CSV", ".hidden", "none", "name.")] == ["csv", None, None, None]
    assert [one(spark, s.format_bytes(col(n))) for n in (0, 1023, 1536, 5 << 20)] == ["0 B", "1023 B", "1.5 KB", "5.0 MB"]
    assert one(spark, s.format_bytes(col(-1))) is None and one(spark, s.parse_size(col("12.5kb"))) == 12800
    assert one(spark, s.json_merge(col('{"a":"1","b":"2"}'), col('{"b":"3"}'))) == '{"a":"1","b":"3"}'
    assert one(spark, s.percent_encode(col("a b/ü"))) == "a%20b%2F%C3%BC"
    changed = [("e1", "e2", None, None, True), ("e", "e", "a", "b", False), (None, None, "a", "b", True), (None, None, None, "b", False)]
    df = spark.createDataFrame(changed, "a string, b string, c string, d string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", s.header_changed(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect())
    assert one(spark, s.plain_markdown(col("**b** [t](u) `c` &lt;x&gt;"))) == "b t c <x>"


def test_highlights(spark):
    long = "filler words " * 60 + "the harbour Register is here " + "more words " * 60
    assert one(spark, ranked.highlight(F.lit("Harbour harbours"), "harbour")) == "<mark>Harbour</mark> harbours"
    got = one(spark, ranked.fragment(F.lit(long), "harbour register", 200))
    assert "<mark>harbour</mark> <mark>Register</mark>" in got and len(got) <= 200 + 26
    assert one(spark, ranked.fragment(F.lit(long), "absent", 200)) is None
    hostile = F.lit("<script>alert(1)</script>harbour <img onerror=alert(1)>")
    assert one(spark, ranked.highlight(hostile, "harbour")) == "alert(1)<mark>harbour</mark> "
    assert one(spark, ranked.fragment(hostile, "harbour")) == "alert(1)<mark>harbour</mark> "
    assert one(spark, ranked.highlight(F.lit("<b>x</b>"), "")) == "x"


def test_legs_are_merged(spark):
    p = spark.createDataFrame([("a", 2.0)], "id string, score double")
    r = spark.createDataFrame([("r1", "a", 1.0), ("r2", "a", 3.0), ("r3", "b", 2.0)], "id string, package_id string, score double")
    c = spark.createDataFrame([("r9", "c", 0, 9.0), ("r1", "a", 0, 9.0)], "resource_id string, package_id string, chunk_index int, score double")
    got = {x.id: (round(x.score, 6), x.source) for x in ranked.merge_legs(p, r, c).collect()}
    assert got == {"a": (3.2, "package"), "b": (0.8, "resource"), "c": (0.4, "content")}


def test_rate_limit(spark):
    t0 = datetime(2024, 1, 1)
    events = [(h, t0 + timedelta(milliseconds=ms)) for h, ms in (("a", 0), ("a", 500), ("a", 1001), ("a", 1900), ("a", 2002), ("b", 10), ("b", 1010), ("b", 1011), (None, 5), (None, 6))]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(events)], "id long, host string, ts timestamp")
    got = [r.accepted for r in jobs.rate_limited(df, "host", "ts", 1.0, "id").orderBy("id").collect()]
    assert got == [True, False, True, False, True, True, False, True, True, False]
    assert jobs.rate_limited(df.limit(0), "host", "ts", 1.0, "id").count() == 0


def test_job_stream(spark, tmp_path):
    lines = ['{"id":"1","type":"process-resource","data":{"x":1}}', "not json", '{"id":"2","type":"other"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    seen = []
    jobs.consume(spark.readStream.text(str(tmp_path / "in")), lambda df, _: seen.extend(r.job_id for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert seen == ["1"]


def test_reorder(spark):
    df = spark.createDataFrame([("a", "p", "active", 0), ("b", "p", "active", 1), ("c", "p", "deleted", 2)], "id string, package_id string, state string, position int")
    assert mutations.reorder_errors(df, "p", ["b", "a"]) == [] and mutations.reorder_errors(df, "p", ["a", "a"]) == ["repeated", "missing"]
    assert {r.id: r.position for r in mutations.reorder(df, ["b", "a"]).collect()} == {"b": 0, "a": 1, "c": 2}
