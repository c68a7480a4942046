import numpy as np

from catalume.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, part int, leaf int"


def exact(rows, queries, top):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in queries:
        s = (x * np.array(v, np.float32).astype(float)).sum(1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:top]
        out[i] = [(int(ids[k]), s[k]) for k in order]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    rows = list(zip(pdf.vec_id.tolist(), pdf.embedding.tolist(), strict=True))
    asked = [r for r in rows if r[0] % 20 == 0]
    want = exact(rows, asked, 20)
    got: dict = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - (x[q] * x[v]).sum()) < 1e-12 for _, v, s in found)
        assert [(f[2], -f[1]) for f in found] == sorted(((f[2], -f[1]) for f in found), reverse=True)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert len(got) == len(asked) and hits / (20 * len(asked)) >= 0.9


def test_recall_of_the_shipped_settings_where_part_of_the_rows_is_visited(spark):
    """Queries divisible by 100 against all rows, at two sizes; less than the whole is visited at both."""
    forest_reach = [neighbours.reach_of(n, neighbours.TREES, 20) for n in (2_000, 50_000, 5_000_000)]
    assert forest_reach == sorted(forest_reach, reverse=True) and forest_reach[0] < 0.2 * neighbours.TREES
    rng = np.random.default_rng(9)
    for n in (2_000, 12_000):
        x = rng.normal(size=(n, 64)).astype(np.float32)
        rows = [(i, (v / np.linalg.norm(v)).tolist(), 0, 1, 2) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, SCHEMA)
        got = neighbours.nearest(df, df.where("vec_id % 100 = 0")).collect()
        want = exact([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 100 == 0], 20)
        assert sum(r.vec_id in {w[0] for w in want[r.query_id]} for r in got) / (20 * len(want)) >= 0.9


def test_doubles_are_scored_as_doubles(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0 / 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id = 20")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(39, 18, -1) if i != 20]
    assert all(r.score == rows[20][1][0] * rows[r.vec_id][1][0] + rows[20][1][1] * rows[r.vec_id][1][1] for r in got)


def test_recall_where_only_part_of_the_rows_is_visited(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 500)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 24))
    rows = [(i, v.astype(np.float32).tolist(), 0, 1, 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.nearest(df, df.where("vec_id % 100 = 0"), top=10).collect()
    want = exact([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 100 == 0], 10)
    hits = sum(r.vec_id in {w[0] for w in want[r.query_id]} for r in got)
    assert hits / 600 >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (20, [1.0, 0.5]), (40, None), (2, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], SCHEMA)
    got: dict = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [2, 1, 20], 20: [1, 0, 2]}


def test_many_copies_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0], 0, 1, 2) for i in range(500)] + [(1000, [3.0, 3.0], 0, 1, 2)], SCHEMA)
    got = neighbours.nearest(df, df.where("vec_id = 400")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1000, *range(19)]
    assert neighbours.nearest(df.limit(0), df).count() == 0


def test_repeated_rows_take_no_place_of_other_ids_with_the_same_vector(spark):
    rows = [(7, [1.0, 1.0])] * 25 + [(8, [1.0, 1.0]), (9, [1.0, 1.0]), (20, [1.0, 1.0]), (30, [0.5, 0.0])]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], SCHEMA)
    got = neighbours.nearest(df, df.where("vec_id = 20")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7, 8, 9, 30]
