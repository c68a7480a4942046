"""Every query with an oracle against DuckDB on the same files."""

import math

import duckdb
import pytest

from catalume import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_oracle_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_whole_jobs_lose_nothing(spark):
    found = registry.queries()
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes: dict = {}
    for r in found["content_chunks"](spark, SF).collect():
        sizes[r.resource_id] = sizes.get(r.resource_id, 0) + r.chunk_size
    assert sizes == {i: len(t.encode()) for i, t in texts.items() if t is not None}  # all within one chunk
