"""Documents after changes, and the states of jobs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalume.operators import incremental, listing, transitions
from catalume.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"
COLUMNS = ["id", "title", "organization", "formats", "resource_count", "tags", "groups"]


def documents(c):
    return listing.package_documents(c).select(*COLUMNS)


def changed(c, kind):
    """(the catalog after one change of a kind, the change set)."""
    number = F.col("id").cast("long")
    if kind == "package":
        after = incremental.with_tables(c, package_core=c.package_core.withColumn("title", F.when(number % 9 == 2, "new").otherwise(F.col("title"))).withColumn("state", F.when(number % 9 == 3, "deleted").otherwise(F.col("state"))))
        return after, c.package_core.where("CAST(id AS LONG) % 9 IN (2, 3)")
    if kind == "resource":
        after = incremental.with_tables(c, resource=c.resource.where(number % 17 != 0))
        return after, c.resource.where(number % 17 == 0)
    if kind == "package_tag":
        lost = F.col("package_id").cast("long") % 10 == 1
        return incremental.with_tables(c, package_tag=c.package_tag.where(~lost)), c.package_tag.where(lost)
    if kind == "package_group":
        lost = F.col("package_id").cast("long") % 10 == 4
        return incremental.with_tables(c, package_group=c.package_group.where(~lost)), c.package_group.where(lost)
    if kind == "tag":  # a tag goes, with its links
        return incremental.with_tables(c, package_tag=c.package_tag.where("tag <> 'Brand#7'")), c.tag.where("tag = 'Brand#7'")
    if kind == "grp":
        return incremental.with_tables(c, grp=c.grp.withColumn("title", F.when(F.col("id") == "2", "Other").otherwise(F.col("title")))), c.grp.where("id = '2'")
    return incremental.with_tables(c, organization=c.organization.withColumn("name", F.when(F.col("id") == "3", "renamed").otherwise(F.col("name")))), c.organization.where("id = '3'")


@pytest.mark.parametrize("kind", list(incremental.KINDS))
def test_documents_equal_a_full_rebuild(spark, kind):
    c = Catalog(spark, SF)
    after, rows = changed(c, kind)
    kept = spark.createDataFrame(documents(c).collect(), documents(c).schema)
    got = incremental.rebuilt(kept, c, after, {kind: rows})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, documents(after).collect()))
    assert sorted(map(tuple, got.collect())) != sorted(map(tuple, kept.collect()))


def test_only_affected_documents_are_made(spark):
    """The rest comes from the stored documents: what is wrong there stays."""
    c = Catalog(spark, SF)
    after, rows = changed(c, "package")
    stale = spark.createDataFrame(documents(c).collect(), documents(c).schema).withColumn("tags", F.lit("stored"))
    got = {r.id: r for r in incremental.rebuilt(stale, c, after, {"package": rows}).collect()}
    touched = {r.id for r in rows.collect()}
    assert touched and all((r.tags == "stored") == (i not in touched) for i, r in got.items())


def plain_states(events):
    state, out = "none", []
    for e in events:
        ok = e in transitions.LEGAL and state in transitions.LEGAL[e]
        before = state
        state = e if ok and e in transitions.STATES else state
        out.append((before, ok, state))
    return out


def made_log(spark, sizes, seed=1):
    rng, rows, t0 = random.Random(seed), [], datetime(2024, 1, 1)
    for job, n in sizes.items():
        for i in range(n):
            rows.append((len(rows), job, t0 + timedelta(seconds=i // 3), rng.choice(["step", "queued", "processing", "complete", "error", "pending", "odd", None])))
    return rows, spark.createDataFrame(rows, "id long, job string, ts timestamp, event string")


def test_states_equal_a_plain_fold(spark):
    """Short logs, one beyond two levels of groups, a job without a name, unknown events, and equal times."""
    rows, log = made_log(spark, {"a": 1, "b": 5, "long": 70_000, "c": 300, None: 40})
    told = transitions.transitions(log, "job", "ts", "id")
    got = {r.id: (r.before, r.accepted, r.after) for r in told.collect()}
    for job in ("a", "b", "long", "c", None):
        own = [r for r in rows if r[1] == job]
        for r, want in zip(own, plain_states([r[3] for r in own]), strict=True):
            assert got[r[0]] == want
    kept = {r.id for r in transitions.steps_kept(told, "job").collect()}
    for job in ("b", "c", None):
        own = [r for r in rows if r[1] == job]
        last = max((i for i, r in enumerate(own) if r[3] == "processing" and got[r[0]][1]), default=len(own))
        assert {r[0] for r in own if r[0] in kept} == {r[0] for i, r in enumerate(own) if i > last and r[3] == "step" and got[r[0]][1]}
    now = {r.job: (r.status, r.illegal) for r in transitions.current(told, "job").collect()}
    own = [got[r[0]] for r in rows if r[1] == "long"]
    assert now["long"] == (own[-1][2], sum(not ok for _, ok, _ in own))


def test_an_empty_log(spark):
    assert transitions.transitions(made_log(spark, {})[1], "job", "ts", "id").count() == 0
