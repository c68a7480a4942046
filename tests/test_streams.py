"""Streams: state that ends, and a sink that may be written twice."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalume.operators import transitions
from catalume.streaming import jobs, sink, state

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def parts(spark, df, path, n, order):
    """``df`` in ``n`` files in order, each read by a micro-batch of its own."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(stream, name, path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_rate_limit_equals_the_batch_and_its_state_shrinks(spark, store, tmp_path):
    events = spark.read.parquet(EVENTS).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).where("event_id < 400")
    wait = 2 * 3600.0
    want = {(r.user_id, r.ts, r.accepted) for r in jobs.rate_limited(events, "user_id", "ts", wait, "event_id").collect()}
    stream = parts(spark, events.select("user_id", "ts"), str(tmp_path / "in"), 5, ["ts"])
    query = run(state.rate_limited_stream(stream, "user_id", "ts", wait), "limited", str(tmp_path / "ck"))
    assert {tuple(r) for r in spark.table("limited").collect()} == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    users = events.select("user_id").distinct().count()
    assert held and min(held[len(held) // 2 :]) < users  # hosts not seen for a while are forgotten


def test_job_states_equal_the_batch(spark, store, tmp_path):
    kind = F.col("event_type")
    event = F.when(kind == "click", "step").when(kind == "signup", "queued").when(kind == "view", "processing").when(kind == "purchase", "complete").otherwise("error")
    log = spark.read.parquet(EVENTS).select("event_id", F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), event.alias("event")).where("event_id < 400")
    want = {(r.job, r.event_id, r.before, r.accepted, r.after) for r in transitions.transitions(log, "job", "ts", "event_id").collect()}
    stream = parts(spark, log, str(tmp_path / "in"), 4, ["ts", "event_id"])
    run(state.transitions_stream(stream, "job", "ts", "event_id", seconds=365 * 86400), "states", str(tmp_path / "ck"))
    assert {tuple(r) for r in spark.table("states").collect()} == want


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    """A run dies between the write and the record of a batch; the next one begins there again."""
    t0 = datetime(2024, 1, 1)
    rows = [(i % 40, t0 + timedelta(seconds=i), f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "key int, ts timestamp, value string")
    stream = parts(spark, df, str(tmp_path / "in"), 4, ["ts"])
    out, check = str(tmp_path / "out"), str(tmp_path / "ck")

    def die(batch: int) -> None:
        if batch == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        sink.start(stream, out, check, die).awaitTermination()
    assert sink.rows(spark, out).count() == 100  # the batch that isn't recorded isn't seen
    sink.start(stream, out, check).awaitTermination()
    assert sorted((r.key, r.ts, r.value) for r in sink.rows(spark, out).collect()) == sorted(rows)
    last = {r.key: r.value for r in sink.latest(spark, out, ["key"], ["ts"]).collect()}
    assert last == {k: f"v{160 + k}" for k in range(40)}
