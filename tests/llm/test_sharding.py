from collections import Counter

import pytest
from conftest_llm import documents

from catalume.llm import sharding


def test_every_slot_is_claimed_in_turn():
    table = sharding.lookup_table(sharding.SHARDS)
    counts = Counter(table)
    assert len(table) == sharding.TABLE_SIZE and max(counts.values()) - min(counts.values()) <= 1


def test_the_claiming_order_by_whole_permutations():
    """Each shard's order written out, and turns taken over it."""
    import hashlib

    names, size = [f"n{i}" for i in range(7)], 211
    number = lambda text: int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big") >> 4
    orders = []
    for name in names:
        offset, skip = number(f"{name}/offset") % size, number(f"{name}/skip") % (size - 1) + 1
        orders.append([(offset + k * skip) % size for k in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    owner: dict = {}
    while len(owner) < size:
        for shard, order in enumerate(orders):
            wanted = [slot for slot in order if slot not in owner]
            if wanted:
                owner[wanted[0]] = shard
    assert sharding.lookup_table(names, size) == [owner[i] for i in range(size)]


def test_few_slots_move_when_a_shard_goes():
    names = [f"n{i}" for i in range(20)]
    before, after = sharding.lookup_table(names, 10_007), sharding.lookup_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.1 * 10_007


def test_weights():
    counts = Counter(sharding.lookup_table(["a", "b"], 1009, [3, 1]))
    assert abs(counts[0] / counts[1] - 3) < 0.05


@pytest.mark.parametrize("args", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(args):
    with pytest.raises(ValueError):
        sharding.lookup_table(*args)


def test_odd_rows(spark, odd_rows):
    df = documents(spark, odd_rows).withColumnRenamed("row", "slot").withColumnRenamed("fp", "shard")
    got = sharding.assign_shards(df, ["doc_id"]).select("doc_id", "slot", "shard").collect()
    assert len(got) == len(odd_rows) and all(0 <= r.slot < sharding.TABLE_SIZE for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    by_text = sharding.assign_shards(df, ["text"]).select("doc_id", "slot").collect()
    slots = {r.doc_id: r.slot for r in by_text}
    assert slots[1] != slots[2] and slots[6] == slots[7]
    assert sharding.assign_shards(documents(spark, []), ["doc_id"]).count() == 0


def test_written_shards_hold_all_rows(spark, odd_rows, tmp_path):
    sharding.write_shards(documents(spark, odd_rows), ["doc_id"], str(tmp_path / "out"), pieces=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(odd_rows)
