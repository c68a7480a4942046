"""Sharding through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table whose size is prime: it starts at an
offset and moves on by a skip, both from a digest of the shard's name, so that it meets every slot.
The shards take turns; in its turn a shard claims the first slot in its order that is still free
(a shard of weight w has w turns a round). The table has a fixed size whatever the data, so it is
broadcast, and a row finds its shard by one hash and one lookup. Adding or removing a shard moves
few rows besides those that must move.

Edge cases: a null key column counts as the empty string of that column, marked as null, so null and
'' differ; repeated rows get the same shard; an empty table gives an empty result; columns of the
input named like the output are replaced by the output's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """The shard number of each slot. ``size`` must be prime and no less than the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime no less than the number of shards")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one positive weight a shard")
    at = [_digest(f"{name}/offset") % size for name in shards]
    skip = [_digest(f"{name}/skip") % (size - 1) + 1 for name in shards]
    slots = [-1] * size
    free = size
    while free:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while slots[at[shard]] >= 0:
                    at[shard] = (at[shard] + skip[shard]) % size
                slots[at[shard]] = shard
                free -= 1
    return slots


def slot_of(keys: Sequence[str], size: int):
    """The slot of a row: the first 60 bits of the md5 of its key columns, modulo the table's size."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long") % F.lit(size)).cast("int")


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (string).

    Place rows by a key that is distinct or nearly so: all rows of one key share a shard by design.
    The plan is one broadcast lookup of ``size`` rows; nothing is shuffled.
    """
    numbers = ",".join(map(str, lookup_table(shards, size, weights)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    lookup = (
        df.sparkSession.range(1)
        .select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "number"))
        .select("slot", F.element_at(names, F.col("number").cast("int") + 1).alias("shard"))
    )
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(keys, size))
    return placed.join(F.broadcast(lookup), "slot").select(*[F.col(f"`{c}`") for c in placed.columns], "shard")


def write_shards(df: DataFrame, keys: Sequence[str], path: str, pieces: int = 1, **options) -> None:
    """Write ``df`` as one folder a shard, each dealt to ``pieces`` tasks so that a large shard is no single task."""
    placed = assign_shards(df, keys, **options)
    placed.repartition(F.col("shard"), F.col("slot") % F.lit(pieces)).write.partitionBy("shard").parquet(path)
