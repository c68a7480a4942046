"""A kept index for "contains": the grams of short texts, with their rows.

A search reads its rarest gram alone, as ``contains`` checks the candidates anyhow; no table of ids is held in memory.

Every character of a text in lower case begins a gram of three characters (of what is left, at the end), so each
stretch of three characters is a gram, and a shorter one begins a gram. A term's candidates are the rows that hold
the rarest of its grams; ``contains`` then checks these alone. Wildcards in a term are characters like others.

Edge cases: null texts have no grams; an empty term asks for all rows; case is folded by lower case on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import contains

SIZE = 3


def grams(df: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """(gram, id), distinct, of all the columns' texts."""
    of = lambda c: F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.lower(c), i, F.lit(SIZE))))
    own = F.array_distinct(F.flatten(F.array(*[F.coalesce(of(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    texts = df.select(F.col(id).cast("string").alias("id"), *columns).repartition("id")  # dealt by id, so rows of one id meet before they become grams
    return texts.select("id", own.alias("own")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own")).select("id", F.explode("own").alias("gram"))


def write_grams(found: DataFrame, path: str) -> None:
    found.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.option("compression", "zstd").parquet(path)


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, gram string").parquet(path)


def candidates(found: DataFrame, q: str) -> DataFrame | None:
    """(id) of the rows that may hold ``q``, some of them several times; None if all may."""
    low = q.lower()
    if not low:
        return None
    if len(low) < SIZE:
        return found.where(F.col("gram").startswith(low)).select("id")
    wanted = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    held = {r.gram: r.n for r in found.where(F.col("gram").isin(*wanted)).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # as many rows as the term has grams, at most
    return found.where(F.col("gram") == min(wanted, key=lambda g: held.get(g, 0))).select("id")


def containing(df: DataFrame, found: DataFrame, q: str, id: str, columns: Sequence[str]) -> DataFrame:
    """The rows of ``df`` in which one of the columns holds ``q``, whatever the case; only candidates are checked."""
    some = candidates(found, q)
    held = df if some is None else df.join(some.withColumnRenamed("id", id), id, "left_semi")
    return held.where(contains(q, *columns))
