"""Connected components of a graph of any size, by stars.

Large and small star steps in turn (each node's neighbours are tied to its smallest one) until nothing
changes; every edge then ties a node to the smallest node of its component. A hub's edges are met by
partial minima and by joins that Spark may split, and never gathered; each round is written to the
shared folder, so a lost executor costs no more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, settle, settled


def _star(edges: DataFrame) -> DataFrame:
    """Both steps over edges (a, b), a > b, each a query of its own; the result is written."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = settled(both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
    out = materialise(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
    release(large)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and isn't the smallest of its component.

    ``edges`` has two columns of one orderable type; the order of the ends, repeats and loops don't matter,
    and edges with a null end are none; a graph without edges has no rows. A round's edges are deleted when
    the next ones are written.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    now = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").where(a.isNotNull() & b.isNotNull()).distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, before, now = found, now, _star(now)
        release(before)
        settle(now.sparkSession)
