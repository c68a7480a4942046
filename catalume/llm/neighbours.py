"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits a bounded sample of the vectors (``SAMPLE``, those with the smallest hashes of their
ids) at the median of their projections on the difference of two random ones, down to ``LEAF`` vectors.
Every row is then assigned to a leaf of every tree. A query walks all trees through one shared priority
queue: the nearer side at once, the farther side at the price of the squared margins crossed on the way.
It visits leaves until they hold enough rows, a row counted once a tree: ``REACH`` times as many as there
are at ``AT`` rows, and a share that falls with the tenth root of the number of rows from there, as nearest
neighbours stand out the more the more rows there are; ``top`` + 1 rows in every tree at least. The rows in
those leaves are scored exactly, in double precision, and the best are kept.

Leaves are grouped to parts of about ``PART`` rows (a larger leaf is split), queries to blocks of
``PART``, so a task holds one part and one block. Of equal vectors only the ``top`` + 1 smallest ids can
be among anyone's nearest, so only those are indexed: copies make no hot leaf, and the result is the same.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another length than
the most frequent one in the sample take no part; a null id neither; rows with the query's id are its
own; a repeated row counts once, and one id with several vectors is answered for each; equal scores go by
the smaller id; an empty table, or one without such vectors, gives an empty result; columns other than the
id and the vector are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

TREES, LEAF, SAMPLE = 8, 64, 16_384
REACH, AT, PART = 1.2, 2_000, 32_768


class Forest:
    """Nodes of all trees in arrays; a child below zero is leaf ``-1 - child``. Leaves are numbered across trees."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.planes, self.cuts, self.children, self.roots, self.shares, self.tree_of = [], [], [], [], [], []
        for tree in range(trees):
            self.roots.append(self._split(sample, np.arange(len(sample)), leaf, rng, tree))
        d = sample.shape[1]
        self.planes = np.array(self.planes).reshape(-1, d)
        self.cuts, self.shares, self.tree_of = np.array(self.cuts), np.array(self.shares), np.array(self.tree_of)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _split(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng, tree: int) -> int:
        for _ in range(4 if len(rows) > leaf else 0):
            a, b = rng.choice(rows, 2, replace=False)
            plane = x[a] - x[b]
            size = np.linalg.norm(plane)
            if size:
                at = x[rows] @ (plane / size)
                cut = np.median(at)
                right = at > cut
                if right.any() and not right.all():
                    me = len(self.cuts)
                    self.planes.append(plane / size)
                    self.cuts.append(cut)
                    self.children.append((0, 0))
                    self.children[me] = tuple(self._split(x, rows[side], leaf, rng, tree) for side in (~right, right))
                    return me
        self.shares.append(len(rows) / len(x))
        self.tree_of.append(tree)
        return -len(self.shares)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, one column a tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while len(rows := np.flatnonzero(at >= 0)):
                node = at[rows]
                right = np.einsum("ij,ij->i", x[rows], self.planes[node]) > self.cuts[node]
                at[rows] = self.children[node, right.astype(np.int64)]
            out[:, tree] = -1 - at
        return out

    def visit(self, x: np.ndarray, reach: float) -> list[list[int]]:
        """The leaves that each query visits, until their shares sum up to ``reach``."""
        margins = x @ self.planes.T - self.cuts if len(self.cuts) else np.zeros((len(x), 0))
        children, shares, out = self.children.tolist(), self.shares.tolist(), []
        for own in margins.tolist():
            queue = [(0.0, root) for root in self.roots]
            found, held = [], 0.0
            while queue and held < reach:
                price, node = heapq.heappop(queue)
                while node >= 0:
                    m = own[node]
                    near, far = children[node][m > 0], children[node][m <= 0]
                    heapq.heappush(queue, (price + m * m, far))
                    node = near
                found.append(-1 - node)
                held += shares[-1 - node]
            out.append(found)
        return out


def usable(vector: str):
    """Vectors that take part, apart from their length."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``top`` best candidates of one query; ``scores`` only preselects."""
    rows = np.flatnonzero(scores > -np.inf)
    if len(rows) > top:
        least = np.partition(scores[rows], len(rows) - top)[len(rows) - top]
        rows = rows[scores[rows] >= least - 1e-9 * (1 + abs(least))]
    exact = (x[rows] * q).sum(1)
    order = np.lexsort((ids[rows], -exact))[:top]
    return ids[rows][order], exact[order]


def reach_of(n: int, trees: int, top: int, reach: float = REACH) -> float:
    """How many times ``n`` rows a query visits, a row counted once a tree."""
    return min(trees, max(reach * (AT / max(n, 1)) ** 0.1, trees * (top + 1) / max(n, 1)))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, id: str = "vec_id", vector: str = "embedding", reach: float = REACH, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``top`` largest inner products found for each row of ``queries``."""
    numbers = "array<float>" if vectors.schema[vector].dataType == ArrayType(FloatType(), vectors.schema[vector].dataType.containsNull) else "array<double>"
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast(numbers).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    asked = queries.select(F.col(id).cast("long").alias("query_id"), F.col(vector).cast(numbers).alias("v")).where(F.col("query_id").isNotNull() & usable("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # a bounded sample
    if not len(drawn):
        return vectors.sparkSession.createDataFrame([], schema)
    size = int(drawn["v"].map(len).mode().max())
    forest = Forest(np.stack(drawn["v"][drawn["v"].map(len) == size].to_list()).astype(float))
    rows, asked = rows.where(F.size("v") == size), asked.where(F.size("v") == size)
    n, n_asked = rows.count(), asked.count()
    copy = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.dropDuplicates().withColumn("copy", F.row_number().over(copy)).where(F.col("copy") <= top + 1).drop("copy")

    leaves = len(forest.shares)
    group = max(1, round(PART * leaves / len(forest.roots) / max(n, 1)))  # leaves to a part
    pieces = max(1, -(-n * len(forest.roots) // (leaves * PART)))  # parts to a leaf
    blocks = max(1, -(-n_asked // PART))
    first = np.array([np.argmax(forest.tree_of == t) for t in range(len(forest.roots))])
    part_of = forest.tree_of * 1_000_000 + (np.arange(leaves) - first[forest.tree_of]) // group  # a part is of one tree
    far = reach_of(n, len(forest.roots), top, reach)

    def index(batches):
        for batch in batches:
            if len(batch):
                ids = batch["vec_id"].to_numpy(np.int64)
                found = forest.leaves(np.stack(batch["v"].to_list()).astype(float))
                for tree in range(found.shape[1]):
                    for block in range(blocks):
                        yield pd.DataFrame({"part": part_of[found[:, tree]].astype(np.int32), "piece": (ids % pieces).astype(np.int32), "block": np.int32(block), "leaf": found[:, tree].astype(np.int32), "vec_id": ids, "v": batch["v"]})

    def route(batches):
        for batch in batches:
            for i in range(0, len(batch), 500):
                own = batch[i : i + 500]
                out = []
                for query, v, found in zip(own["query_id"], own["v"], forest.visit(np.stack(own["v"].to_list()).astype(float), far), strict=True):
                    by: dict[int, list[int]] = {}
                    for leaf in found:
                        by.setdefault(int(part_of[leaf]), []).append(leaf)
                    out += [(part, piece, (query * 2_654_435_761 >> 9) % blocks, ls, query, v) for part, ls in by.items() for piece in range(pieces)]
                yield pd.DataFrame(out, columns=["part", "piece", "block", "leaves", "query_id", "v"])

    def search(held: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked_):
            x, ids, leaf = np.stack(held["v"].to_list()).astype(float), held["vec_id"].to_numpy(np.int64), held["leaf"].to_numpy(np.int64)
            low = leaf.min()
            for i in range(0, len(asked_), 128):
                own = asked_[i : i + 128]
                q = np.stack(own["v"].to_list()).astype(float)
                seen = np.zeros((len(own), leaf.max() - low + 1), bool)
                for k, ls in enumerate(own["leaves"]):
                    at = np.asarray(ls, np.int64) - low
                    seen[k, at[(at >= 0) & (at < seen.shape[1])]] = True
                scores = np.where(seen[:, leaf - low], q @ x.T, -np.inf)
                for k, query in enumerate(own["query_id"]):
                    scores[k, ids == query] = -np.inf
                    got, exact = _best(scores[k], q[k], x, ids, top)
                    out.append(pd.DataFrame({"query_id": query, "q": [own["v"].iloc[k].tobytes()] * len(got), "vec_id": got, "score": exact}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "q", "vec_id", "score"])

    members = kept.mapInPandas(index, f"part int, piece int, block int, leaf int, vec_id long, v {numbers}").groupBy("part", "piece", "block")
    routed = asked.dropDuplicates().mapInPandas(route, f"part int, piece int, block int, leaves array<int>, query_id long, v {numbers}").groupBy("part", "piece", "block")
    hits = members.cogroup(routed).applyInPandas(search, "query_id long, q binary, vec_id long, score double")
    hits = hits.groupBy("query_id", "q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
