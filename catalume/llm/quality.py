"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Words (runs of letters and digits, or of other visible characters) are hashed to ``BUCKETS`` buckets.
Every bucket has a fixed sparse index vector of a few +1 and -1; its context vector is the sum of the
index vectors of its neighbours, two on either side, at every occurrence in the whole corpus. Each task
sums its own texts in one table of fixed size, and the tables are added by bucket, so the statistics
cover all documents and still have a fixed size. A document's features are the mean of its words'
vectors, plain and weighted by rarity in the corpus, with their lengths, the mean product of neighbouring
vectors, the number of words and the share of distinct ones.

The network (numpy, one hidden layer) is trained on the driver on at most ``SAMPLE`` labelled documents,
those with the smallest hashes of their ids; a fifth of them is kept back to fit the temperature by
which the logit is divided, so that scores are calibrated probabilities. The text is all that a score
depends on.

Edge cases: null and empty texts have features zero and are scored like any other; a null id counts as
the empty text where folds are dealt; of a document with several labels each counts; repeated rows are
all scored, and equal texts alike to the last bit; without two kinds of label every score is the share of
label 1 (0.5 without labels); an empty table gives an empty result; a very long text is a portion of its
own; ``score`` keeps other columns, but for one with the name of the result, which is replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows, give_back, giving_back

BUCKETS, SIZE, NONZERO, REACH = 1 << 14, 64, 2, 2
SAMPLE, HIDDEN, EPOCHS = 20_000, 32, 40
_WORD = re.compile(r"\w+|[^\w\s]+")


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the places and signs of its index vector."""
    rng = np.random.default_rng(7)
    at = np.argsort(rng.random((BUCKETS, SIZE)), axis=1)[:, : 2 * NONZERO]
    return at.astype(np.int64), np.tile(np.repeat([1, -1], NONZERO), (BUCKETS, 1))


class Words:
    """Buckets of words; keeps those it has seen, up to a bound."""

    def __init__(self, most: int = 150_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def buckets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all words, and the number of words of each text."""
        if len(self.seen) > self.most:
            self.seen.clear()
        cut = [_WORD.findall(t) if t else [] for t in texts]
        for w in {w for ws in cut for w in ws} - self.seen.keys():
            self.seen[w] = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
        get = self.seen.__getitem__
        return np.fromiter((b for ws in cut for b in map(get, ws)), np.int64), np.array([len(ws) for ws in cut], np.int64)


def _portions(texts, most: int = 1_000_000):
    from .tokens import portions

    texts = list(texts)
    return [(part, texts[part]) for part in portions([len(t or "") for t in texts], most)]


def word_vectors(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, counts) of all buckets, from every text of ``df``."""

    def sums(batches):
        places, signs = _index_vectors()
        table, counts, words = np.zeros(BUCKETS * SIZE), np.zeros(BUCKETS), Words()
        for batch in batches:
            for _, texts in _portions(batch["text"]):
                b, n = words.buckets(texts)
                counts += np.bincount(b, minlength=BUCKETS)
                of = np.repeat(np.arange(len(n)), n)
                for d in range(1, REACH + 1):
                    near = np.flatnonzero(of[d:] == of[:-d])
                    left, right = b[near], b[near + d]
                    for here, there in ((left, right), (right, left)):
                        flat = (here[:, None] * SIZE + places[there]).ravel()
                        table += np.bincount(flat, signs[there].ravel(), BUCKETS * SIZE)
        got = np.flatnonzero(counts)
        out = pd.DataFrame(table.reshape(BUCKETS, SIZE)[got].astype(np.int64), columns=[f"c{i}" for i in range(SIZE)])
        out.insert(0, "n", counts[got].astype(np.int64))
        out.insert(0, "bucket", got.astype(np.int32))
        yield out

    names = ["n", *(f"c{i}" for i in range(SIZE))]
    parts = df.select(F.col(text).alias("text")).mapInPandas(giving_back(sums), "bucket int, " + ", ".join(f"{c} long" for c in names))
    with few_rows(df.sparkSession):
        found = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # BUCKETS rows at most
    vectors, counts = np.zeros((BUCKETS, SIZE)), np.zeros(BUCKETS)
    at = found["bucket"].to_numpy()
    for i, name in enumerate(names[1:]):
        vectors[at, i] = found[name].to_numpy()
    counts[at] = found["n"].to_numpy()
    # the mean context says nothing of a word: what all words share is taken off
    vectors -= counts[:, None] * (vectors.sum(0) / max(1.0, counts.sum()))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32), counts


class Pooling:
    """Features of texts from word vectors."""

    size = 2 * SIZE + 5

    def __init__(self, vectors: np.ndarray, counts: np.ndarray):
        self.vectors = vectors
        self.weights = (1e-3 / (1e-3 + counts / max(1.0, counts.sum()))).astype(np.float32)
        self.words = Words()

    def __call__(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for part, own in _portions(texts, 150_000):
            b, n = self.words.buckets(own)
            rows = np.arange(len(texts))[part][n > 0]
            if not len(b):
                continue
            n = n[n > 0]
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            v, w = self.vectors[b], self.weights[b]
            plain = np.add.reduceat(v, at) / n[:, None]
            rare = np.add.reduceat(v * w[:, None], at) / np.add.reduceat(w, at)[:, None]
            of = np.repeat(np.arange(len(n)), n)
            distinct = np.bincount(np.unique(of * BUCKETS + b) // BUCKETS, minlength=len(n))
            beside = np.concatenate([np.einsum("ij,ij->i", v[1:], v[:-1]) * (of[1:] == of[:-1]), [0]])
            more = [np.add.reduceat(beside, at) / np.maximum(n - 1, 1), np.linalg.norm(plain, axis=1), np.linalg.norm(rare, axis=1), np.log1p(n) / 8, distinct / n]
            out[rows] = np.column_stack([plain, rare, *more])
        return out


class Network:
    """A hidden layer of tanh units and a logit, trained by Adam on standardised features."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        kept = np.arange(len(x)) % 5 == 4
        z = (x - self.mean) / self.scale
        self.temperature, rate = 1.0, float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(rate / (1 - rate))]
        self.p = p = [np.asarray(a, float) for a in p]
        if len(set(y.tolist())) < 2:
            return self
        p[2][:] = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        train = np.flatnonzero(~kept)
        for _ in range(EPOCHS):
            order = rng.permutation(train)
            for i in range(0, len(order), 256):
                at, step = order[i : i + 256], step + 1
                h = np.tanh(z[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
                dh = np.outer(d, p[2]) * (1 - h * h)
                for k, g in enumerate((z[at].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d, d.sum())):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        logit, truth = self.logit(x[kept]), y[kept]
        if len(truth):
            loss = lambda t: np.logaddexp(0, np.where(truth > 0, -logit, logit) / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 101), key=loss)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Summed feature by feature, so that a row's logit doesn't depend on the rows beside it to the last bit."""
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tile(p[1], (len(x), 1))
        for i, weights in enumerate(p[0]):
            h += z[:, i : i + 1] * weights
        return (np.tanh(h) * p[2]).sum(1) + p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fold(id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 3


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[Pooling, Network]:
    """Word vectors from all of ``df``; the network from at most ``sample`` labels whose fold isn't 1."""
    pool = Pooling(*word_vectors(df))
    chosen = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold() != 1))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # a bounded number of rows: safe to broadcast

    def features(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": list(pool(list(batch["text"])))})

    with few_rows(df.sparkSession):
        found = df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(giving_back(features), "doc_id long, y double, x array<float>").toArrow()
    x, y = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, pool.size).astype(float), found["y"].to_numpy()
    order = np.lexsort((x.sum(1), y, [zlib.crc32(str(d).encode()) for d in found["doc_id"].to_pylist()]))
    network = Network().fit(x[order] if len(x) else np.zeros((1, pool.size)), y[order] if len(y) else np.full(1, 0.5))
    del found, x
    give_back()
    return pool, network


def score(df: DataFrame, pool: Pooling, network: Network, text: str = "text", to: str = "score") -> DataFrame:
    """``df`` with the score of each text; a column of that name is replaced."""
    df = df.drop(to)
    schema = df.withColumn(to, F.lit(0.0)).schema

    def scored(batches):
        for batch in batches:
            yield batch.assign(**{to: network.score(pool(list(batch[text])))})

    return df.mapInPandas(giving_back(scored), schema)


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``df``."""
    out = score(df.select("doc_id", "text"), *fit(df, labels)).select("doc_id", "score")
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
