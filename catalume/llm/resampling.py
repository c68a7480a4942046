"""Importance resampling towards a target distribution, by hashed runs of words.

Each document and each target text is scanned once. The scan holds a ring of running CRC states, one for each
of the last n starts: a new word extends every state by a space and the word, and opens one of its own, so
that after each word the ring holds the CRC of every run that ends there, and no run is ever joined as a
string. A run's bucket is that CRC modulo ``BUCKETS``. The buckets of a document, with their counts, are
written to the shared folder, and everything else reads them in place of texts.

The counts of all documents and of all target texts give each bucket a gain, the logarithm of its smoothed
share in the target over that in the documents; a document's weight is the sum over its runs. Adding Gumbel
noise, which a hash of the id decides, and taking the highest scores draws documents without replacement in
proportion to their weights. Ranks come from a range-partitioned order: a row's rank is its place in its part
and the sizes of the parts before, so no task ever holds all rows.

Edge cases: null and empty texts have no runs, weight 0 and are never drawn; a text with fewer words than a
run's length has shorter runs only; equal rows have equal scores, and each is a row of its own in the order;
a null id hashes as an empty string and comes first among equal scores; texts of any length are scanned
whole; an empty target leaves only the documents' shares to count; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import portions

#: Words of a run at most, buckets, percent drawn, least words of a drawn document, seed of the noise.
RUN, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, "2024"
#: A-Z to a-z, a-z, 0-9 and all beyond ASCII stay, and the rest separates words.
_WORD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def run_crcs(text: str | None, run: int = RUN) -> list[int]:
    """The CRC of every run of 1 to ``run`` words, in one scan."""
    words = (text or "").encode("utf-8", "replace").translate(_WORD).split()
    if run == 1:  # the ring is the word's own state
        return list(map(crc32, words))
    ring: list[int] = []
    out: list[int] = []
    for word in words:
        longer = b" " + word
        ring = [crc32(longer, state) for state in ring[-(run - 1) :]]
        ring.append(crc32(word))
        out += ring
    return out


def run_buckets(df: DataFrame, run: int = RUN, buckets: int = BUCKETS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, bucket, n) of each row: its buckets and how many runs fall in each."""

    def each(batches):
        for batch in batches:
            for part in portions(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), 3_000_000):
                rows = batch.slice(part.start, part.stop - part.start)
                sizes, own, n = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for t in rows.column("text").to_pylist():
                    crcs = run_crcs(t, run)
                    found = np.unique(np.array(crcs, np.int64) % buckets, return_counts=True)
                    sizes.append((_words_of(len(crcs), run), len(crcs), len(found[0])))
                    own.append(found[0])
                    n.append(found[1])
                words, features, distinct = np.array(sizes, np.int64).reshape(-1, 3).T
                ends = pa.array(np.r_[0, np.cumsum(distinct)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (own, n)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(words), pa.array(features), *lists], names=["doc_id", "n_words", "n_features", "bucket", "n"])

    schema = "doc_id long, n_words long, n_features long, bucket array<int>, n array<int>"
    return df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, schema)


def _words_of(features: int, run: int) -> int:
    """How many words give so many runs: n words give n + (n - 1) + ... of ``run`` terms at most."""
    short = run * (run + 1) // 2
    if features >= short:
        return (features + run * (run - 1) // 2) // run
    return (math.isqrt(8 * features + 1) - 1) // 2


def bucket_counts(made: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs fall in each bucket, over all rows; ``buckets`` numbers, whatever the data."""

    def each(batches):
        table = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(table, batch.column("bucket").flatten().to_numpy(), batch.column("n").flatten().to_numpy())
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["bucket", "n"])

    found = made.select("bucket", "n").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's smoothed share in the target over that in the documents, rounded down."""
    all_documents, all_target, buckets = int(documents.sum()), int(target.sum()), len(documents)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_documents + buckets) / ((s + 1) * (all_target + buckets)))) for s, t in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc: int | None, seed: str = SEED) -> int:
    """Noise by a hash of the id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(df: DataFrame, order: list, to: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 1, in an order of all rows, without a task that holds them all."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked")  # numbered once
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))  # a row a part
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(to, F.col("__before") + place + 1).drop("__part", "__at", "__before")


def resample(df: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: str = SEED, id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; ``rank`` from 1 for the drawn ones, null for others.

    Of the rows with at least ``least`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    made = materialise(run_buckets(df, run, buckets, id, text), "buckets")
    wanted = run_buckets(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), run, buckets)
    gains = bucket_gains(bucket_counts(made, buckets), bucket_counts(wanted, buckets))

    def each(batches):
        for batch in batches:
            own, n = batch.column("bucket"), batch.column("n")
            sums = np.r_[0, np.cumsum(gains[own.flatten().to_numpy()] * n.flatten().to_numpy())]
            ends = np.r_[0, np.cumsum(pc.list_value_length(own).to_numpy())]
            weight = sums[ends[1:]] - sums[ends[:-1]]
            noise = np.array([gumbel(d, seed) for d in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight), pa.array(weight + noise)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    scored = made.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long, score long").withColumn("asked", F.col("n_words") >= least)
    order = [F.desc("asked"), F.desc("score"), F.asc("doc_id"), F.desc("n_features")]
    placed = ranked(scored, order)
    drawn = made.agg(F.count_if(F.col("n_words") >= least)).first()[0] * percent // 100  # one row
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("asked") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
