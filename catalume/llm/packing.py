"""Best-fit packing of tokenised documents, planned on the histogram of lengths.

Documents become ids with an end id; longer ones than a sequence are cut from the end into whole
sequences, so only the first piece is shorter. Only the counts of the lengths (at most ``capacity``
numbers) go to the driver. It plans best-fit decreasing over counts: the longest length first, each run
of equal pieces goes to the fullest open sequences that hold it, as many at a time as fit, and to new
sequences when none does. The plan is a bounded list of runs: pieces of this length and these ranks go
to these sequences at this offset. Pieces are then ranked within their length and joined with the runs.
The rank is by hash buckets within the length, so a length that many documents share is no single task;
the buckets grow with the largest length's count.

Edge cases: a null text is empty and becomes the end id alone; a null id is kept; repeated rows are
packed as often as they occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encode_series

CAPACITY, END_ID = 1024, 2
#: Within a length, pieces are ranked in this many buckets, or as many as leave about ``BUCKET_ROWS`` pieces to each.
BUCKETS, BUCKET_ROWS = 256, 200_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def cut_documents(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece; with ``ids`` (little-endian unsigned 32-bit) if asked."""

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encode_series(batch["text"], tokenizer, "<u4"), strict=True):
                ids += end_id.to_bytes(4, "little")
                for i, (start, n) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, i, start, n, zlib.crc32(part), part)[: 5 + with_ids])
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, PIECE + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first sequence, pieces a sequence, offset), ranks from 0.

    A run puts the pieces of its length by rank into consecutive sequences, so many in each, from the
    offset on. Work and size depend on the capacity, not on the counts.
    """
    runs, sequences = [], 0
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    rooms: list[int] = []

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, first = capacity, sequences
                many = -(-left // (capacity // length))
                sequences += many
            each = room // length
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            for start, n, pieces in ((first, full, each), (first + full, 1, rest)):
                if n and pieces:
                    runs.append((length, rank, rank + n * pieces - 1, start, pieces, capacity - room))
                    put(room - pieces * length, start, n)
                    rank += n * pieces
                    left -= n * pieces
            used = full + (1 if rest else 0)
            put(room, first + used, many - used)
    return runs


RUN = "length long, first_rank long, last_rank long, first_sequence long, each long, from_offset long"


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. They are read three times: hand in a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(counts, capacity), RUN)
    buckets = max(BUCKETS, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    of = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(of), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("rank", F.row_number().over(within) - 1)
    # the ranks before a bucket are joined where the bucket is; the plan's runs are bounded by the capacity alone
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    r, at = F.broadcast(runs.withColumnRenamed("length", "run_length")), F.col("rank") - F.col("first_rank")
    placed = ranked.join(r, (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("from_offset") + F.col("length") * (at % F.col("each"))).cast("long").alias("offset"),
    )


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where each piece of each document goes. The pieces (no ids) are written to the shared folder once."""
    return place(materialise(cut_documents(df, tokenizer, id, text, capacity, end_id), "pieces"), capacity)


def sequences(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int), doc_ids in order of place."""
    pieces = materialise(cut_documents(df, tokenizer, id, text, capacity, end_id, with_ids=True), "pieces")

    def joined(batches):
        for batch in batches:
            batch["ids"] = [np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").astype("int32") for ps in batch["parts"]]
            batch["doc_ids"] = [[p["doc_id"] for p in ps] for ps in batch["parts"]]
            yield batch[["sequence_id", "ids", "doc_ids"]]

    # a sequence holds at most `capacity` pieces
    parts = place(pieces, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.mapInPandas(joined, "sequence_id long, ids array<int>, doc_ids array<long>")
