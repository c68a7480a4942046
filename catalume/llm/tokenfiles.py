"""Token files: the ids of documents in order of their ids, range-coded in checksummed blocks.

A file set is a Parquet table in any store that Spark can write, so that Spark's committer sees to lost
tasks. Each row is a segment: whole consecutive documents with about ``SEGMENT`` ids together, coded by
``rangecoder`` in blocks that are reset and checksummed one by one, with the documents' ids and lengths
beside them. The rows' ``part`` and ``segment`` give the order.

Edge cases: a null text is empty and becomes the end id alone; null ids come first and stay null; equal
ids go by a hash of their text, and repeated rows are all written; an empty table gives an empty result;
a document may be longer than a segment.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rangecoder import pack_segment, unpack_segment
from .tokens import encode_series

END_ID = 2
SEGMENT = 4_000_000

_ROW = "part int, segment int, docs int, ids long, doc_ids binary, no_id binary, lengths binary, data binary"


def write_tokens(df: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encode every text, append the end id, and write the ids in ascending order of ``id``. Ids must be below 2**16."""
    end = end_id.to_bytes(2, "little")

    def segments(batches):
        from pyspark import TaskContext

        part, number, docs, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal number, docs, ids, size
            keys = pd.array(docs, "Int64")
            lengths = np.array([len(x) // 2 for x in ids], "<u4")
            data = pack_segment(np.frombuffer(b"".join(ids), "<u2"))
            row = (part, number, len(docs), int(lengths.sum(dtype=np.int64)), keys.fillna(0).to_numpy("<i8").tobytes(), np.packbits(keys.isna()).tobytes(), lengths.tobytes(), data)
            number, docs, ids, size = number + 1, [], [], 0
            return pd.DataFrame([row], columns=["part", "segment", "docs", "ids", "doc_ids", "no_id", "lengths", "data"])

        for batch in batches:
            for doc, x in zip(batch["doc_id"].astype("Int64"), encode_series(batch["text"], tokenizer, "<u2"), strict=True):
                docs.append(doc)
                ids.append(x + end)
                size += len(x) // 2 + 1
                if size >= segment:
                    yield flush()
        if docs:
            yield flush()

    docs = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInPandas(segments, _ROW).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in a file set; every block is verified."""

    def documents(batches):
        for batch in batches:
            for part, number, n, doc_ids, no_id, lengths, data in batch.itertuples(index=False):
                ids = unpack_segment(data).astype("<u4")
                lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                cut = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                keys = pd.array(np.frombuffer(doc_ids, "<i8").copy(), "Int64")
                keys[np.unpackbits(np.frombuffer(no_id, np.uint8), count=n).astype(bool)] = pd.NA
                out = pd.DataFrame({"part": np.int32(part), "segment": np.int32(number), "doc_id": keys, "at": ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(x) for x in cut]})
                yield out.assign(ids=cut) if with_ids else out

    files = spark.read.parquet(path)
    docs = files.select("part", "segment", "docs", "doc_ids", "no_id", "lengths", "data").mapInPandas(documents, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    # a row for each part, then a row for each segment: the ids before it
    of_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(of_part), F.lit(0)).alias("before_part"))
    of_segment = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    heads = files.select("part", "segment", "ids").join(parts, "part")
    heads = heads.select("part", "segment", (F.col("before_part") + F.coalesce(F.sum("ids").over(of_segment), F.lit(0))).alias("before"))
    out = docs.join(heads, ["part", "segment"])
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
