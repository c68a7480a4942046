"""The corpus pipeline: quality, near-duplicates, privacy, packing.

Each stage takes all that its predecessor kept. Null and empty texts go through every stage (the
classifier decides whether they stay); of near-duplicates the document with the smallest id stays; spans
of personal data are replaced in the text, and n_chars follows it; what is left is packed.

Edge cases: a null id is a document like others, but stays of its class only if no other has an id; of
equal rows one stays, as they are near-duplicates; texts without words are one class; a text of any length
is taken whole; empty tables give an empty result (without labels every score is 0.5, and all stay);
columns beyond those of ``documents`` are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm import packing, privacy, quality, simhash
from catalume.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its probability of good quality is below this.
KEEP = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pool, network = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), pool, network, to="quality_score").where(F.col("quality_score") >= KEEP).drop("quality_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs.select(*COLUMNS))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return privacy.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("packing", pack_documents),
]

#: The classifier and the index are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
