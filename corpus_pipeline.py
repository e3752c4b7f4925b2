"""A corpus from raw documents to token ids, in five stages.

1. toxicity: documents predicted toxic go.
2. near_duplicates: of each group linked by a Jaccard similarity of 0.8 or more of
   their five-word shingles, found by SimHash, the document of smallest id stays.
3. secrets: secrets found in the texts are replaced by a mark.
4. mix: every source comes near its target; documents repeat or go as the rates say.
5. encode: the texts become piece ids with seeded merge-dropout, each copy with draws of its own.

Each function takes (spark, docs, sf_dir).  All stages but the last return the
columns of ``documents``; each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import mixing, pieces, secrets, simhash, toxicity
from terraloom.llm.common import scratch_path, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first_similar(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_copies(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: SQL expresses neither the learned lexicon nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is kept as a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
