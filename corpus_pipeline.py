"""A corpus pipeline of five operators over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a frame that is written as Parquet and read again as the next one's docs. The
first four return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.llm import bm25_packing, decontaminate, lsh_forest, secret_forest, toxicity
from plaudit.llm.common import id_bucket, read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) == 0)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (the smallest id); five words, 0.8. Of rows
    equal in id and text one stays; rows without an id stay."""
    found = lsh_forest.near_duplicates(docs, percent=80, width=5)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return (docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
            .withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; strings that the forest takes for secrets are replaced."""
    return secret_forest.redact(docs, secret_forest.scan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 ids with their ids."""
    return bm25_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             added=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack)]

#: no SQL statement expresses these stages; tests/llm holds them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
