"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.llm import (bm25_packing, chat_format, decontaminate, hmm_lm, license_diagonals, lsh_forest,
                         pivot_index, secret_forest, source_divergence, token_alignment, toxicity, trie_tokens, weak_quality)
from plaudit.llm.common import id_bucket, read_table

QUERIES: dict = {}
#: those that one SQL statement can express; see tests/llm for brute-force versions
#: of the others
ORACLE: dict[str, str] = {
    "op11_source_divergence": source_divergence.divergence_sql(),
    "op12_license_diagonals": license_diagonals.report_sql(),
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov language model over all documents; held out: crc32 mod 7 = 2."""
    return hmm_lm.score_texts(read_table(spark, sf_dir, "documents"), id_bucket("doc_id", 7) == 2)


@query
def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids; a row per piece."""
    pieces = bm25_packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               added=public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels with crc32 mod 5 = 0 are held out."""
    docs, held = read_table(spark, sf_dir, "documents"), id_bucket("doc_id", 5) == 0
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), held), held)


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds (edit distance up to a fifth)."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings only, read back from the output."""
    text = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    odd = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
                                F.col("id").cast(kinds["turn"]).alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(text).alias("text"))
    return chat_format.digests(chat_format.format_conversations(
        rows.unionByName(odd), public_tokenizers.path("byte_bpe_50k.json")))


@query
def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents from weak labels alone."""
    return weak_quality.quality(read_table(spark, sf_dir, "documents"))


@query
def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate string of all documents with the forest's verdict."""
    found = secret_forest.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", F.length("value").cast("long").alias("length"),
                        F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query
def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents at 0.85 on 3-word shingles."""
    return lsh_forest.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


@query
def op9_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return trie_tokens.token_counts(read_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near vectors of one label at cosine 0.93 over all embeddings."""
    return pivot_index.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the sources of each language are, and the terms that mark them."""
    return source_divergence.divergence(read_table(spark, sf_dir, "documents"))


@query
def op12_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, notices and their places in all documents."""
    return license_diagonals.license_report(read_table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens that two tokenizers cut alike, of all documents."""
    return token_alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))
