"""Small helpers shared by the operators: scratch tables, splits, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame under the shared folder and read it back. Cuts the lineage and
    makes anything that depends on task order (ids given in a task) stable, also
    when an executor is lost later."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def hashed_sample(df: DataFrame, key, n: int, total: int) -> DataFrame:
    """About ``n`` rows of ``total``, never more: those whose hash ``key`` is in the
    first part of its range. The same rows every time, whatever the number of tasks,
    and no task sends more than its share."""
    if total <= n:
        return df
    return df.where(F.pmod(key, F.lit(1 << 32)) < int(0.95 * n / total * (1 << 32))).limit(n)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (long ids, null ends ignored) as
    ``(node, component_id)`` with the smallest id of each component.

    Alternates large-star and small-star steps, each one shuffle on the larger and
    one on the smaller end, until an iteration changes nothing; the number of
    rounds grows with the logarithm of the longest path. Every round is written to
    the shared folder, so its lineage is one scan. A star of any size stays a set
    of (member, centre) rows and the minimum of a node's neighbours is a partially
    aggregated ``min``, so no node's neighbours are ever gathered in one task."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .where("u is not null and v is not null and u <> v").distinct(), "cc")
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small-star: a node's smaller neighbours and the node itself join the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        e = written(small, "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")) \
                .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component_id"))) \
                .distinct()
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
