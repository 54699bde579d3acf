"""Index of stored review ids: hash buckets with a Bloom filter each.

Ids lie in ``<path>/ids/batch_id=<n>/bucket=<b>``, the filters' set words in
``<path>/bloom/batch_id=<n>/bucket=<b>`` as rows (word, mask). A batch first meets the
filters of its own buckets; an id is a candidate if all its bits are set there, and only
buckets with a candidate are read from ``ids``. So a batch of new ids reads next to no
stored id, whatever the table holds; the filters say nothing false about absence, so no
stored id is missed. All of it is grouped sums and joins on (bucket, word) or id; the
driver sees bucket numbers alone.

A batch writes its own folders and replaces them when it runs again. ``state`` tells a
batch that began and did not finish: its rows may be in the table without being in the
index, and the caller has to compare with the table itself.

Sizes: ``buckets`` folders a batch, ``bits`` per bucket and four probes an id (at 2^20 bits
and 256 buckets one id in a thousand is a false candidate at 30 million ids). Null ids are
not indexed. An index keeps the sizes that it was made with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.session import path_exists

PROBES = 4


class IdIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, bits: int = 1 << 20):
        self.spark, self.path, self.buckets, self.bits = spark, path.rstrip("/"), buckets, bits

    def _bucketed(self, ids: DataFrame) -> DataFrame:
        """Distinct non-null ids with their bucket; ``ids`` has one column."""
        d = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id is not null").distinct()
        return d.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))

    def _probes(self, ids: DataFrame) -> DataFrame:
        """(id, bucket, word, mask) of each bit that an id sets."""
        bit = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(self.bits)) for k in range(PROBES)]))
        return ids.select("id", "bucket", bit.alias("bit")).select(
            "id", "bucket", F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, int(bit % 64))").alias("mask"))

    def _read(self, kind: str, schema: str, buckets: Sequence[int]) -> DataFrame | None:
        at = f"{self.path}/{kind}"
        if not path_exists(self.spark, f"{at}/batch_id=*/bucket=*"):
            return None
        return self.spark.read.schema(f"{schema}, batch_id long, bucket int").parquet(at) \
            .where(F.col("bucket").isin(list(buckets)))

    def candidate_buckets(self, ids: DataFrame) -> list[int]:
        """Buckets in which some id of the batch may be stored, by the filters."""
        mine = self._bucketed(ids)
        hit = [r[0] for r in mine.select("bucket").distinct().collect()]
        bloom = self._read("bloom", "word long, mask long", hit)
        if bloom is None:
            return []
        words = bloom.groupBy("bucket", "word").agg(F.bit_or("mask").alias("stored"))
        found = self._probes(mine).join(words, ["bucket", "word"]).where(
            F.col("stored").bitwiseAND(F.col("mask")) == F.col("mask"))
        # two probes of an id may fall on the same bit: each counts, as each did in the making
        full = found.groupBy("bucket", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == PROBES)
        return sorted(r[0] for r in full.select("bucket").distinct().collect())

    def stored(self, ids: DataFrame) -> DataFrame:
        """``recommendation_id`` of the stored ids in the buckets that the batch may meet;
        no other bucket is read."""
        found = self._read("ids", "id string", self.candidate_buckets(ids))
        if found is None:
            return self.spark.createDataFrame([], "recommendation_id string")
        return found.select(F.col("id").alias("recommendation_id")).distinct()

    def empty(self) -> bool:
        return not path_exists(self.spark, f"{self.path}/ids/batch_id=*")

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """Index a batch's ids; a batch that runs again replaces its entries."""
        mine = self._bucketed(ids)
        words = self._probes(mine).groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask"))
        for kind, rows in (("ids", mine.repartition("bucket")), ("bloom", words.repartition("bucket"))):
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/batch_id={batch_id}")

    def state(self, batch_id: int) -> str:
        """'new', 'begun' or 'done'."""
        return next((s for s in ("done", "begun") if path_exists(self.spark, f"{self.path}/{s}/{batch_id}")), "new")

    def mark(self, batch_id: int, state: str) -> None:
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/{state}/{batch_id}")
