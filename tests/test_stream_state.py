import random

import pytest
from pyspark.sql import functions as F

from plaudit.operators import alerts as al
from plaudit.streaming import jobs

SCHEMA = "recommendation_id string, app_id string, timestamp_created long, voted_up int"
RULES = [("low", "positive_rate_below", 0.6, "{rate:.1f}"), ("spike", "negative_reviews_spike", 1.1, "{recent} {avg:.3f}"),
         ("few", "total_reviews_below", 2.0, "{total}")]


def staged(spark, path, parts):
    """One file per micro-batch, in the order of ``parts``."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part={k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_equal_the_batch_whatever_the_order(spark, tmp_path, seed):
    """Days with gaps, batches in random order: months pass between neighbours in arrival."""
    rng = random.Random(seed)
    rows = [(str(k), rng.choice("abc"), 1_700_000_000 + 86_400 * rng.choice([0, 1, 2, 5, 6, 11, 40, 41, 90])
             + rng.randrange(9_000), rng.randrange(2)) for k in range(240)]
    rows += [("none", "a", None, 1)]
    rng.shuffle(rows)
    stream = staged(spark, str(tmp_path / "src"), [rows[k:k + 49] for k in range(0, len(rows), 49)])
    out = str(tmp_path / "out")
    jobs.run_to_end(jobs.stream_alerts(stream, out, str(tmp_path / "ck"), RULES))
    cols = ["app_id", "bucket", "rule", "message"]
    got = sorted(tuple(r) for r in jobs.read_stream_alerts(spark, out).select(*cols).collect())
    whole = spark.createDataFrame(rows, SCHEMA).where("timestamp_created is not null")
    want = al.evaluate_alerts(al.alert_stats(whole, "D", 7), RULES).withColumn("bucket", F.col("bucket").cast("date"))
    assert got == sorted(tuple(r) for r in want.select(*cols).collect())


def test_repeats_of_years_ago_are_dropped(spark, tmp_path):
    old, new = ("1", "a", 1_500_000_000, 1), ("2", "a", 1_700_000_000, 1)
    stream = staged(spark, str(tmp_path / "src"), [[old], [new], [("1", "a", 1_700_000_100, 0), ("3", "a", 1, 1)]])
    with jobs.rocksdb_state(spark):
        query = (jobs.stream_dedupe(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    jobs.run_to_end(query)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["recommendation_id"] for r in got) == ["1", "2", "3"]
