"""Ingest by id index: what a batch reads, replays and broken-off batches."""

from pyspark.sql import functions as F

from plaudit.sources import ingest
from plaudit.sources.idindex import IdIndex


def frame(spark, ids):
    rows = [(None if i is None else str(i), "a" if (i or 0) % 2 else "b", f"text {i}", 1000 + (i or 0)) for i in ids]
    return spark.createDataFrame(rows, "recommendation_id string, app_id string, review string, timestamp_created long")


def test_a_batch_reads_only_the_buckets_it_meets(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "x"), buckets=16, bits=1 << 12)
    ids = spark.range(400).select(F.col("id").cast("string"))
    for n in range(2):
        index.add(ids.where(f"id % 2 = {n}"), n)
    known = {r["id"]: r["bucket"] for r in index._bucketed(ids).collect()}
    some = spark.createDataFrame([("7",), ("new-1",), ("new-2",)], "id string")
    hit = index.candidate_buckets(some)
    assert known["7"] in hit and len(hit) <= 3  # of all buckets, those of the batch at most
    new = spark.createDataFrame([(f"unseen-{k}",) for k in range(50)], "id string")
    assert len(index.candidate_buckets(new)) <= 2  # 400 ids in 16 filters of 4,096 bits: few false candidates
    read = index._read("ids", "id string", hit)
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert files and all(any(f"bucket={b}/" in f for b in hit) for f in files)
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString() or \
        "PartitionFilters: [bucket" in read._jdf.queryExecution().toString()
    got = {r[0] for r in index.stored(some).collect()}
    assert "7" in got and "new-1" not in got
    assert all(known[i] in hit for i in got)


def test_every_stored_id_is_found(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "x"), buckets=4, bits=256)  # filters fill up: more read, none missed
    ids = spark.range(500).select(F.concat(F.lit("é"), "id").alias("id"))
    index.add(ids, 0)
    assert index.stored(ids).join(ids.withColumnRenamed("id", "recommendation_id"), "recommendation_id").count() == 500
    assert IdIndex(spark, str(tmp_path / "none")).stored(ids).count() == 0


def test_batches_replays_and_rejects(spark, tmp_path):
    path = str(tmp_path / "t")
    read = lambda: sorted(int(r[0]) for r in spark.read.parquet(path).select("recommendation_id").collect())
    rejects = lambda: spark.read.json(path + "_rejects").count()
    first, second = frame(spark, [1, 2, 2, None, 3]), frame(spark, [3, 4, None, None, 1])
    assert ingest.append_batch(spark, first, path, 0) == {"inserted": 3, "rejected": 1}
    assert ingest.append_batch(spark, second, path, 1) == {"inserted": 1, "rejected": 2}
    assert read() == [1, 2, 3, 4] and rejects() == 3
    for n, batch in enumerate((first, second)):  # finished batches run again
        assert ingest.append_batch(spark, batch, path, n) == {"inserted": 0, "rejected": 0}
    index = IdIndex(spark, path + "_ids")
    index.mark(2, "begun")  # a batch that wrote rows and broke off before its index
    ingest.append_report(spark.read.parquet(path), frame(spark, [5]), path, str(tmp_path / "other"))
    assert ingest.append_batch(spark, frame(spark, [5, 6, None]), path, 2) == {"inserted": 1, "rejected": 1}
    assert read() == [1, 2, 3, 4, 5, 6] and rejects() == 4
    assert ingest.append_batch(spark, frame(spark, [6, 5, 7]), path, 3) == {"inserted": 1, "rejected": 0}


def test_a_table_without_index_gets_one(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.append_new(None, frame(spark, [1, 2]), path)
    assert ingest.append_batch(spark, frame(spark, [2, 3]), path, 0)["inserted"] == 1
    assert ingest.append_batch(spark, frame(spark, []), path, 1) == {"inserted": 0, "rejected": 0}
