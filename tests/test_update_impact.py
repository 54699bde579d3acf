import random

from pyspark.sql import functions as F

from plaudit.operators import versions

WEEK = 7 * 86_400


def plain(rows, w=WEEK):
    """Per (app, version): mentions, mean rates before and after, one mention at a time."""
    sides = {}
    for app, t, _, text in rows:
        for version in {x for x in text.split() if x[0].isdigit()}:
            before = [v for a, s, v, _ in rows if a == app and t - w <= s < t]
            after = [v for a, s, v, _ in rows if a == app and t < s <= t + w]
            sides.setdefault((app, version), []).append(
                [100 * sum(x) / len(x) if x else None for x in (before, after)])
    mean = lambda x: sum(x) / len(x) if x else None
    return {k: (len(v), mean([b for b, _ in v if b is not None]), mean([a for _, a in v if a is not None]))
            for k, v in sides.items()}


def test_equals_one_mention_at_a_time(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), 1_700_000_000 + rng.randrange(20) * 43_200 + rng.choice([0, 1, 3599, 3600]),
             rng.randrange(2), rng.choice(["fine", "fine", "1.2.3 broke it", "like 2.0.1 more"])) for _ in range(300)]
    df = spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)],
                               "recommendation_id string, app_id string, timestamp_created long, voted_up int, review string")
    got = {(r["app_id"], r["version"]): r for r in versions.update_impact(df).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for k, (n, before, after) in want.items():
        assert got[k]["mentions"] == n
        assert abs(got[k]["before_avg"] - before) < 1e-9 and abs(got[k]["after_avg"] - after) < 1e-9


def test_result_reads_sums_alone(spark, tmp_path):
    """The frame is read for its two sums; what follows reads those."""
    path = str(tmp_path / "r")
    spark.createDataFrame([("1", "a", 1_700_000_000, 1, "since 1.2.3"), ("2", None, None, 1, None)],
                          "recommendation_id string, app_id string, timestamp_created long, voted_up int, review string") \
        .write.parquet(path)
    out = versions.update_impact(spark.read.parquet(path))
    assert not any(f.startswith(f"file:{path}") or path in f for f in out.inputFiles())
    assert [(r["mentions"], r["before_avg"], r["impact"]) for r in out.collect()] == [(1, None, None)]


def test_patch_day_of_a_million_mentions(spark):
    """All mentions on one day of one app: no window partition holds more than a block."""
    n = 1_000_000
    df = spark.range(n).select(
        F.col("id").cast("string").alias("recommendation_id"), F.lit("a").alias("app_id"),
        (F.lit(1_700_006_400) + F.col("id") % 86_400).alias("timestamp_created"),
        (F.col("id") % 2).cast("int").alias("voted_up"), F.lit("1.2.3").alias("review"))
    out = versions.update_impact(df).collect()
    assert len(out) == 1 and out[0]["mentions"] == n and abs(out[0]["before_avg"] - 50) < 1
