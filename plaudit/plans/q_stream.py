"""Registered streaming queries (2-L): each runs a Structured Streaming job over
the events table to completion (availableNow) and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plaudit.operators import alerts as al
from plaudit.plans.q_analytics import ALERT_STATS
from plaudit.plans.registry import register, rnd
from plaudit.session import scratch_path
from plaudit.sources import io
from plaudit.sources.fixtures import REVIEW_EVENTS_CTE_SQL, REVIEWS_CTE_SQL, review_events, reviews
from plaudit.streaming import jobs

E = f"WITH {REVIEW_EVENTS_CTE_SQL}"
R = f"WITH {REVIEWS_CTE_SQL}"
DAY = "CAST(to_timestamp(timestamp_created) AT TIME ZONE 'UTC' AS DATE)"


FILE_ROWS = 10_000


def _dirs(spark, name):
    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/out", f"{base}/ckpt", f"{base}/src"


def disorder(rows) -> str:
    """A watermark delay that covers the whole time span of staged rows: their files
    are not in time order, and a row that came later than the delay would be dropped
    (``run_to_end`` fails then)."""
    lo, hi = rows.agg(F.min("timestamp_created"), F.max("timestamp_created")).first()
    return f"{(hi or 0) - (lo or 0) + 86_400} seconds"


def _events_stream(spark, sf, src_dir):
    """Stage the derived review events as files (several per day) and open them as a
    file stream; returns the stream and the delay it needs."""
    ev = review_events(spark, sf).withColumn("day", F.to_date(F.timestamp_seconds("timestamp_created")))
    ev.repartition(8, "day").write.mode("overwrite").parquet(src_dir)
    staged = spark.read.parquet(src_dir)
    return (spark.readStream.schema(staged.schema).option("maxFilesPerTrigger", 2).parquet(src_dir),
            disorder(staged))


@register("stream_daily_trend", f"""{E}
SELECT app_id, {DAY} AS date, count(*) AS total, CAST(sum(voted_up) AS BIGINT) AS positive
FROM review_events GROUP BY ALL""")
def q_stream_daily_trend(spark, sf):
    out, ck, src = _dirs(spark, "daily")
    jobs.run_to_end(jobs.upsert_sink(jobs.stream_daily_trend(*_events_stream(spark, sf, src)), out, ck))
    return jobs.read_upserts(spark, out, ["app_id", "date"])


@register("stream_rolling_rate", rnd(f"""{E},
days AS (SELECT DISTINCT {DAY} AS d FROM review_events),
w AS (SELECT d - 6 + CAST(k AS INTEGER) AS window_start FROM days, range(0, 7) t(k))
SELECT app_id, CAST(w.window_start AS DATE) AS window_start, CAST(w.window_start + 7 AS DATE) AS window_end,
       count(*) AS total, CAST(sum(voted_up) AS BIGINT) AS positive, sum(voted_up) / count(*) AS positive_rate
FROM (SELECT DISTINCT window_start FROM w) w JOIN review_events e
  ON {DAY.replace('timestamp_created', 'e.timestamp_created')} >= w.window_start
 AND {DAY.replace('timestamp_created', 'e.timestamp_created')} < w.window_start + 7
GROUP BY app_id, w.window_start""", ["positive_rate"]))
def q_stream_rolling_rate(spark, sf):
    out, ck, src = _dirs(spark, "rolling")
    jobs.run_to_end(jobs.upsert_sink(jobs.stream_rolling_rate(*_events_stream(spark, sf, src)), out, ck))
    return jobs.read_upserts(spark, out, ["app_id", "window_start", "window_end"])


@register("stream_dedupe", f"""{E} SELECT DISTINCT recommendation_id FROM review_events""")
def q_stream_dedupe(spark, sf):
    """Every event arrives twice, at any distance; one of each stays."""
    out, ck, src = _dirs(spark, "dedupe")
    ev = review_events(spark, sf)
    ev.unionByName(ev).repartition(8).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(src)
    with jobs.rocksdb_state(spark):
        query = (jobs.stream_dedupe(stream).writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", ck).trigger(availableNow=True).start())
    jobs.run_to_end(query)
    return spark.read.parquet(out).select("recommendation_id")


@register("stream_ingest", f"""{R} SELECT recommendation_id, app_id, timestamp_created FROM reviews""")
def q_stream_ingest(spark, sf):
    """Landed CSV files (each review twice, in different files) streamed into the
    deduplicated table through foreachBatch."""
    out, ck, src = _dirs(spark, "ingest")
    rv = reviews(spark, sf)
    # one task reads a whole file, as lines may end inside quotes: there are more files, not larger ones
    both = rv.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy"))
    (both.repartition(F.xxhash64("recommendation_id", "_copy")).drop("_copy").write.option("header", True)
       .option("escape", '"').option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").csv(src))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in rv.columns])
    q = jobs.stream_ingest(spark, src, out, ck, schema, fmt="csv")
    q.awaitTermination()
    return io.read_reviews_table(spark, out).select("recommendation_id", "app_id", "timestamp_created")


RULES = [("low_rating", "positive_rate_below", 0.8, "Rate {rate:.1f}% is under 80%"),
         ("negative_spike", "negative_reviews_spike", 1.2, "{recent} negative reviews, {avg:.1f} before")]


@register("stream_alerts", f"""{E}, {ALERT_STATS}
SELECT app_id, bucket, 'low_rating' AS rule,
       printf('Rate %.1f%% is under 80%%', round(positive / total * 100, 1)) AS message
FROM stats WHERE total > 0 AND positive / total < 0.8
UNION ALL
SELECT app_id, bucket, 'negative_spike',
       printf('%d negative reviews, %.1f before', recent_negative, round(coalesce(avg_negative, 1.0), 1))
FROM stats WHERE recent_negative > coalesce(avg_negative, 1.0) * 1.2""")
def q_stream_alerts(spark, sf):
    """The stream's alerts after its last batch equal those of the whole table."""
    out, ck, src = _dirs(spark, "alerts")
    stream, _ = _events_stream(spark, sf, src)
    jobs.run_to_end(jobs.stream_alerts(stream, out, ck, RULES))
    return jobs.read_stream_alerts(spark, out).select("app_id", "bucket", "rule", "message")


@register("alert_history", f"""{E}, {ALERT_STATS}
SELECT app_id, bucket, 'few' AS rule, printf('only %d reviews', total) AS message
FROM stats WHERE total < 20 ORDER BY bucket DESC, app_id LIMIT 100""")
def q_alert_history(spark, sf):
    """Alerts recorded day by day, the newest 100 read back."""
    out, _, _ = _dirs(spark, "history")
    rules = [("few", "total_reviews_below", 20.0, "only {total} reviews")]
    fired = al.evaluate_alerts(al.alert_stats(review_events(spark, sf), "D", 7), rules)
    al.record_alerts(fired, out, F.col("bucket").cast("timestamp"))
    return al.alert_history(spark.read.parquet(out)).select("app_id", "bucket", "rule", "message")
