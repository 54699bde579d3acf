"""The ``reviews`` view over the driver's test tables.

The analyser works on store reviews; the test tables are documents, events and
labels. This view maps them onto the review schema so that every operator runs
on tables that grow with the scale factor. The same mapping is written as a SQL
CTE (``REVIEWS_CTE_SQL``) for the independent DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, typed like the canonical review table."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value", "props")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc_id"), "quality")
    # documents and events are both fact-sized: equi-join on the id and let AQE
    # pick broadcast only when the runtime size is under the configured threshold
    j = (d.join(e, d.doc_id == e.event_id, "inner")
          .join(lab, d.doc_id == lab.l_doc_id, "left"))
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    return j.select(
        F.col("doc_id").cast("string").alias("recommendation_id"),
        F.col("source").alias("app_id"),
        F.col("lang").alias("language"),
        F.col("text").alias("review"),
        ts.alias("timestamp_created"),
        F.when(F.col("quality").isNotNull(), F.col("quality"))
         .when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("voted_up"),
        (F.col("value") * 60).alias("author_playtime_forever"),
        F.col("user_id").cast("string").alias("author_steam_id"),
        (k % 20).alias("votes_up"),
        (k % 7).alias("votes_funny"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("written_during_early_access"),
        (k % 11).alias("helpful_count"),
        (k % 13 + 1).alias("author_num_reviews"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("primarily_steam_deck"),
        ((k % 21 - 10) / 10.0).alias("sentiment_score"),
        F.when(k % 5 == 0, F.lit("fr")).otherwise(F.col("lang")).alias("detected_language"),
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense review stream from ``events`` alone (about 333 rows a day at sf0.01):
    app = 'app' || user_id % 20, positive unless the event is an error."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("recommendation_id"),
        F.concat(F.lit("app"), (F.col("user_id") % 20).cast("string")).alias("app_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp_created"),
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("voted_up"),
        F.col("value").alias("sentiment_value"),
    )


REVIEWS_CTE_SQL = """reviews AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS recommendation_id,
         d.source AS app_id,
         d.lang AS language,
         d.text AS review,
         CAST(epoch_us(e.ts) // 1000000 AS BIGINT) AS timestamp_created,
         CAST(CASE WHEN l.quality IS NOT NULL THEN l.quality
                   WHEN d.doc_id % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS voted_up,
         e.value * 60 AS author_playtime_forever,
         CAST(e.user_id AS VARCHAR) AS author_steam_id,
         CAST(json_extract(e.props, '$.k') AS INTEGER) % 20 AS votes_up,
         CAST(json_extract(e.props, '$.k') AS INTEGER) % 7 AS votes_funny,
         CASE WHEN e.event_type = 'signup' THEN 1 ELSE 0 END AS written_during_early_access,
         CAST(json_extract(e.props, '$.k') AS INTEGER) % 11 AS helpful_count,
         CAST(json_extract(e.props, '$.k') AS INTEGER) % 13 + 1 AS author_num_reviews,
         CASE WHEN e.event_type = 'view' THEN 1 ELSE 0 END AS primarily_steam_deck,
         (CAST(json_extract(e.props, '$.k') AS INTEGER) % 21 - 10) / 10.0 AS sentiment_score,
         CASE WHEN CAST(json_extract(e.props, '$.k') AS INTEGER) % 5 = 0 THEN 'fr' ELSE d.lang END AS detected_language
  FROM documents d
  JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

REVIEW_EVENTS_CTE_SQL = """review_events AS (
  SELECT CAST(event_id AS VARCHAR) AS recommendation_id,
         'app' || CAST(user_id % 20 AS VARCHAR) AS app_id,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp_created,
         CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS voted_up,
         value AS sentiment_value
  FROM events
)"""
