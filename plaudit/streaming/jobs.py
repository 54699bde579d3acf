"""Structured Streaming jobs (2-L). Each reuses the batch operators.

* ``stream_ingest``: file source -> foreachBatch dedupe + append by the table's id
  index (a micro-batch reads only the buckets that it may meet, and one that runs
  again adds neither rows nor rejects; the checkpoint folder replaces the original's
  cursor file).
* ``stream_dedupe``: duplicate removal over all time, or within a watermark.
* ``stream_daily_trend`` / ``stream_rolling_rate``: event-time windows with a
  watermark; results are upserted per window through foreachBatch.
* ``stream_alerts``: daily counts kept as state, changed days evaluated with the batch
  alert rules; every evaluated day goes to the history table, by batch, and to an
  optional handler.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plaudit import lexicons as L
from plaudit.operators import alerts as al
from plaudit.sources import ingest
from plaudit.streaming import daycounts


def with_event_time(df: DataFrame, ts_col: str = "timestamp_created") -> DataFrame:
    return df.withColumn("event_ts", F.timestamp_seconds(F.col(ts_col)))


def stream_ingest(spark: SparkSession, source: str, table_path: str, checkpoint: str,
                  schema: T.StructType, fmt: str = "json", available_now: bool = True,
                  processing_time: str | None = None,
                  transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Incrementally load landed files into the deduplicated review table."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    stream = reader.load(source)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        b = transform(batch) if transform else batch
        ingest.append_batch(b.sparkSession, b, table_path, batch_id)

    w = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, on disk and not on the heap (a
    query takes the settings of its start); the session's setting comes back after."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def stream_dedupe(df: DataFrame, watermark: str | None = None, key: str = "recommendation_id") -> DataFrame:
    """Drop repeats of an id, however far apart they come: the ids seen are the state (start
    such a query under ``rocksdb_state``). With a ``watermark`` ids are forgotten after that delay, and later repeats pass."""
    if watermark is None:
        return df.dropDuplicates([key])
    return with_event_time(df).withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark([key])


def stream_daily_trend(df: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Per app and day: total and positive reviews."""
    d = with_event_time(df).withWatermark("event_ts", watermark)
    g = d.groupBy(F.window("event_ts", "1 day").alias("w"), "app_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum("voted_up").cast("long").alias("positive"))
    return g.select("app_id", F.col("w.start").cast("date").alias("date"), "total", "positive")


def stream_rolling_rate(df: DataFrame, watermark: str = "1 day") -> DataFrame:
    """7-day windows sliding by a day: reviews and positive rate per app."""
    d = with_event_time(df).withWatermark("event_ts", watermark)
    g = d.groupBy(F.window("event_ts", "7 days", "1 day").alias("w"), "app_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum("voted_up").cast("long").alias("positive"))
    return g.select("app_id", F.col("w.start").cast("date").alias("window_start"),
                    F.col("w.end").cast("date").alias("window_end"), "total", "positive",
                    (F.col("positive") / F.col("total")).alias("positive_rate"))


def upsert_sink(agg: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write an update-mode aggregation as an append-only change log (one row per
    changed key and batch); ``read_upserts`` returns the latest row per key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(batch.withColumn("_batch", F.lit(batch_id).cast("long")), path, batch_id)

    w = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    log = spark.read.parquet(path)
    vals = [c for c in log.columns if c not in keys and c not in ("_batch", "batch_id")]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch").alias("v"))
    return latest.select(*keys, "v.*")


def late_rows_dropped(query: StreamingQuery) -> int:
    """Rows that a finished query's state operators dropped as late."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress
               for op in p["stateOperators"])


def run_to_end(query: StreamingQuery) -> StreamingQuery:
    """Wait for an available-now query; totals that miss late rows are an error."""
    query.awaitTermination()
    dropped = late_rows_dropped(query)
    if dropped:
        raise RuntimeError(f"{dropped} rows came later than the watermark allows; use a longer one")
    return query


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch's folder; a replayed batch replaces its own rows."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def stream_alerts(df: DataFrame, history_path: str, checkpoint: str, rules=L.DEFAULT_ALERT_RULES,
                  handler: Callable[[DataFrame, int], None] | None = None, lookback: int = 7,
                  processing_time: str | None = None) -> StreamingQuery:
    """Daily stats per app as state (``daycounts``); each micro-batch evaluates the days
    that it changes, over a calendar without gaps, as ``alert_stats`` does for a table.
    Every evaluated (app, day) is recorded with the alerts it has now (none, too), so
    ``read_stream_alerts`` gives the state after the last batch and a replayed batch
    changes nothing. The record is only written; no batch reads an earlier one.
    ``handler`` gets the batch's alerts as a frame, to deliver them where it likes."""
    def check(batch: DataFrame, batch_id: int) -> None:
        day = ["app_id", "bucket"]
        # state is not read twice: the changed days are written, their alerts follow from that
        _replace_batch(batch, history_path.rstrip("/") + "_days", batch_id)
        stats = batch.sparkSession.read.schema(batch.schema).parquet(
            f"{history_path.rstrip('/')}_days/batch_id={batch_id}")
        alerts = al.evaluate_alerts(stats, rules).groupBy(*day).agg(
            F.collect_list(F.struct("rule", "condition", "message", "total", "positive", "recent_negative",
                                    "avg_negative")).alias("alerts"))
        _replace_batch(stats.select(*day).join(alerts, day, "left").withColumn("alerted_at", F.current_timestamp()),
                       history_path, batch_id)
        if handler is not None:
            done = batch.sparkSession.read.parquet(f"{history_path.rstrip('/')}/batch_id={batch_id}")
            handler(done.select(*day, F.explode("alerts").alias("a")).select(*day, "a.*"), batch_id)

    spark = df.sparkSession
    w = daycounts.changed_days(df, lookback).writeStream.outputMode("update").foreachBatch(check) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    with rocksdb_state(spark):
        return w.start()


def read_stream_alerts(spark: SparkSession, history_path: str) -> DataFrame:
    """The alerts that hold after the last batch: of each (app, day) those of its
    latest evaluation."""
    log = spark.read.parquet(history_path)
    latest = log.groupBy("app_id", "bucket").agg(
        F.max_by(F.struct("alerts", "alerted_at"), "batch_id").alias("v"))
    return latest.select("app_id", "bucket", F.explode("v.alerts").alias("a"), "v.alerted_at") \
        .select("app_id", "bucket", "a.*", "alerted_at")
