"""Deduplicating ingest (2-A): existing ids, anti-join append, import summary,
type repair of raw rows, game-name dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from plaudit.session import path_exists
from plaudit.sources.idindex import IdIndex
from plaudit.sources.io import canonicalize_columns, project_to_schema

# --- FIXED VALUES: default game names of the original configuration ---
DEFAULT_GAME_NAMES = {"2897760": "Romantic Escapades", "2277560": "WUCHANG: Fallen Feathers",
                      "3363270": "Fischer's Fishing Journey"}


def existing_ids(df: DataFrame) -> DataFrame:
    """Distinct stored ids under either id column name."""
    idc = [F.col(c).cast("string") for c in ("recommendation_id", "recommendationid") if c in df.columns]
    return df.select(F.coalesce(*idc).alias("recommendation_id")).where(
        F.col("recommendation_id").isNotNull()).distinct()


def dedupe_batch(batch: DataFrame) -> DataFrame:
    """One row per id inside a batch, keeping the latest ``timestamp_updated`` (then
    ``timestamp_created``, then the smallest content hash, so that a re-run keeps the
    same row). Rows without an id are not part of it: see ``rows_without_id``."""
    order = [F.col(c).desc_nulls_last() for c in ("timestamp_updated", "timestamp_created")
             if c in batch.columns] + [F.xxhash64(*batch.columns)]
    w = Window.partitionBy("recommendation_id").orderBy(*order)
    return batch.where(F.col("recommendation_id").isNotNull()) \
        .withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rows_without_id(batch: DataFrame) -> DataFrame:
    """Every row of a batch that has no id, as it came (canonical column names): the
    rejects of an import, none folded into another."""
    return canonicalize_columns(batch).where(F.col("recommendation_id").isNull())


def new_rows(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Batch rows whose id is not stored yet (left anti join on the id), typed."""
    b = dedupe_batch(canonicalize_columns(batch))
    if existing is not None:
        b = b.join(existing_ids(existing), "recommendation_id", "left_anti")
    return project_to_schema(b).withColumn("scraped_at", F.current_timestamp())


def append_batch(spark: SparkSession, batch: DataFrame, path: str, batch_id: int, index: IdIndex | None = None,
                 rejects_path: str | None = None) -> dict[str, int]:
    """Append a numbered batch to the table at ``path``, new ids only, by the table's id
    index (default: ``path`` + ``_ids``): only buckets that the batch may meet are read.
    Rows without an id go to ``batch_id=<n>`` of the rejects. A batch that runs again adds
    neither rows nor rejects: one that finished is left alone, one that broke off is
    compared with the table itself. A table that has no index yet gets one (as batch -1);
    rows that ``append_new`` adds later are not in it. Returns the counts of inserted and
    rejected rows."""
    from plaudit.sources.io import read_reviews_table, write_reviews_table
    index = index or IdIndex(spark, path.rstrip("/") + "_ids")
    state = index.state(batch_id)
    if state == "done":
        return {"inserted": 0, "rejected": 0}
    if state == "new" and index.empty() and path_exists(spark, path):
        index.add(existing_ids(read_reviews_table(spark, path)), -1)
    index.mark(batch_id, "begun")
    unique = dedupe_batch(canonicalize_columns(batch))
    if state == "begun" and path_exists(spark, path):
        stored = existing_ids(read_reviews_table(spark, path))
    else:
        stored = index.stored(unique.select("recommendation_id"))
    rows = project_to_schema(unique.join(stored, "recommendation_id", "left_anti")) \
        .withColumn("scraped_at", F.current_timestamp())
    report, obs = {}, Observation("inserted")
    write_reviews_table(rows, path, "append", obs)
    report["inserted"] = int(obs.get.get("n") or 0)
    obs = Observation("rejected")
    rows_without_id(batch).observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(
        f"{(rejects_path or path.rstrip('/') + '_rejects').rstrip('/')}/batch_id={batch_id}")
    report["rejected"] = int(obs.get.get("n") or 0)
    index.add(unique.select("recommendation_id"), batch_id)
    index.mark(batch_id, "done")
    return report


def append_new(existing: DataFrame | None, batch: DataFrame, path: str,
               rejects_path: str | None = None) -> int:
    """Append only new reviews to the partitioned table at ``path``; rows without an
    id are appended to ``rejects_path`` (default: ``path`` + ``_rejects``). Returns the
    inserted count; ``append_report`` returns the rejected one too."""
    return append_report(existing, batch, path, rejects_path)["inserted"]


def append_report(existing: DataFrame | None, batch: DataFrame, path: str,
                  rejects_path: str | None = None) -> dict[str, int]:
    """``append_new`` with the counts of inserted and rejected rows, observed during
    the writes (no second pass)."""
    from plaudit.sources.io import write_reviews_table
    report = {}
    for name, rows in (("inserted", new_rows(existing, batch)), ("rejected", rows_without_id(batch))):
        obs = Observation(name)
        if name == "inserted":
            write_reviews_table(rows, path, "append", obs)
        else:
            rows.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append").option("mergeSchema", True).json(rejects_path or path.rstrip("/") + "_rejects")
        report[name] = int(obs.get.get("n") or 0)
    return report


def import_summary(batch: DataFrame, existing: DataFrame | None = None,
                   file_col: str = "file_name", corrupt: str | None = None) -> DataFrame:
    """Per source file: rows read, new rows, skipped (already stored / duplicate),
    rows without id (errors) and a status. Rows with a value in the column ``corrupt``
    are errors whatever their fields hold, and never count as a review's first row."""
    b = canonicalize_columns(batch)
    if corrupt is not None:
        b = b.withColumn("recommendation_id", F.when(F.col(corrupt).isNull(), F.col("recommendation_id")))
    ids = existing_ids(existing).withColumn("_stored", F.lit(1)) if existing is not None else None
    if ids is not None:
        b = b.join(ids, "recommendation_id", "left")
    else:
        b = b.withColumn("_stored", F.lit(None).cast("int"))
    # rows without an id have a partition each: they never gather in one task
    own = F.coalesce("recommendation_id", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    first = Window.partitionBy(own).orderBy(F.col(file_col))
    b = b.withColumn("_dup", F.when(F.col("recommendation_id").isNotNull(),
                                    F.row_number().over(first) > 1).otherwise(F.lit(False)))
    out = b.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("recommendation_id").isNull()).alias("errors"),
        F.count_if(F.col("recommendation_id").isNotNull() & F.col("_stored").isNull() & ~F.col("_dup"))
         .alias("imported"))
    out = out.withColumn("skipped", F.col("rows") - F.col("imported") - F.col("errors"))
    return out.withColumn("status", F.when(F.col("imported") > 0, "imported")
                          .when(F.col("errors") == F.col("rows"), "error").otherwise("skipped"))


def import_files(spark: SparkSession, directory: str, pattern: str = "*_reviews.csv",
                 existing: DataFrame | None = None, corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews, rejects, summary) of all review files of a folder. Broken records and
    records without an id are ``rejects`` (file_path, recommendation_id, record), whole as
    they were read where broken. ``summary`` has a row for every file found: one that
    can't be read to its end is not read at all and has the status ``unreadable``, one
    without rows ``empty``; none of them fails the import."""
    from plaudit.sources.io import broken_files, files_of, read_review_glob
    files = f"{directory.rstrip('/')}/{pattern}"
    bad = sorted(r["path"] for r in broken_files(spark, files).collect())  # one row per damaged file
    rows = read_review_glob(spark, directory, pattern, corrupt, skip=bad)
    good = F.col(corrupt).isNull() & F.col("recommendation_id").isNotNull()
    fields = [c for c in rows.columns if c not in ("file_path", "file_name", corrupt)]
    rejects = rows.where(~good).select("file_path", "recommendation_id", F.coalesce(
        F.col(corrupt), F.to_json(F.struct(*fields))).alias("record"))
    summary = import_summary(rows, existing, "file_path", corrupt)
    found = spark.createDataFrame([(p, p in set(bad)) for p in files_of(spark, files)], "file_path string, _bad boolean")
    counts = ["rows", "errors", "imported", "skipped"]
    summary = found.join(summary, "file_path", "left").select(
        "file_path", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        F.when(F.col("_bad"), "unreadable").otherwise(F.coalesce("status", F.lit("empty"))).alias("status"))
    return rows.where(good).drop(corrupt), rejects, summary


def game_names(spark: SparkSession, overrides: dict | None = None,
               defaults: dict | None = None) -> DataFrame:
    """app_id -> name; configured names override the defaults (max_by priority)."""
    defaults = DEFAULT_GAME_NAMES if defaults is None else defaults
    rows = [(k, v, 0) for k, v in defaults.items()] + [(str(k), v, 1) for k, v in (overrides or {}).items()]
    d = spark.createDataFrame(rows, "app_id string, name string, prio int")
    return d.groupBy("app_id").agg(F.max_by("name", "prio").alias("game_name"))


def with_game_name(df: DataFrame, games: DataFrame) -> DataFrame:
    """Attach the game name: known id -> name, unknown -> 'App <id>', null -> 'Unknown'.
    Spark broadcasts the name table if its size allows; a larger one is shuffled and
    a hot app split by the skew join."""
    j = df.join(games, "app_id", "left")
    return j.withColumn("game_name", F.when(F.col("app_id").isNull(), F.lit("Unknown"))
                        .otherwise(F.coalesce(F.col("game_name"), F.concat(F.lit("App "), F.col("app_id")))))
