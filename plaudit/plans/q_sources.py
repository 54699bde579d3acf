"""Registered queries for sources, sinks, ingest (2-A) and cleaning (2-B).

Readers are checked by round trips: Spark writes data derived from the given
tables into the shared scratch folder (under ``spark.checkpoint.dir``), reads it
back with the operator, and the result must equal the source view.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plaudit.functions import (clip, coerce_epoch, epoch_to_ts, is_blank, length_bin,
                               normalize_vote, playtime_bin, playtime_hours, review_length,
                               star_rating, word_count)
from plaudit.operators import keywords as kw
from plaudit.operators import stats
from plaudit.plans import sqlgen as S
from plaudit.plans.q_core import LENGTH_BIN_SQL, PLAYTIME_BIN_SQL
from plaudit.plans.registry import register, rnd
from plaudit.session import scratch_path
from plaudit.sources import ingest, io
from plaudit.sources.fixtures import REVIEWS_CTE_SQL, reviews

R = f"WITH {REVIEWS_CTE_SQL}"
VIEW_COLS = ["recommendation_id", "app_id", "language", "review", "timestamp_created", "voted_up",
             "author_playtime_forever", "author_steam_id", "votes_up", "votes_funny",
             "written_during_early_access"]
VIEW_SQL = f"{R} SELECT {', '.join(VIEW_COLS)} FROM reviews"
VIEW_DOUBLES = ["author_playtime_forever"]


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _typed(df):
    return df.select(*[F.col(c) for c in VIEW_COLS])


@register("csv_roundtrip", rnd(VIEW_SQL, VIEW_DOUBLES))
def q_csv_roundtrip(spark, sf):
    """reviews -> CSV (quoted multi-line text) -> read_review_csv -> typed columns."""
    src = reviews(spark, sf)
    path = _scratch(spark, "csv")
    (src.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(path))
    back = io.read_review_csv(spark, path, src.columns).drop("file_name")
    back = back.withColumn("written_during_early_access", F.col("written_during_early_access"))
    typed = io.project_to_schema(back, keep_extra=True)
    return typed.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "review" else F.col(c)
                          for c in VIEW_COLS])


@register("api_pages_roundtrip", rnd(VIEW_SQL, VIEW_DOUBLES))
def q_api_pages(spark, sf):
    """reviews -> landed API pages (100 ids a page, plus failed copies) ->
    read_api_pages -> flatten_review -> canonicalize_columns -> project_to_schema."""
    src = reviews(spark, sf)
    r = F.struct(
        F.col("recommendation_id").alias("recommendationid"), "language", "review",
        "timestamp_created", (F.col("voted_up") == 1).alias("voted_up"),
        F.col("votes_up").cast("long").alias("votes_up"), F.col("votes_funny").cast("long").alias("votes_funny"),
        (F.col("written_during_early_access") == 1).alias("written_during_early_access"),
        F.struct(F.col("author_steam_id").alias("steamid"),
                 F.col("author_playtime_forever").alias("playtime_forever")).alias("author"))
    page = F.floor(F.col("recommendation_id").cast("long") / 100)
    pages = src.groupBy("app_id", page.alias("page")).agg(F.collect_list(r).alias("reviews"))
    ok = pages.select(F.lit(1).alias("success"), F.concat(F.lit("c"), F.col("page").cast("string")).alias("cursor"),
                      "app_id", "reviews")
    failed = ok.withColumn("success", F.lit(0))
    path = _scratch(spark, "pages")
    ok.unionByName(failed).write.mode("overwrite").json(path)
    rows = io.read_api_pages(spark, path)
    flat = io.canonicalize_columns(io.flatten_review(rows))
    typed = io.project_to_schema(flat)
    return typed.select(*VIEW_COLS)


CUTOFF = 1704153600  # 2024-01-02 00:00:00 UTC


@register("append_new", f"""{R}
SELECT recommendation_id, app_id, timestamp_created FROM reviews WHERE timestamp_created >= {CUTOFF}""")
def q_append_new(spark, sf):
    """Stored = reviews before the cutoff; batch = every review (twice); only the
    not-yet-stored reviews come out, once each."""
    src = reviews(spark, sf)
    table = _scratch(spark, "table")
    ingest.append_new(None, src.where(F.col("timestamp_created") < CUTOFF), table)
    stored = io.read_reviews_table(spark, table)
    batch = src.unionByName(src)
    return ingest.new_rows(stored, batch).select("recommendation_id", "app_id", "timestamp_created")


@register("existing_ids", f"""{R} SELECT count(DISTINCT recommendation_id) AS n FROM reviews""")
def q_existing_ids(spark, sf):
    df = reviews(spark, sf).withColumnRenamed("recommendation_id", "recommendationid")
    return ingest.existing_ids(df).agg(F.count(F.lit(1)).alias("n"))


@register("import_summary", f"""{R}
SELECT app_id AS source, count(*) AS rows, CAST(0 AS BIGINT) AS errors,
       count_if(timestamp_created >= {CUTOFF}) AS imported,
       count(*) - count_if(timestamp_created >= {CUTOFF}) AS skipped,
       CASE WHEN count_if(timestamp_created >= {CUTOFF}) > 0 THEN 'imported' ELSE 'skipped' END AS status
FROM reviews GROUP BY app_id""")
def q_import_summary(spark, sf):
    """CSV files per app, imported over a table holding the reviews before the cutoff."""
    src = reviews(spark, sf)
    path = _scratch(spark, "import")
    (src.write.option("header", True).option("escape", '"').partitionBy("app_id").mode("overwrite").csv(path))
    batch = io.read_review_csv(spark, path).withColumn(
        "source", F.regexp_extract(F.col("_metadata.file_path"), r"app_id=([^/]+)", 1))
    stored = src.where(F.col("timestamp_created") < CUTOFF)
    return ingest.import_summary(batch, stored, "source")


@register("filename_parsing", f"""{R},
f AS (SELECT replace(app_id, 'src', 'Title_') || '_' || author_steam_id || '_reviews.csv' AS fname FROM reviews)
SELECT fname, replace(regexp_extract(replace(fname, '_reviews.csv', ''), '^(.*)_[^_]*$', 1), '_', ' ') AS game_name,
       regexp_extract(replace(fname, '_reviews.csv', ''), '_([^_]*)$', 1) AS app_id,
       regexp_extract(fname, '^[^_]*_([0-9]+)_', 1) AS first_numeric
FROM f""")
def q_filename_parsing(spark, sf):
    d = reviews(spark, sf).select(F.concat(F.replace("app_id", F.lit("src"), F.lit("Title_")), F.lit("_"),
                                           "author_steam_id", F.lit("_reviews.csv")).alias("fname"))
    s = io.source_from_filename("fname")
    return d.select("fname", s.getField("game_name").alias("game_name"), s.getField("app_id").alias("app_id"),
                    io.app_id_from_filename("fname").alias("first_numeric"))


@register("with_game_name", rnd(f"""{R}
SELECT app_id, count(*) AS total, CAST(sum(voted_up) AS BIGINT) AS positive,
       count(*) - CAST(sum(voted_up) AS BIGINT) AS negative,
       round(sum(voted_up) / count(*) * 100, 2) AS positive_rate,
       CASE app_id WHEN 'src1' THEN 'First Source' WHEN 'src2' THEN 'Second Source'
                   ELSE 'App ' || app_id END AS game_name
FROM reviews GROUP BY app_id""", ["positive_rate"]))
def q_with_game_name(spark, sf):
    games = ingest.game_names(spark, {"src1": "First Source", "src2": "Second Source",
                                      "2897760": "Renamed"})
    return ingest.with_game_name(stats.stats_by_game(reviews(spark, sf)), games)


@register("load_stopwords", f"""{R}, tok AS (SELECT *, {S.tokens_en(S.clean())} AS tokens FROM reviews)
SELECT word FROM (SELECT word, count(*) AS c FROM (SELECT unnest(tokens) AS word FROM tok)
                  GROUP BY word ORDER BY c DESC, word LIMIT 50)""")
def q_load_stopwords(spark, sf):
    """The corpus' 50 most frequent tokens written as a padded one-per-line file,
    then read back with load_stopwords."""
    top = kw.keyword_counts(reviews(spark, sf), 50).select(
        F.concat(F.lit("  "), F.col("word"), F.lit(" ")).alias("value"))
    path = _scratch(spark, "stop")
    top.union(top.select(F.lit("   ").alias("value"))).coalesce(1).write.mode("overwrite").text(path)
    return io.load_stopwords(spark, path)


@register("reviews_table_roundtrip", rnd(f"""{VIEW_SQL}
WHERE app_id = 'src3' AND timestamp_created BETWEEN 1704067200 AND 1704240000""", VIEW_DOUBLES))
def q_reviews_table(spark, sf):
    """Partitioned, time-sorted table; the read prunes to one app folder and pushes
    the time range into the Parquet scan."""
    path = _scratch(spark, "reviews_table")
    io.write_reviews_table(reviews(spark, sf), path, "overwrite")
    t = io.read_reviews_table(spark, path)
    return t.where((F.col("app_id") == "src3") & F.col("timestamp_created").between(1704067200, 1704240000)) \
            .select(*VIEW_COLS)


@register("export_json_roundtrip", rnd(VIEW_SQL, VIEW_DOUBLES))
def q_export_json(spark, sf):
    path = _scratch(spark, "json")
    src = reviews(spark, sf)
    io.export_json(src, path)
    back = spark.read.schema(src.schema).json(path)
    return back.select(*VIEW_COLS)


@register("export_csv_app", rnd(f"{VIEW_SQL} WHERE app_id = 'src7'", VIEW_DOUBLES))
def q_export_csv(spark, sf):
    path = _scratch(spark, "export")
    src = reviews(spark, sf)
    io.export_csv(src, path, app_id="src7")
    back = io.read_review_csv(spark, path, src.columns).drop("file_name")
    return io.project_to_schema(back, keep_extra=True).select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "review" else F.col(c) for c in VIEW_COLS])


@register("merge_page_schemas", rnd(f"""{R}
SELECT author_playtime_forever, CAST(NULL AS VARCHAR) AS language, recommendation_id, NULL::BIGINT AS votes_up
FROM reviews WHERE voted_up = 1
UNION ALL
SELECT NULL::DOUBLE, language, recommendation_id, CAST(votes_up AS BIGINT) FROM reviews WHERE voted_up = 0""",
                                    ["author_playtime_forever"]))
def q_merge_page_schemas(spark, sf):
    src = reviews(spark, sf)
    a = src.where("voted_up = 1").select("recommendation_id", "author_playtime_forever")
    b = src.where("voted_up = 0").select("votes_up", "recommendation_id", "language")
    return io.merge_page_schemas(a, b)


@register("changed_files", note="binaryFile listing + md5 anti-join; file names are random")
def q_changed_files(spark, sf):
    path = _scratch(spark, "watch")
    src = reviews(spark, sf)
    src.where(F.col("timestamp_created") < CUTOFF).write.mode("overwrite").parquet(path)
    manifest = io.changed_files(spark, f"{path}/*.parquet").select(
        "path", "md5", F.current_timestamp().alias("checked_at"))
    # the manifest is a written table: a lost cache would be recomputed from the
    # already-changed folder
    mpath = _scratch(spark, "manifest")
    manifest.write.mode("overwrite").parquet(mpath)
    manifest = spark.read.parquet(mpath)
    src.where(F.col("timestamp_created") >= CUTOFF).write.mode("append").parquet(path)
    return io.changed_files(spark, f"{path}/*.parquet", manifest).select("md5", "reason")


# ------------------------------------------------------------------ 2-B cleaning

@register("clean_columns", rnd(f"""{R}
SELECT recommendation_id,
  CASE WHEN lower(trim(CASE voted_up WHEN 1 THEN 'True' ELSE 'False' END)) IN ('true', '1', '1.0') THEN 1 ELSE 0 END AS vote_from_text,
  CAST(TRY_CAST(TRY_CAST(CAST(timestamp_created AS VARCHAR) AS DOUBLE) AS BIGINT) AS BIGINT) AS epoch,
  strftime(to_timestamp(timestamp_created) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created,
  author_playtime_forever / 60 AS playtime_hours,
  CAST(length(coalesce(review, '')) AS BIGINT) AS review_length,
  CAST({S.word_count()} AS BIGINT) AS word_count,
  least(greatest(author_playtime_forever / 60, 0), 500) AS playtime_clipped,
  CAST(least(greatest(length(coalesce(review, '')), 0), 2000) AS BIGINT) AS length_clipped,
  round_even(votes_up / 19.0 * 5, 0) AS star_rating,
  (SELECT {PLAYTIME_BIN_SQL} FROM (SELECT author_playtime_forever / 60.0 AS h)) AS playtime_bin,
  (SELECT {LENGTH_BIN_SQL} FROM (SELECT length(coalesce(review, '')) AS n)) AS length_bin,
  {S.is_blank()} AS is_blank
FROM reviews""", ["playtime_hours", "playtime_clipped", "star_rating"]))
def q_clean_columns(spark, sf):
    d = reviews(spark, sf).withColumn(
        "vote_text", F.when(F.col("voted_up") == 1, "True").otherwise("False")).withColumn(
        "ts_text", F.col("timestamp_created").cast("string"))
    return d.select(
        "recommendation_id", normalize_vote("vote_text").alias("vote_from_text"),
        coerce_epoch("ts_text").alias("epoch"),
        F.date_format(epoch_to_ts("timestamp_created"), "yyyy-MM-dd HH:mm:ss").alias("created"),
        playtime_hours("author_playtime_forever").alias("playtime_hours"),
        review_length("review").alias("review_length"), word_count("review").alias("word_count"),
        clip(playtime_hours("author_playtime_forever"), 0, 500).alias("playtime_clipped"),
        clip(review_length("review"), 0, 2000).alias("length_clipped"),
        star_rating(F.col("votes_up") / 19.0).alias("star_rating"),
        playtime_bin(F.col("author_playtime_forever") / 60.0).alias("playtime_bin"),
        length_bin(review_length("review")).alias("length_bin"),
        is_blank("review").alias("is_blank"))


@register("review_filters", f"""{R}
SELECT app_id, count(*) AS n_all, count_if(NOT {S.is_blank()}) AS n_not_blank,
       count_if(length(coalesce(review, '')) > 20) AS n_long,
       count_if(review IS NOT NULL AND author_playtime_forever IS NOT NULL) AS n_complete
FROM reviews GROUP BY app_id""")
def q_review_filters(spark, sf):
    """The predicates of drop_blank_reviews, long_reviews and dropna_subset, counted
    per app in one pass."""
    from plaudit.operators import filters as fl
    return reviews(spark, sf).groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(fl.not_blank()).alias("n_not_blank"),
        F.count_if(fl.longer_than(20)).alias("n_long"),
        F.count_if(fl.complete(["review", "author_playtime_forever"])).alias("n_complete"))


@register("read_review_glob", rnd(f"""{R}
SELECT recommendation_id, app_id, review, CAST(voted_up AS BIGINT) AS voted_up, CAST(votes_up AS BIGINT) AS votes_up
FROM (SELECT recommendation_id, app_id, review, voted_up, CASE WHEN doc % 3 = 2 THEN NULL ELSE votes_up END AS votes_up
      FROM (SELECT *, CAST(recommendation_id AS BIGINT) AS doc FROM reviews))""", []))
def q_read_review_glob(spark, sf):
    """Review files of three kinds of header (order, names and columns differ), each
    read by its own."""
    src = reviews(spark, sf)
    path = _scratch(spark, "glob")
    k = F.col("recommendation_id").cast("long") % 3
    kinds = [src.where(k == 0).select(F.col("recommendation_id").alias("recommendationid"), "review", "voted_up",
                                      "votes_up", "app_id"),
             src.where(k == 1).select("app_id", "voted_up", "recommendation_id", "votes_up", "review"),
             src.where(k == 2).select("review", "app_id", "voted_up", F.col("recommendation_id").alias("recommendationid"))]
    for i, df in enumerate(kinds):
        df.write.option("header", True).option("escape", '"').csv(f"{path}/{i}")
    got = io.project_to_schema(io.read_review_glob(spark, path, "*/part-*.csv"))
    return got.select("recommendation_id", "app_id", F.coalesce("review", F.lit("")).alias("review"), "voted_up", "votes_up")


@register("append_new_rejects", f"""{R}
SELECT count_if(CAST(recommendation_id AS BIGINT) % 4 <> 0) AS inserted,
       count_if(CAST(recommendation_id AS BIGINT) % 4 = 0) AS rejected,
       count_if(CAST(recommendation_id AS BIGINT) % 4 = 0) AS reject_rows FROM reviews""")
def q_append_new_rejects(spark, sf):
    """A quarter of the rows have no id: all are in the reject table, none is folded."""
    path = _scratch(spark, "rejects")
    batch = reviews(spark, sf).withColumn("recommendation_id", F.when(
        F.col("recommendation_id").cast("long") % 4 != 0, F.col("recommendation_id")))
    report = ingest.append_report(None, batch, path)
    return spark.read.json(path + "_rejects").agg(F.count(F.lit(1)).alias("reject_rows")).select(
        F.lit(report["inserted"]).cast("long").alias("inserted"),
        F.lit(report["rejected"]).cast("long").alias("rejected"), "reject_rows")


@register("drop_all_null_columns", f"""{R}
SELECT recommendation_id, app_id FROM reviews""")
def q_drop_all_null_columns(spark, sf):
    df = reviews(spark, sf).select("recommendation_id", "app_id", F.lit(None).cast("string").alias("empty"))
    return stats.drop_all_null_columns(df)


@register("changed_files_reasons", f"""{R},
m AS (SELECT DISTINCT app_id FROM reviews WHERE timestamp_created < {CUTOFF}),
n AS (SELECT DISTINCT app_id FROM reviews WHERE timestamp_created >= {CUTOFF})
SELECT app_id, 'new' AS reason FROM n UNION ALL SELECT app_id, 'changed' FROM m WHERE app_id = 'src1'
UNION ALL SELECT app_id, 'stale' FROM m WHERE app_id = 'src2'""")
def q_changed_files_reasons(spark, sf):
    """Files of a table by app against a manifest with another sum for one app's files
    and an old check for another's, after files were added."""
    path = _scratch(spark, "watch")
    src = reviews(spark, sf)
    src.where(F.col("timestamp_created") < CUTOFF).write.partitionBy("app_id").parquet(path)
    app = F.regexp_extract("path", "app_id=([^/]+)", 1)
    mpath = _scratch(spark, "manifest")
    io.changed_files(spark, f"{path}/*/*.parquet").select(
        "path", F.when(app == "src1", F.md5("md5")).otherwise(F.col("md5")).alias("md5"),
        F.when(app == "src2", F.timestamp_seconds(F.lit(0))).otherwise(F.current_timestamp()).alias("checked_at")
    ).write.parquet(mpath)
    src.where(F.col("timestamp_created") >= CUTOFF).write.mode("append").partitionBy("app_id").parquet(path)
    return io.changed_files(spark, f"{path}/*/*.parquet", spark.read.parquet(mpath)) \
        .select(app.alias("app_id"), "reason").distinct()


@register("import_files", f"""{R},
k AS (SELECT app_id, CAST(recommendation_id AS BIGINT) % 7 AS k, timestamp_created >= {CUTOFF} AS fresh FROM reviews)
SELECT app_id, CAST(count(*) AS BIGINT) AS rows, count_if(k < 3) AS errors, count_if(k >= 3 AND fresh) AS imported,
       count_if(k >= 3 AND NOT fresh) AS skipped, count_if(k < 3) AS rejects, count_if(k >= 3) AS reviews
FROM k GROUP BY app_id""")
def q_import_files(spark, sf):
    """CSV files by app in which some records lack fields, some have one too many and
    some no id, imported over a table that holds the reviews before the cutoff."""
    src = reviews(spark, sf)
    path = _scratch(spark, "import_files")
    k = F.col("recommendation_id").cast("long") % 7
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("review", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = (F.when(k == 0, F.concat_ws(",", "recommendation_id", quoted))
            .when(k == 1, F.concat_ws(",", "recommendation_id", quoted, "voted_up", F.lit("more")))
            .otherwise(F.concat_ws(",", F.when(k == 2, "").otherwise(F.col("recommendation_id")), quoted, "voted_up")))
    # a file holds one header line before its records, written as text
    (src.select("app_id", line.alias("value")).repartition("app_id").sortWithinPartitions("app_id")
     .write.option("lineSep", "\n").partitionBy("app_id").text(path + "/body"))
    body = spark.read.text(path + "/body/*", wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), "app_id=([^/]+)", 1).alias("app_id"), "value")
    body.select("app_id", F.concat(F.lit("recommendationid,review,voted_up\n"), "value").alias("value")) \
        .write.option("lineSep", "\n").partitionBy("app_id").text(path + "/csv")
    good, rejects, summary = ingest.import_files(spark, path + "/csv", "*/part-*", src.where(F.col("timestamp_created") < CUTOFF))
    app = F.regexp_extract("file_path", "app_id=([^/]+)", 1).alias("app_id")
    counts = [d.groupBy(app).agg(F.count(F.lit(1)).alias(n)) for d, n in ((rejects, "rejects"), (good, "reviews"))]
    out = summary.groupBy(app).agg(*[F.sum(c).alias(c) for c in ("rows", "errors", "imported", "skipped")])
    return out.join(counts[0], "app_id", "left").join(counts[1], "app_id", "left").fillna(0)


@register("variant_pages", rnd(f"""{R},
k AS (SELECT *, CAST(recommendation_id AS BIGINT) % 3 AS k FROM reviews)
SELECT app_id, recommendation_id AS recommendationid, CASE WHEN k < 2 THEN author_steam_id END AS author_steamid,
       CASE WHEN k = 0 THEN author_playtime_forever WHEN k = 1 THEN CAST(votes_up AS DOUBLE) END AS author_playtime_forever,
       CASE WHEN k = 1 THEN CAST(votes_funny AS BIGINT) END AS author_level,
       CASE WHEN k = 0 THEN '{{"won":' || CAST(votes_up AS VARCHAR) || '}}' END AS author_badges
FROM k""", ["author_playtime_forever"]))
def q_variant_pages(spark, sf):
    """Pages whose authors have three shapes: ids as text with nested badges, ids as
    numbers with a level, and none; failed pages beside them."""
    src = reviews(spark, sf).withColumn("k", F.col("recommendation_id").cast("long") % 3)
    text = F.to_json(F.struct(F.col("author_steam_id").alias("steamid"), F.col("author_playtime_forever").alias("playtime_forever"),
                              F.struct(F.col("votes_up").alias("won")).alias("badges")))
    number = F.to_json(F.struct(F.col("author_steam_id").cast("long").alias("steamid"), F.col("votes_up").alias("playtime_forever"),
                                F.col("votes_funny").alias("level")))
    author = F.when(F.col("k") == 0, text).when(F.col("k") == 1, number).otherwise("null")
    review = F.concat(F.lit('{"recommendationid":"'), "recommendation_id", F.lit('","author":'), author, F.lit("}"))
    page = F.floor(F.col("recommendation_id").cast("long") / 100)
    pages = src.groupBy("app_id", page.alias("page")).agg(F.array_join(F.collect_list(review), ",").alias("r"))  # 100 ids a page
    lines = pages.select(F.explode(F.array(*[F.concat(F.lit('{"success":%d,"app_id":"' % ok), "app_id", F.lit('","reviews":['),
                                                      "r", F.lit("]}")) for ok in (1, 0)])).alias("value"))
    path = _scratch(spark, "variant_pages")
    lines.write.text(path)
    got = io.read_variant_pages(spark, path)
    flat = got.select("app_id", F.try_variant_get("review", "$.recommendationid", "string").alias("recommendationid"),
                      F.try_variant_get("review", "$.author", "variant").alias("author"))
    return io.lift_fields(flat, "author", "author_")
