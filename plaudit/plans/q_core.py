"""Registered queries for scans, statistics and time series (2-C, 2-D, 2-E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit.operators import scan, stats, timeseries as ts
from plaudit.plans.registry import register, rnd
from plaudit.sources.fixtures import REVIEW_EVENTS_CTE_SQL, REVIEWS_CTE_SQL, review_events, reviews

R = f"WITH {REVIEWS_CTE_SQL}"
E = f"WITH {REVIEW_EVENTS_CTE_SQL}"
# day of a unix timestamp, and the pandas 'W' (week ending Sunday) / month-end labels
DAY = "CAST(to_timestamp(timestamp_created) AT TIME ZONE 'UTC' AS DATE)"
WEEK = f"CAST(date_trunc('week', {DAY}) AS DATE) + 6"
MONTH = f"last_day({DAY})"

# ----------------------------------------------------------------- 2-C scans


@register("get_reviews", rnd(f"""{R}
SELECT recommendation_id, app_id, language, review, CAST(voted_up AS BIGINT) AS voted_up,
       timestamp_created
FROM reviews
WHERE author_playtime_forever >= 1 * 60 AND author_playtime_forever <= 20 * 60
  AND voted_up = 1 AND language IN ('en', 'de')
ORDER BY timestamp_created DESC, recommendation_id
LIMIT 50""", []))
def q_get_reviews(spark, sf):
    """Filtered scan: playtime 1-20 h, positive, English or German; newest 50."""
    return scan.get_reviews(reviews(spark, sf), min_playtime=1, max_playtime=20, voted_up=True,
                            language=["en", "de"], limit=50).select(*scan.REVIEW_FIELDS)


@register("get_reviews_app_window", f"""{R}
SELECT recommendation_id, app_id, language, review, CAST(voted_up AS BIGINT) AS voted_up,
       timestamp_created
FROM reviews
WHERE app_id = 'src3' AND timestamp_created >= 1704067200 AND timestamp_created <= 1704240000""")
def q_get_reviews_app_window(spark, sf):
    """All reviews of one app inside a time window (no limit)."""
    return scan.get_reviews(reviews(spark, sf), app_id="src3", start=1704067200,
                            end=1704240000).select(*scan.REVIEW_FIELDS)


@register("get_review", f"""{R}
SELECT recommendation_id, app_id, review FROM reviews WHERE recommendation_id = '42'""")
def q_get_review(spark, sf):
    return scan.get_review(reviews(spark, sf), "42").select("recommendation_id", "app_id", "review")


@register("list_reviews", f"""{R}
SELECT recommendation_id, app_id, language, review, CAST(voted_up AS BIGINT) AS voted_up,
       timestamp_created
FROM reviews WHERE app_id = 'src5' AND language = 'fr'
ORDER BY timestamp_created DESC, recommendation_id LIMIT 10""")
def q_list_reviews(spark, sf):
    return scan.list_reviews(reviews(spark, sf), app_id="src5", limit=10, language="fr")


@register("latest_per_app", f"""{R}
SELECT app_id, recommendation_id, timestamp_created, rank FROM (
  SELECT app_id, recommendation_id, timestamp_created,
         CAST(row_number() OVER (PARTITION BY app_id ORDER BY timestamp_created DESC,
                                 recommendation_id) AS BIGINT) AS rank
  FROM reviews) WHERE rank <= 5""")
def q_latest_per_app(spark, sf):
    return scan.latest_per_app(reviews(spark, sf), 5).select(
        "app_id", "recommendation_id", "timestamp_created", "rank")


@register("recent_votes", f"""{R}
SELECT recommendation_id, timestamp_created, CAST(voted_up AS BIGINT) AS voted_up FROM reviews
ORDER BY timestamp_created DESC, recommendation_id DESC LIMIT 100""")
def q_recent_votes(spark, sf):
    return scan.recent_votes(reviews(spark, sf), 100).select(
        "recommendation_id", "timestamp_created", "voted_up")


@register("vote_samples", f"""{R}
SELECT app_id, CAST(voted_up AS BIGINT) AS voted_up, sample_rank, recommendation_id,
       CASE WHEN length(coalesce(review, '')) > 200
            THEN substring(coalesce(review, ''), 1, 200) || '...' ELSE coalesce(review, '') END
         AS review_excerpt
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, voted_up
                     ORDER BY timestamp_created, recommendation_id) AS BIGINT) AS sample_rank
      FROM reviews) WHERE sample_rank <= 3""")
def q_vote_samples(spark, sf):
    return scan.vote_samples(reviews(spark, sf), 3, 200)


@register("preview", f"""{R}
SELECT recommendation_id, app_id FROM reviews ORDER BY recommendation_id LIMIT 10""")
def q_preview(spark, sf):
    return scan.preview(reviews(spark, sf).orderBy("recommendation_id"),
                        ["recommendation_id", "app_id", "not_a_column"], 10)


# ----------------------------------------------------------------- 2-D statistics

@register("review_stats", f"""{R}
SELECT count(*) AS total, CAST(coalesce(sum(voted_up), 0) AS BIGINT) AS positive,
       count(*) - CAST(coalesce(sum(voted_up), 0) AS BIGINT) AS negative FROM reviews""")
def q_review_stats(spark, sf):
    return stats.review_stats(reviews(spark, sf))


@register("stats_by_game", rnd(f"""{R}
SELECT app_id, count(*) AS total, CAST(sum(voted_up) AS BIGINT) AS positive,
       count(*) - CAST(sum(voted_up) AS BIGINT) AS negative,
       round(CAST(sum(voted_up) AS DOUBLE) / count(*) * 100, 2) AS positive_rate
FROM reviews GROUP BY app_id""", ["positive_rate"]))
def q_stats_by_game(spark, sf):
    return stats.stats_by_game(reviews(spark, sf))


@register("positive_rate_window", rnd(f"""{R}
SELECT count(*) AS total, CAST(coalesce(sum(voted_up), 0) AS BIGINT) AS positive,
       count(*) - CAST(coalesce(sum(voted_up), 0) AS BIGINT) AS negative,
       CASE WHEN count(*) > 0 THEN round(CAST(sum(voted_up) AS DOUBLE) / count(*) * 100, 2)
            ELSE 0.0 END AS positive_rate
FROM reviews WHERE timestamp_created >= 1704153600 AND timestamp_created <= 1704240000""",
                                       ["positive_rate"]))
def q_positive_rate_window(spark, sf):
    return stats.positive_rate(reviews(spark, sf), start=1704153600, end=1704240000)


@register("available_languages", f"""{R}
SELECT DISTINCT language FROM reviews WHERE language IS NOT NULL""")
def q_available_languages(spark, sf):
    return stats.available_languages(reviews(spark, sf))


@register("date_range", f"""{R}
SELECT app_id, min(timestamp_created) AS min_ts, max(timestamp_created) AS max_ts,
       strftime(to_timestamp(min(timestamp_created)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_review,
       strftime(to_timestamp(max(timestamp_created)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_review
FROM reviews GROUP BY app_id""")
def q_date_range(spark, sf):
    return stats.date_range(reviews(spark, sf), ["app_id"])


@register("playtime_range", rnd(f"""{R}
SELECT app_id, coalesce(min(author_playtime_forever), 0.0) AS min_playtime,
       coalesce(max(author_playtime_forever), 0.0) AS max_playtime
FROM reviews GROUP BY app_id""", ["min_playtime", "max_playtime"]))
def q_playtime_range(spark, sf):
    return stats.playtime_range(reviews(spark, sf), ["app_id"])


@register("filter_metadata", rnd(f"""{R}
SELECT app_id, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages,
       min(timestamp_created) AS min_ts, max(timestamp_created) AS max_ts,
       coalesce(min(author_playtime_forever), 0.0) AS min_playtime,
       coalesce(max(author_playtime_forever), 0.0) AS max_playtime
FROM reviews GROUP BY app_id""", ["min_playtime", "max_playtime"]))
def q_filter_metadata(spark, sf):
    return stats.filter_metadata(reviews(spark, sf), ["app_id"])


@register("language_counts", rnd(f"""{R}
SELECT language, n, round(n / sum(n) OVER () * 100, 2) AS pct FROM (
  SELECT language, count(*) AS n FROM reviews GROUP BY language)""", ["pct"]))
def q_language_counts(spark, sf):
    return stats.language_counts(reviews(spark, sf))


@register("language_counts_top", rnd(f"""{R}
SELECT app_id, language, n, pct, rank FROM (
  SELECT app_id, language, n, round(n / sum(n) OVER (PARTITION BY app_id) * 100, 2) AS pct,
         CAST(row_number() OVER (PARTITION BY app_id ORDER BY n DESC, language) AS BIGINT) AS rank
  FROM (SELECT app_id, language, count(*) AS n FROM reviews GROUP BY app_id, language))
WHERE rank <= 2""", ["pct"]))
def q_language_counts_top(spark, sf):
    return stats.language_counts(reviews(spark, sf), top=2, keys=["app_id"])


@register("modal_language", f"""{R}
SELECT app_id, language, n FROM (
  SELECT app_id, language, n,
         row_number() OVER (PARTITION BY app_id ORDER BY n DESC, language) AS r
  FROM (SELECT app_id, language, count(*) AS n FROM reviews
        WHERE language IS NOT NULL GROUP BY app_id, language)) WHERE r = 1""")
def q_modal_language(spark, sf):
    return stats.modal_value(reviews(spark, sf), "language", ["app_id"])


@register("early_access_summary", rnd(f"""{R}
SELECT written_during_early_access, count(*) AS n, avg(voted_up) * 100 AS positive_pct
FROM reviews GROUP BY written_during_early_access""", ["positive_pct"]))
def q_early_access_summary(spark, sf):
    return stats.early_access_summary(reviews(spark, sf))


@register("length_stats", rnd(f"""{R}
SELECT app_id, avg(length(coalesce(review, ''))) AS avg_length,
       CAST(max(length(coalesce(review, ''))) AS BIGINT) AS max_length,
       CAST(min(length(coalesce(review, ''))) AS BIGINT) AS min_length
FROM reviews GROUP BY app_id""", ["avg_length"]))
def q_length_stats(spark, sf):
    return stats.length_stats(reviews(spark, sf), ["app_id"])


PLAYTIME_BIN_SQL = """CASE WHEN h >= 0 AND h < 1 THEN '<1h' WHEN h >= 1 AND h < 5 THEN '1-5h'
  WHEN h >= 5 AND h < 10 THEN '5-10h' WHEN h >= 10 AND h < 20 THEN '10-20h'
  WHEN h >= 20 AND h < 50 THEN '20-50h' WHEN h >= 50 AND h < 100 THEN '50-100h'
  WHEN h >= 100 AND h < 200 THEN '100-200h' WHEN h >= 200 AND h < 500 THEN '200-500h'
  WHEN h >= 500 THEN '>=500h' END"""
LENGTH_BIN_SQL = """CASE WHEN n >= 0 AND n < 50 THEN '<50' WHEN n >= 50 AND n < 100 THEN '50-100'
  WHEN n >= 100 AND n < 200 THEN '100-200' WHEN n >= 200 AND n < 500 THEN '200-500'
  WHEN n >= 500 AND n < 1000 THEN '500-1000' WHEN n >= 1000 THEN '>1000' END"""
BINNED = f"""binned AS (SELECT *, {PLAYTIME_BIN_SQL} AS playtime_bin, {LENGTH_BIN_SQL} AS length_bin
  FROM (SELECT *, author_playtime_forever / 60.0 AS h, length(coalesce(review, '')) AS n FROM reviews))"""


def _bin_counts_sql(kind: str, labels: list[str]) -> str:
    grid = ", ".join(f"('{lab}', {i})" for i, lab in enumerate(labels))
    return f"""{R}, {BINNED},
grid AS (SELECT g.app_id, b.bin, CAST(b.bin_order AS BIGINT) AS bin_order
         FROM (SELECT DISTINCT app_id FROM reviews) g,
              (VALUES {grid}) AS b(bin, bin_order)),
counts AS (SELECT app_id, {kind}_bin AS bin, count(*) AS n FROM binned
           WHERE {kind}_bin IS NOT NULL GROUP BY app_id, {kind}_bin)
SELECT grid.app_id, grid.bin, grid.bin_order, coalesce(counts.n, 0) AS n
FROM grid LEFT JOIN counts ON grid.app_id = counts.app_id AND grid.bin = counts.bin"""


@register("bin_counts_playtime", _bin_counts_sql(
    "playtime", ["<1h", "1-5h", "5-10h", "10-20h", "20-50h", "50-100h", "100-200h", "200-500h",
                 ">=500h"]))
def q_bin_counts_playtime(spark, sf):
    return stats.bin_counts(reviews(spark, sf), "playtime", ["app_id"])


@register("bin_counts_length", _bin_counts_sql(
    "length", ["<50", "50-100", "100-200", "200-500", "500-1000", ">1000"]))
def q_bin_counts_length(spark, sf):
    return stats.bin_counts(reviews(spark, sf), "length", ["app_id"])


def _share_sql(key: str) -> str:
    return rnd(f"""{R}, {BINNED}
SELECT {key}, count(*) AS n, avg(CAST(voted_up AS DOUBLE)) AS "Positive",
       1 - avg(CAST(voted_up AS DOUBLE)) AS "Negative"
FROM binned WHERE {key} IS NOT NULL GROUP BY {key}""", ["Positive", "Negative"])


@register("sentiment_share_playtime", _share_sql("playtime_bin"))
def q_share_playtime(spark, sf):
    return stats.sentiment_share_by(stats.with_bins(reviews(spark, sf)), "playtime_bin")


@register("sentiment_share_length", _share_sql("length_bin"))
def q_share_length(spark, sf):
    return stats.sentiment_share_by(stats.with_bins(reviews(spark, sf)), "length_bin")


@register("sentiment_share_early_access", _share_sql("written_during_early_access"))
def q_share_ea(spark, sf):
    return stats.sentiment_share_by(reviews(spark, sf), "written_during_early_access")


def _box_sql(value_sql: str) -> str:
    return rnd(f"""{R},
base AS (SELECT voted_up, CAST({value_sql} AS DOUBLE) AS v FROM reviews WHERE {value_sql} IS NOT NULL),
q AS (SELECT voted_up, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM base GROUP BY voted_up)
SELECT CAST(q.voted_up AS BIGINT) AS voted_up, q.n, q.q1, q.median, q.q3,
       min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_low,
       max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high,
       min(v) AS "min", max(v) AS "max"
FROM base JOIN q ON base.voted_up = q.voted_up
GROUP BY q.voted_up, q.n, q.q1, q.median, q.q3""",
               ["q1", "median", "q3", "whisker_low", "whisker_high", "min", "max"])


@register("box_stats_playtime", _box_sql("author_playtime_forever / 60.0"))
def q_box_playtime(spark, sf):
    df = reviews(spark, sf).withColumn("playtime_hours", F.col("author_playtime_forever") / 60.0)
    return stats.box_stats(df, "playtime_hours", "voted_up")


@register("box_stats_length", _box_sql("length(coalesce(review, ''))"))
def q_box_length(spark, sf):
    df = reviews(spark, sf).withColumn("review_length", F.length(F.coalesce("review", F.lit(""))))
    return stats.box_stats(df, "review_length", "voted_up")


@register("histogram_playtime", rnd(f"""{R},
base AS (SELECT app_id, author_playtime_forever / 60.0 AS v FROM reviews
         WHERE author_playtime_forever IS NOT NULL),
rng AS (SELECT app_id, min(v) AS lo, max(v) AS hi FROM base GROUP BY app_id),
counts AS (SELECT base.app_id, CAST(CASE WHEN hi = lo THEN 1
             ELSE least(floor((v - lo) / (hi - lo) * 20) + 1, 20) END AS INTEGER) AS bin,
             count(*) AS n FROM base JOIN rng ON base.app_id = rng.app_id GROUP BY ALL),
grid AS (SELECT app_id, lo, hi, CAST(unnest(range(1, 21)) AS INTEGER) AS bin FROM rng)
SELECT grid.app_id, CAST(grid.bin AS BIGINT) AS bin, lo + (grid.bin - 1) * ((hi - lo) / 20) AS bin_low,
       lo + grid.bin * ((hi - lo) / 20) AS bin_high, coalesce(counts.n, 0) AS n
FROM grid LEFT JOIN counts ON grid.app_id = counts.app_id AND grid.bin = counts.bin""",
                                     ["bin_low", "bin_high"]))
def q_histogram_playtime(spark, sf):
    df = reviews(spark, sf).withColumn("playtime_hours", F.col("author_playtime_forever") / 60.0)
    return stats.histogram(df, "playtime_hours", 20, ["app_id"])


@register("describe_playtime", rnd(f"""{R},
base AS (SELECT app_id, CAST(author_playtime_forever AS DOUBLE) AS v FROM reviews)
SELECT app_id, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS "min",
       quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
       max(v) AS "max"
FROM base GROUP BY app_id""", ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def q_describe_playtime(spark, sf):
    return stats.describe_scores(reviews(spark, sf), "author_playtime_forever", ["app_id"])


@register("pearson_length_playtime", rnd(f"""{R},
base AS (SELECT CAST(length(coalesce(review, '')) AS DOUBLE) AS x,
                CAST(author_playtime_forever AS DOUBLE) AS y FROM reviews
         WHERE review IS NOT NULL AND author_playtime_forever IS NOT NULL AND language = 'en')
SELECT CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 THEN corr(x, y) END AS r, count(*) AS n,
       CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 AND count(*) > 2 AND abs(corr(x, y)) < 1
            THEN corr(x, y) * sqrt((count(*) - 2) / (1 - corr(x, y) * corr(x, y))) END AS t FROM base""",
                                          ["r", "t"]),
          note="p-value checked in tests against a direct computation")
def q_pearson(spark, sf):
    df = reviews(spark, sf).where(F.col("language") == "en").withColumn(
        "review_length", F.length(F.coalesce("review", F.lit(""))))
    df = df.where(F.col("review").isNotNull())
    return stats.pearson_test(df, "review_length", "author_playtime_forever", with_p=False)


@register("point_biserial_playtime", rnd(f"""{R},
base AS (SELECT author_playtime_forever / 60.0 AS x, CAST(voted_up AS DOUBLE) AS y FROM reviews
         WHERE author_playtime_forever IS NOT NULL)
SELECT app_id, CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 THEN corr(x, y) END AS r, count(*) AS n,
       CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 AND count(*) > 2 AND abs(corr(x, y)) < 1
            THEN corr(x, y) * sqrt((count(*) - 2) / (1 - corr(x, y) * corr(x, y))) END AS t
FROM (SELECT app_id, author_playtime_forever / 60.0 AS x, CAST(voted_up AS DOUBLE) AS y
      FROM reviews WHERE author_playtime_forever IS NOT NULL) GROUP BY app_id""", ["r", "t"]))
def q_point_biserial(spark, sf):
    df = reviews(spark, sf).withColumn("playtime_hours", F.col("author_playtime_forever") / 60.0)
    return stats.point_biserial(df, "playtime_hours", "voted_up", ["app_id"], with_p=False)


@register("sentiment_overview", rnd(f"""{R}
SELECT app_id, count(*) AS total, CAST(sum(voted_up) AS BIGINT) AS positive,
       count(*) - CAST(sum(voted_up) AS BIGINT) AS negative,
       sum(voted_up) / count(*) AS positive_share,
       (count(*) - sum(voted_up)) / count(*) AS negative_share
FROM reviews GROUP BY app_id""", ["positive_share", "negative_share"]))
def q_sentiment_overview(spark, sf):
    return stats.sentiment_overview(reviews(spark, sf), ["app_id"])


#: the columns of the ``reviews`` view, as the oracle counts them
_VIEW = ["recommendation_id", "app_id", "language", "review", "timestamp_created", "voted_up",
         "author_playtime_forever", "author_steam_id", "votes_up", "votes_funny", "written_during_early_access",
         "helpful_count", "author_num_reviews", "primarily_steam_deck", "sentiment_score", "detected_language"]


@register("data_quality_summary", f"""{R}
SELECT count(*) AS rows, CAST({len(_VIEW)} AS BIGINT) AS columns,
       CAST(sum({" + ".join(f"({c} IS NULL)::INT" for c in _VIEW)}) AS BIGINT) AS missing_cells,
       CAST(date_diff('day', CAST(to_timestamp(min(timestamp_created)) AT TIME ZONE 'UTC' AS DATE),
                      CAST(to_timestamp(max(timestamp_created)) AT TIME ZONE 'UTC' AS DATE)) AS BIGINT)
         AS date_span_days
FROM reviews""")
def q_data_quality_summary(spark, sf):
    return stats.data_quality_summary(reviews(spark, sf))


# ----------------------------------------------------------------- 2-E time series

@register("daily_trend", rnd(f"""{E}
SELECT app_id, {DAY} AS date, count(*) AS total, CAST(sum(voted_up) AS BIGINT) AS positive,
       sum(voted_up) / count(*) AS positive_rate
FROM review_events GROUP BY ALL""", ["positive_rate"]))
def q_daily_trend(spark, sf):
    return ts.daily_trend(review_events(spark, sf))


@register("daily_stats", rnd(f"""{R}
SELECT app_id, {DAY} AS date, count(*) AS count, CAST(sum(voted_up) AS BIGINT) AS positive,
       round(avg(voted_up), 3) AS mean, round(avg(voted_up) * 100, 1) AS positive_pct
FROM reviews GROUP BY ALL""", ["mean", "positive_pct"]))
def q_daily_stats(spark, sf):
    return ts.daily_stats(reviews(spark, sf))


@register("weekly_sentiment", rnd(f"""{E},
agg AS (SELECT app_id, {WEEK} AS week, count(*) AS total, CAST(sum(voted_up) AS BIGINT) AS positive
        FROM review_events GROUP BY ALL),
cal AS (SELECT app_id, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week
        FROM agg GROUP BY app_id)
SELECT cal.app_id, cal.week, coalesce(positive, 0) AS positive_count, coalesce(total, 0) AS total,
       coalesce(total, 0) - coalesce(positive, 0) AS negative,
       positive / total AS positive_ratio, (total - positive) / total AS negative_ratio
FROM cal LEFT JOIN agg ON cal.app_id = agg.app_id AND cal.week = agg.week""",
                                   ["positive_ratio", "negative_ratio"]))
def q_weekly_sentiment(spark, sf):
    return ts.weekly_sentiment(review_events(spark, sf))


def _temporal_sql(label: str) -> str:
    return rnd(f"""{E}
SELECT app_id, {label} AS bucket, CAST(sum(voted_up) AS BIGINT) AS sum, count(*) AS count,
       round(avg(voted_up), 3) AS mean FROM review_events GROUP BY ALL""", ["mean"])


@register("temporal_trends_daily", _temporal_sql(DAY))
def q_tt_daily(spark, sf):
    return ts.temporal_trends(review_events(spark, sf), "daily")


@register("temporal_trends_weekly", _temporal_sql(WEEK))
def q_tt_weekly(spark, sf):
    return ts.temporal_trends(review_events(spark, sf), "weekly")


@register("temporal_trends_monthly", _temporal_sql(MONTH))
def q_tt_monthly(spark, sf):
    return ts.temporal_trends(review_events(spark, sf), "monthly")


@register("trend_direction", rnd(f"""{R},
t AS (SELECT app_id, {DAY} AS bucket, sum(voted_up) / count(*) AS m FROM reviews GROUP BY ALL)
SELECT app_id, arg_max(m, bucket) AS last_mean, arg_min(m, bucket) AS first_mean,
       CASE WHEN arg_max(m, bucket) > arg_min(m, bucket) THEN 'improving' ELSE 'declining' END AS trend
FROM t GROUP BY app_id""", ["last_mean", "first_mean"]))
def q_trend_direction(spark, sf):
    return ts.trend_direction(reviews(spark, sf), "daily")


PERIOD_FEATURES_D = f"""agg AS (SELECT app_id, {DAY} AS bucket, CAST(sum(voted_up) AS DOUBLE) AS positive,
          CAST(count(*) AS DOUBLE) AS total, avg(CAST(voted_up AS DOUBLE)) AS positive_rate,
          avg(CAST(length(coalesce(review, '')) AS DOUBLE)) AS avg_length,
          CAST(NULL AS DOUBLE) AS avg_sentiment
        FROM reviews GROUP BY ALL),
cal AS (SELECT app_id, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS DATE) AS bucket
        FROM agg GROUP BY app_id),
feat AS (SELECT cal.app_id, cal.bucket, coalesce(positive, 0.0) AS positive,
                coalesce(total, 0.0) AS total, coalesce(positive_rate, 0.0) AS positive_rate,
                coalesce(avg_length, 0.0) AS avg_length, coalesce(avg_sentiment, 0.0) AS avg_sentiment,
                coalesce(total, 0.0) - coalesce(positive, 0.0) AS negative
         FROM cal LEFT JOIN agg ON cal.app_id = agg.app_id AND cal.bucket = agg.bucket)"""


@register("period_features", rnd(f"""{R}, {PERIOD_FEATURES_D}
SELECT * FROM feat""", ["positive", "total", "positive_rate", "avg_length", "avg_sentiment",
                        "negative"]))
def q_period_features(spark, sf):
    return ts.period_features(reviews(spark, sf), "D")


FIT_SQL = """idx AS (SELECT *, CAST(row_number() OVER (PARTITION BY app_id ORDER BY bucket) - 1 AS DOUBLE) AS t
        FROM feat),
g AS (SELECT app_id, count(*) AS n, avg(t) AS tm, max(bucket) AS last_bucket FROM idx GROUP BY app_id),
s AS (SELECT idx.app_id, CAST(count(*) AS DOUBLE) AS s0, sum(t - tm) AS s1, sum((t - tm) ^ 2) AS s2,
             sum((t - tm) ^ 3) AS s3, sum((t - tm) ^ 4) AS s4, sum(positive_rate) AS y0,
             sum((t - tm) * positive_rate) AS y1, sum((t - tm) ^ 2 * positive_rate) AS y2
      FROM idx JOIN g ON idx.app_id = g.app_id GROUP BY idx.app_id),
m AS (SELECT s.*, g.n, g.tm, g.last_bucket,
        s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d,
        y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2) AS da,
        s0 * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s3 * s2) + s2 * (s1 * y2 - y1 * s2) AS db,
        s0 * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2) AS dc
      FROM s JOIN g ON s.app_id = g.app_id WHERE g.n >= 4),
steps AS (SELECT m.*, unnest(range(1, {h} + 1)) AS step FROM m),
pred AS (SELECT app_id, CAST(step AS BIGINT) AS step, {dates} AS date,
           least(greatest(da / d + db / d * (n - 1 + step - tm) + dc / d * (n - 1 + step - tm) ^ 2, 0.0), 1.0)
             AS predicted_rate FROM steps)"""

PERIOD_FEATURES_W = PERIOD_FEATURES_D.replace(DAY, WEEK).replace("INTERVAL 1 DAY", "INTERVAL 7 DAY") \
    .replace("FROM reviews GROUP BY ALL", "FROM review_events GROUP BY ALL") \
    .replace("avg(CAST(length(coalesce(review, '')) AS DOUBLE))", "CAST(NULL AS DOUBLE)")


@register("forecast_rate_weekly", rnd(f"""{E}, {PERIOD_FEATURES_W},
{FIT_SQL.format(h=30, dates="CAST(last_bucket + CAST(step * 7 AS INTEGER) AS DATE)")}
SELECT * FROM pred""", ["predicted_rate"]))
def q_forecast_weekly(spark, sf):
    return ts.forecast_rate(review_events(spark, sf), "W", 30)


PERIOD_FEATURES_ED = PERIOD_FEATURES_D \
    .replace("FROM reviews GROUP BY ALL", "FROM review_events GROUP BY ALL") \
    .replace("avg(CAST(length(coalesce(review, '')) AS DOUBLE))", "CAST(NULL AS DOUBLE)")


@register("forecast_rate_daily", rnd(f"""{E}, {PERIOD_FEATURES_ED},
{FIT_SQL.format(h=7, dates="CAST(last_bucket + CAST(step AS INTEGER) AS DATE)")}
SELECT * FROM pred""", ["predicted_rate"]))
def q_forecast_daily(spark, sf):
    return ts.forecast_rate(review_events(spark, sf), "D", 7)


@register("forecast_trend", rnd(f"""{E}, {PERIOD_FEATURES_W},
{FIT_SQL.format(h=30, dates="CAST(last_bucket + CAST(step * 7 AS INTEGER) AS DATE)")},
h AS (SELECT *, floor(count(*) OVER (PARTITION BY app_id) / 2) AS half FROM pred)
SELECT app_id, count(*) AS horizon, avg(CASE WHEN step <= half THEN predicted_rate END) AS first_half,
       avg(CASE WHEN step > half THEN predicted_rate END) AS second_half,
       CASE WHEN count(*) < 2 THEN 'stable'
            WHEN avg(CASE WHEN step > half THEN predicted_rate END)
               - avg(CASE WHEN step <= half THEN predicted_rate END) > 0.05 THEN 'improving'
            WHEN avg(CASE WHEN step > half THEN predicted_rate END)
               - avg(CASE WHEN step <= half THEN predicted_rate END) < -0.05 THEN 'declining'
            ELSE 'stable' END AS trend
FROM h GROUP BY app_id""", ["first_half", "second_half"]))
def q_forecast_trend(spark, sf):
    return ts.forecast_trend(ts.forecast_rate(review_events(spark, sf), "W", 30))


@register("rate_statistics", rnd(f"""{E}, {PERIOD_FEATURES_W}
SELECT app_id, arg_max(positive_rate, bucket) AS current_rate, avg(positive_rate) AS average_rate,
       stddev_samp(positive_rate) AS volatility, CAST(sum(total) AS BIGINT) AS total_reviews
FROM feat GROUP BY app_id""", ["current_rate", "average_rate", "volatility"]))
def q_rate_statistics(spark, sf):
    return ts.rate_statistics(review_events(spark, sf), "W")


def _anomaly_sql(window: int, thr: float) -> str:
    return rnd(f"""{E},
agg AS (SELECT app_id, {DAY} AS bucket, avg(CAST(voted_up AS DOUBLE)) AS rate FROM review_events GROUP BY ALL),
cal AS (SELECT app_id, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS DATE) AS bucket
        FROM agg GROUP BY app_id),
days AS (SELECT cal.app_id, cal.bucket, coalesce(rate, 0.0) AS rate
         FROM cal LEFT JOIN agg ON cal.app_id = agg.app_id AND cal.bucket = agg.bucket),
w AS (SELECT *, avg(rate) OVER win AS moving_average, stddev_samp(rate) OVER win AS sd,
             count(rate) OVER win AS cnt, count(*) OVER (PARTITION BY app_id) AS ndays
      FROM days WINDOW win AS (PARTITION BY app_id ORDER BY bucket
                               ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))
SELECT app_id, bucket AS date, rate AS positive_rate, moving_average,
       (rate - moving_average) / sd AS z_score,
       CASE WHEN (rate - moving_average) / sd > 0 THEN 'spike' ELSE 'drop' END AS type
FROM w WHERE ndays >= {2 * window} AND cnt = {window} AND sd >= 1e-12
  AND abs((rate - moving_average) / sd) > {thr}""", ["positive_rate", "moving_average", "z_score"])


@register("detect_anomalies", _anomaly_sql(7, 2.0))
def q_detect_anomalies(spark, sf):
    return ts.detect_anomalies(review_events(spark, sf), 7, 2.0)


@register("detect_anomalies_sensitive", _anomaly_sql(7, 1.5))
def q_detect_anomalies_sensitive(spark, sf):
    return ts.detect_anomalies(review_events(spark, sf), 7, 1.5)


@register("steam_deck_counts", f"""{R}
SELECT app_id, CAST(primarily_steam_deck AS BIGINT) AS primarily_steam_deck, count(*) AS n FROM reviews GROUP BY ALL""")
def q_steam_deck_counts(spark, sf):
    return stats.flag_counts(reviews(spark, sf), "primarily_steam_deck", ["app_id"])


@register("get_reviews_sentiment_language", f"""{R}
SELECT recommendation_id, timestamp_created FROM reviews
WHERE (language IN ('fr') OR detected_language IN ('fr')) AND sentiment_score >= -0.5 AND sentiment_score <= 0.7
ORDER BY timestamp_created DESC, recommendation_id""")
def q_get_reviews_sentiment(spark, sf):
    """Sentiment bounds, and a language found in either language column."""
    return scan.get_reviews(reviews(spark, sf), language="fr", sentiment_min=-0.5, sentiment_max=0.7).select(
        "recommendation_id", "timestamp_created")


#: the month-long events spread over two years, so that months have a history
EM = f"""WITH {REVIEW_EVENTS_CTE_SQL.replace("review_events AS", "base_events AS")},
review_events AS (SELECT * REPLACE (timestamp_created + (CAST(recommendation_id AS BIGINT) % 24) * 2629800
                                    AS timestamp_created) FROM base_events)"""
PERIOD_FEATURES_M = PERIOD_FEATURES_ED.replace(DAY, f"CAST(date_trunc('month', {DAY}) AS DATE)") \
    .replace("INTERVAL 1 DAY", "INTERVAL 1 MONTH")


@register("forecast_rate_monthly", rnd(f"""{EM}, {PERIOD_FEATURES_M},
{FIT_SQL.format(h=6, dates="last_day(CAST(last_bucket + to_months(CAST(step AS INTEGER)) AS DATE))")}
SELECT * FROM pred""", ["predicted_rate"]))
def q_forecast_monthly(spark, sf):
    df = review_events(spark, sf).withColumn("timestamp_created", F.col("timestamp_created") + F.pmod(
        F.col("recommendation_id").cast("long"), F.lit(24)) * 2629800)
    return ts.forecast_rate(df, "M", 6)
