"""Registered queries for versions (2-H), recommendation (2-I), benchmarking (2-J)
and alerts (2-K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions import NON_WS, WS
from plaudit.operators import alerts as al
from plaudit.operators import benchmark as bm
from plaudit.operators import recommend as rc
from plaudit.operators import versions as vs
from plaudit.plans import sqlgen as S
from plaudit.plans.registry import register, rnd
from plaudit.sources.fixtures import REVIEW_EVENTS_CTE_SQL, REVIEWS_CTE_SQL, review_events, reviews

R = f"WITH {REVIEWS_CTE_SQL}"
T = S.text()
LOW = S.low()
DAY = "CAST(to_timestamp(timestamp_created) AT TIME ZONE 'UTC' AS DATE)"
WEEK = f"CAST(date_trunc('week', {DAY}) AS DATE) + 6"


def _versions_sql() -> str:
    parts = [f"regexp_extract_all({T}, {S.q('(?i)' + p)}, 1)" for p in L.VERSION_PATTERNS]
    near = []
    for kw in L.UPDATE_KEYWORDS_EN:
        p0 = f"(instr({LOW}, {S.q(kw)}) - 1)"
        s0 = f"greatest({p0} - 50, 0)"
        e0 = f"least(length({T}), {p0} + 100)"
        m = f"regexp_extract(substring({T}, {s0} + 1, {e0} - {s0}), '\\d+\\.\\d+', 0)"
        near.append(f"CASE WHEN {p0} >= 0 AND {m} <> '' THEN {m} END")
    allv = parts[0]
    for p in parts[1:]:
        allv = f"list_concat({allv}, {p})"
    allv = f"list_concat({allv}, list_filter([{', '.join(near)}], lambda x: x IS NOT NULL))"
    return f"list_distinct({allv})"


MENTIONS = f"""mentions AS (SELECT recommendation_id, app_id, timestamp_created, voted_up,
                      unnest({_versions_sql()}) AS version FROM reviews)"""


@register("detect_versions", f"""{R}, {MENTIONS}
SELECT recommendation_id, app_id, timestamp_created, CAST(voted_up AS BIGINT) AS voted_up, version
FROM mentions""")
def q_detect_versions(spark, sf):
    return vs.detect_versions(reviews(spark, sf))


@register("sentiment_by_version", rnd(f"""{R}, {MENTIONS}
SELECT app_id, version, CAST(sum(voted_up) AS BIGINT) AS positive, count(*) AS total,
       count(*) - CAST(sum(voted_up) AS BIGINT) AS negative,
       sum(voted_up) / count(*) * 100 AS satisfaction_rate FROM mentions GROUP BY ALL""",
                                      ["satisfaction_rate"]))
def q_sentiment_by_version(spark, sf):
    return vs.sentiment_by_version(vs.detect_versions(reviews(spark, sf)))


@register("version_summary", rnd(f"""{R}, {MENTIONS}
SELECT app_id, version, CAST(sum(voted_up) AS BIGINT) AS positive, count(*) AS total,
       count(*) - CAST(sum(voted_up) AS BIGINT) AS negative,
       round(sum(voted_up) / count(*) * 100, 2) AS satisfaction_rate FROM mentions GROUP BY ALL""",
                                 ["satisfaction_rate"]))
def q_version_summary(spark, sf):
    return vs.version_summary(vs.detect_versions(reviews(spark, sf)))


@register("trending_versions", f"""{R}, {MENTIONS}
SELECT * FROM (SELECT app_id, version, count(*) AS mentions,
                      CAST(row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, version) AS BIGINT) AS rank
               FROM mentions GROUP BY app_id, version) WHERE rank <= 10""")
def q_trending_versions(spark, sf):
    return vs.trending_versions(vs.detect_versions(reviews(spark, sf)), 10)


@register("version_over_time", rnd(f"""{R}, {MENTIONS},
top AS (SELECT app_id, version FROM (SELECT app_id, version,
          row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, version) AS r
          FROM mentions GROUP BY app_id, version) WHERE r <= 5),
agg AS (SELECT m.app_id, m.version, {WEEK.replace('timestamp_created', 'm.timestamp_created')} AS bucket,
               CAST(sum(voted_up) AS BIGINT) AS positive, count(*) AS total
        FROM mentions m SEMI JOIN top ON m.app_id = top.app_id AND m.version = top.version GROUP BY ALL),
cal AS (SELECT app_id, version, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 7 DAY)) AS DATE) AS bucket
        FROM agg GROUP BY app_id, version)
SELECT cal.app_id, cal.version, cal.bucket, coalesce(positive, 0) AS positive, coalesce(total, 0) AS total,
       CASE WHEN coalesce(total, 0) > 0 THEN positive / total ELSE 0.0 END AS rate
FROM cal LEFT JOIN agg ON cal.app_id = agg.app_id AND cal.version = agg.version AND cal.bucket = agg.bucket""",
                                   ["rate"]))
def q_version_over_time(spark, sf):
    return vs.version_over_time(vs.detect_versions(reviews(spark, sf)), "W", 5)


def _impact_sql(window_days: int) -> str:
    w = window_days * 86400
    return rnd(f"""{R}, {MENTIONS},
per AS (SELECT m.app_id, m.version,
          (SELECT avg(r.voted_up) * 100 FROM reviews r WHERE r.app_id = m.app_id
             AND r.timestamp_created >= m.timestamp_created - {w} AND r.timestamp_created < m.timestamp_created) AS before_rate,
          (SELECT avg(r.voted_up) * 100 FROM reviews r WHERE r.app_id = m.app_id
             AND r.timestamp_created > m.timestamp_created AND r.timestamp_created <= m.timestamp_created + {w}) AS after_rate
        FROM mentions m)
SELECT app_id, version, count(*) AS mentions, avg(before_rate) AS before_avg, avg(after_rate) AS after_avg,
       avg(after_rate) - avg(before_rate) AS impact FROM per GROUP BY ALL""",
               ["before_avg", "after_avg", "impact"])


@register("update_impact", _impact_sql(7))
def q_update_impact(spark, sf):
    return vs.update_impact(reviews(spark, sf), 7)


@register("update_impact_1h", _impact_sql(1))
def q_update_impact_short(spark, sf):
    """One-day window with one-hour chunks: exercises probes in chunks without reviews."""
    return vs.update_impact(reviews(spark, sf), 1, block_s=600)


@register("version_keywords", f"""{R},
v AS (SELECT app_id, {_versions_sql()} AS versions, {S.tokens_en(S.clean())} AS tokens FROM reviews),
pairs AS (SELECT app_id, version, unnest(tokens) AS word FROM (
            SELECT app_id, unnest(versions) AS version, tokens FROM v WHERE len(versions) > 0))
SELECT app_id, version, word, count, rank FROM (
  SELECT app_id, version, word, count(*) AS count,
         CAST(row_number() OVER (PARTITION BY app_id, version ORDER BY count(*) DESC, word) AS BIGINT) AS rank
  FROM pairs GROUP BY app_id, version, word) WHERE rank <= 10""")
def q_version_keywords(spark, sf):
    return vs.version_keywords(reviews(spark, sf), 10)


# ------------------------------------------------------------------ 2-I recommendation

def _sentences_sql() -> str:
    return f"len(list_filter(string_split({T}, '.'), lambda s: regexp_matches(s, '{NON_WS}')))"


WC = S.word_count()
SCORES = f"""as_of_t AS (SELECT max(timestamp_created) AS now FROM reviews),
sc AS (SELECT r.*,
   least({WC} / 100 * 50 + coalesce(votes_up, 0) * 5, 100.0) AS quality_score,
   CASE WHEN coalesce(votes_up, 0) + coalesce(votes_funny, 0) = 0 THEN 0.0
        ELSE least(coalesce(votes_up, 0) / greatest(coalesce(votes_up, 0) + coalesce(votes_funny, 0), 1), 1.0) END
     AS helpfulness,
   least({S.count_contained(LOW, L.STRONG_WORDS_RECOMMEND, distinct=False)} / 5.0, 1.0) AS opinion_intensity,
   CASE WHEN timestamp_created IS NULL OR timestamp_created = 0 THEN 0.5
        WHEN (now - timestamp_created) / 86400.0 <= 30 THEN 1.0
        WHEN (now - timestamp_created) / 86400.0 <= 90 THEN 0.8 - ((now - timestamp_created) / 86400.0 - 30) / 60 * 0.3
        WHEN (now - timestamp_created) / 86400.0 <= 365 THEN 0.5 - ((now - timestamp_created) / 86400.0 - 90) / 275 * 0.3
        ELSE 0.2 END AS recency,
   CASE WHEN {T} = '' THEN 0.0 ELSE least(least({WC} / 500.0, 1.0) * 0.5
        + least(({WC} / greatest({_sentences_sql()}, 1)) / 20.0, 1.0) * 0.5, 1.0) END AS detail_level
  FROM reviews r, as_of_t),
scored AS (SELECT *, (quality_score / 100.0 * 0.35 + helpfulness * 0.25 + opinion_intensity * 0.15
                      + recency * 0.15 + detail_level * 0.1) * 100 AS recommendation_score FROM sc)"""

OUT = """rank, recommendation_id, round(recommendation_score, 2) AS recommendation_score,
  round(quality_score, 2) AS quality_score, CASE WHEN voted_up = 1 THEN 'Positive' ELSE 'Negative' END AS {s},
  CAST(coalesce(votes_up, 0) AS BIGINT) AS helpful_votes, CAST(helpful_count AS BIGINT) AS helpful_count,
  CAST(author_num_reviews AS VARCHAR) AS author, coalesce(review, '') AS review_text, author_steam_id,
  CAST(trunc(coalesce(author_playtime_forever, 0)) AS BIGINT) AS playtime, timestamp_created"""


def _rec_sql(where: str = "true", n: int = 10, part: str = "app_id", side: str = "sentiment") -> str:
    return rnd(f"""{R}, {SCORES}
SELECT app_id, {OUT.format(s=side)} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY recommendation_score DESC,
                                    recommendation_id) AS BIGINT) AS rank
  FROM scored WHERE {where}) WHERE rank <= {n}""", ["recommendation_score", "quality_score"])


@register("review_scores", rnd(f"""{R}, {SCORES}
SELECT recommendation_id, quality_score, helpfulness, opinion_intensity, recency, detail_level,
       recommendation_score FROM scored""", ["quality_score", "helpfulness", "opinion_intensity", "recency",
                                             "detail_level", "recommendation_score"]))
def q_review_scores(spark, sf):
    return rc.score_reviews(reviews(spark, sf)).select(
        "recommendation_id", "quality_score", "helpfulness", "opinion_intensity", "recency",
        "detail_level", "recommendation_score")


@register("recommend_reviews", _rec_sql())
def q_recommend_reviews(spark, sf):
    return rc.recommend_reviews(reviews(spark, sf), 10)


@register("recommend_reviews_negative", _rec_sql("voted_up = 0", 5))
def q_recommend_negative(spark, sf):
    return rc.recommend_reviews(reviews(spark, sf), 5, sentiment="negative")


@register("recommend_reviews_segment", _rec_sql(
    f"voted_up = 1 AND ({WC} > 20 AND {WC} <= 100 OR {WC} < 20)", 5))
def q_recommend_segment(spark, sf):
    return rc.recommend_reviews(reviews(spark, sf), 5, segment="Satisfied")


@register("recommend_by_category", _rec_sql(
    "round(recommendation_score, 2) >= 40 AND round(recommendation_score, 2) < 60", 5))
def q_recommend_by_category(spark, sf):
    return rc.recommend_by_category(reviews(spark, sf), "Moderately Useful", 5)


@register("contrasting_reviews", _rec_sql("true", 5, "app_id, voted_up", "side"))
def q_contrasting_reviews(spark, sf):
    return rc.contrasting_reviews(reviews(spark, sf), 5)


@register("recommendation_summary", rnd(f"""WITH recs AS ({_rec_sql()})
SELECT app_id, count(*) AS total_recommended, avg(quality_score) AS avg_quality_score,
       avg(recommendation_score) AS avg_recommendation_score, max(helpful_votes) AS most_helpful,
       avg(helpful_votes) AS avg_helpful_votes FROM recs GROUP BY app_id""",
                                        ["avg_quality_score", "avg_recommendation_score", "avg_helpful_votes"]))
def q_recommendation_summary(spark, sf):
    return rc.recommendation_summary(rc.recommend_reviews(reviews(spark, sf), 10))


# ------------------------------------------------------------------ 2-J benchmarking

def _bench_sql() -> str:
    groups = list(L.BENCHMARK_ISSUES.values())
    gcols = ", ".join(f"count_if({S.any_contained(LOW, ws)}) AS g{i}" for i, ws in enumerate(groups))
    tot = " + ".join(f"g{i}" for i in range(len(groups)))
    ent = " + ".join(f"CASE WHEN g{i} > 0 THEN -(g{i} / ({tot})) * ln(g{i} / ({tot}) + 1e-10) ELSE 0 END"
                     for i in range(len(groups)))
    toks = f"regexp_split_to_array({LOW}, '[{WS}]+')"
    return f"""{R},
g AS (SELECT app_id, count(*) AS total_reviews, sum(CASE WHEN voted_up = 1 THEN 1 ELSE 0 END) / count(*) * 100 AS positive_rate,
        avg(least({WC} / 100 * 50 + coalesce(votes_up, 0) * 5, 100.0)) AS q,
        avg(coalesce(CAST(votes_up AS DOUBLE), 0.0)) AS v,
        avg(least({S.count_contained(LOW, L.STRONG_WORDS_BENCHMARK, distinct=False)}, 5) / 5.0 * 100) AS si,
        {gcols} FROM reviews GROUP BY app_id),
w AS (SELECT app_id, least(count(DISTINCT word), 100) AS tv FROM (
        SELECT app_id, unnest(list_filter({toks}, lambda x: length(x) > 3)) AS word FROM reviews) GROUP BY app_id),
bench AS (SELECT g.app_id, total_reviews, positive_rate, round(q, 2) AS avg_quality_score,
        round(CASE WHEN ({tot}) > 0 THEN least(({ent}) / ln(6), 1.0) ELSE 0.0 END, 2) AS issue_diversity,
        round(positive_rate * 0.7 + q / 100.0 * 100 * 0.3, 2) AS player_satisfaction,
        round(least(v / 10 * 100, 100.0), 2) AS review_engagement, round(si, 2) AS sentiment_intensity,
        round(coalesce(CAST(tv AS DOUBLE), 0.0), 2) AS topic_variety
      FROM g LEFT JOIN w ON g.app_id = w.app_id)"""


DIMS = L.BENCHMARK_DIMENSIONS
BENCH_DOUBLES = DIMS


@register("benchmark_games", rnd(f"{_bench_sql()} SELECT * FROM bench", BENCH_DOUBLES))
def q_benchmark_games(spark, sf):
    return bm.benchmark_games(reviews(spark, sf))


RANKS = ", ".join(f"rank() OVER (ORDER BY {d} DESC) + (count(*) OVER (PARTITION BY {d}) - 1) / 2.0 AS {d}_rank"
                  for d in DIMS)


@register("rank_games", rnd(f"{_bench_sql()} SELECT *, {RANKS} FROM bench",
                            BENCH_DOUBLES + [f"{d}_rank" for d in DIMS]))
def q_rank_games(spark, sf):
    return bm.rank_games(bm.benchmark_games(reviews(spark, sf)))


PCTS = ", ".join(f"(rank() OVER (ORDER BY {d}) - 1) / count(*) OVER () * 100.0 AS {d}_percentile"
                 for d in DIMS)


@register("game_percentiles", rnd(f"{_bench_sql()} SELECT *, {PCTS} FROM bench",
                                  BENCH_DOUBLES + [f"{d}_percentile" for d in DIMS]))
def q_game_percentiles(spark, sf):
    return bm.game_percentiles(bm.benchmark_games(reviews(spark, sf)))


def _sw_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT app_id, '{d}' AS dimension, CAST({i} AS BIGINT) AS dim_order, {d}_rank AS rank, n FROM ranked"
                              for i, d in enumerate(DIMS))
    return rnd(f"""{_bench_sql()}, ranked AS (SELECT *, {RANKS}, count(*) OVER () AS n FROM bench),
long AS ({rows})
SELECT app_id, dimension, dim_order, rank,
       CASE WHEN rank <= n / 2 OR rank = 1 THEN 'strength' ELSE 'weakness' END AS kind,
       CASE WHEN rank = 1 THEN 'Best ' || replace(dimension, '_', ' ')
            WHEN rank <= n / 2 THEN 'Above average ' || replace(dimension, '_', ' ')
            ELSE 'Below average ' || replace(dimension, '_', ' ') END AS text FROM long""", ["rank"])


@register("strengths_weaknesses", _sw_sql())
def q_strengths_weaknesses(spark, sf):
    return bm.strengths_weaknesses(bm.rank_games(bm.benchmark_games(reviews(spark, sf))))


# ------------------------------------------------------------------ 2-K alerts

E = f"WITH {REVIEW_EVENTS_CTE_SQL}"
ALERT_STATS = f"""agg AS (SELECT app_id, {DAY} AS bucket, count(*) AS total, CAST(sum(voted_up) AS BIGINT) AS positive
        FROM review_events GROUP BY ALL),
cal AS (SELECT app_id, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS DATE) AS bucket
        FROM agg GROUP BY app_id),
st AS (SELECT cal.app_id, cal.bucket, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive,
              coalesce(total, 0) - coalesce(positive, 0) AS recent_negative
       FROM cal LEFT JOIN agg ON cal.app_id = agg.app_id AND cal.bucket = agg.bucket),
stats AS (SELECT *, avg(recent_negative) OVER (PARTITION BY app_id ORDER BY bucket
                                               ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS avg_negative FROM st)"""


@register("alert_stats", rnd(f"""{E}, {ALERT_STATS} SELECT * FROM stats""", ["avg_negative"]))
def q_alert_stats(spark, sf):
    return al.alert_stats(review_events(spark, sf), "D", 7)


@register("evaluate_alerts", rnd(f"""{E}, {ALERT_STATS},
fired AS (
  SELECT app_id, bucket, 'low_rating' AS rule, 'positive_rate_below' AS condition,
         printf('Warning: Positive rate (%.1f%%) dropped below 50%%', round(positive / total * 100, 1)) AS message,
         total, positive, recent_negative, avg_negative
  FROM stats WHERE total > 0 AND positive / total < 0.8
  UNION ALL
  SELECT app_id, bucket, 'negative_spike', 'negative_reviews_spike',
         printf('Warning: Negative reviews spike detected (recent: %d, avg: %.1f)', recent_negative,
                round(coalesce(avg_negative, 1.0), 1)),
         total, positive, recent_negative, avg_negative
  FROM stats WHERE recent_negative > coalesce(avg_negative, 1.0) * 1.2
  UNION ALL
  SELECT app_id, bucket, 'no_reviews', 'total_reviews_below',
         printf('Warning: Very few reviews collected (%d)', total), total, positive, recent_negative, avg_negative
  FROM stats WHERE total < 20)
SELECT * FROM fired""", ["avg_negative"]))
def q_evaluate_alerts(spark, sf):
    """Default rules with thresholds tuned so every rule fires on the test stream."""
    rules = [(n, c, {"positive_rate_below": 0.8, "negative_reviews_spike": 1.2,
                     "total_reviews_below": 20.0}[c], m) for n, c, _t, m in L.DEFAULT_ALERT_RULES]
    return al.evaluate_alerts(al.alert_stats(review_events(spark, sf), "D", 7), rules)


@register("evaluate_alerts_custom_message", f"""{E}, {ALERT_STATS}
SELECT app_id, bucket, 'rate' AS rule,
       printf('%.0f%% of 100%% in app', round(positive / total * 100, 0)) AS message
FROM stats WHERE total > 0 AND positive / total < 0.85
UNION ALL
SELECT app_id, bucket, 'few', printf('{{%d}} reviews', total) FROM stats WHERE total < 25""")
def q_evaluate_alerts_custom(spark, sf):
    """Rules with texts of their own."""
    rules = [("rate", "positive_rate_below", 0.85, "{rate:.0f}% of 100% in app"),
             ("few", "total_reviews_below", 25, "{{{total}}} reviews")]
    return al.evaluate_alerts(al.alert_stats(review_events(spark, sf), "D", 7), rules).select(
        "app_id", "bucket", "rule", "message")


@register("recommend_reviews_issue", _rec_sql(S.any_contained(LOW, list(L.ISSUE_CATEGORIES.values())[0])))
def q_recommend_issue(spark, sf):
    """Only reviews that mention the first issue category."""
    return rc.recommend_reviews(reviews(spark, sf), 10, issue=list(L.ISSUE_CATEGORIES)[0])
