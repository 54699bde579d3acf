"""Registered queries for the report bundles (2-G, 2-H) and the p-values of the
correlation tests (2-D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.operators import reports as rp
from plaudit.operators import stats
from plaudit.plans import sqlgen as S
from plaudit.plans.q_analytics import DAY, MENTIONS, WEEK
from plaudit.plans.q_enrich import INTENSITY_LISTS, LOW, QUALITY, SEGMENT_SQL, TEST_ISSUES, _intensity_sql
from plaudit.plans.registry import register, rnd
from plaudit.sources.fixtures import REVIEWS_CTE_SQL, reviews

R = f"WITH {REVIEWS_CTE_SQL}"
_I = _intensity_sql(INTENSITY_LISTS)


def _comprehensive_sql(categories: dict) -> str:
    flags = ", ".join(f"{S.any_contained(LOW, ws)} AS i{k}" for k, ws in enumerate(categories.values()))
    none = "CAST(NULL AS BIGINT)"
    issues = " UNION ALL ".join(
        f"SELECT app_id, 'issue', {S.q(c)}, count_if(i{k}), {none}, count_if(i{k}) / count(*) * 100 FROM e GROUP BY app_id"
        for k, c in enumerate(categories))
    segments = " UNION ALL ".join(
        f"SELECT app_id, 'segment', {S.q(s)}, count_if(seg = {S.q(s)}), {none}, count_if(seg = {S.q(s)}) / count(*) * 100 "
        "FROM e GROUP BY app_id" for s in L.SEGMENTS)
    values = {"quality": {"mean": "avg(q)", "std": "stddev_samp(q)", "min": "min(q)", "p25": "quantile_cont(q, 0.25)",
                          "p50": "quantile_cont(q, 0.5)", "p75": "quantile_cont(q, 0.75)", "max": "max(q)"},
              "comparison": {"total_words": "sum(w)", "avg_words": "avg(w)", "positive_rate": "avg(voted_up) * 100",
                             "avg_quality_score": "avg(q)"}}
    rest = " UNION ALL ".join(
        f"SELECT app_id, '{s}', '{k}', count(*), {none}, CAST({v} AS DOUBLE) FROM e GROUP BY app_id"
        for s, vs in values.items() for k, v in vs.items())
    return rnd(f"""{R},
e AS (SELECT app_id, voted_up, {DAY} AS d, {S.word_count()} AS w, CAST({QUALITY} AS DOUBLE) AS q, {SEGMENT_SQL} AS seg,
             CASE WHEN {_I} >= 2 THEN 'Very Positive' WHEN {_I} >= 0 THEN 'Positive'
                  WHEN {_I} >= -2 THEN 'Negative' ELSE 'Very Negative' END AS il, {flags} FROM reviews)
SELECT app_id, 'trend' AS section, CAST(d AS VARCHAR) AS item, count(*) AS count, CAST(sum(voted_up) AS BIGINT) AS positive,
       round(avg(voted_up), 3) AS value FROM e GROUP BY app_id, d
UNION ALL SELECT app_id, 'intensity', il, count(*), {none},
       round(count(*) / sum(count(*)) OVER (PARTITION BY app_id) * 100, 2) FROM e GROUP BY app_id, il
UNION ALL {issues} UNION ALL {segments} UNION ALL {rest}""", ["value"])


@register("comprehensive_report", _comprehensive_sql(L.ISSUE_CATEGORIES))
def q_comprehensive_report(spark, sf):
    """All sections of the report from one grouped pass."""
    return rp.comprehensive_table(reviews(spark, sf))


@register("comprehensive_report_test_lexicon", _comprehensive_sql(TEST_ISSUES))
def q_comprehensive_report_test(spark, sf):
    return rp.comprehensive_table(reviews(spark, sf), categories=TEST_ISSUES)


@register("version_report", rnd(f"""{R}, {MENTIONS},
v AS (SELECT app_id, version, CAST(sum(voted_up) AS BIGINT) AS positive, count(*) AS total,
             CAST(row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, version) AS BIGINT) AS rank
      FROM mentions GROUP BY app_id, version),
k AS (SELECT m.app_id, m.version, rank, {WEEK.replace('timestamp_created', 'm.timestamp_created')} AS week,
             CAST(sum(voted_up) AS BIGINT) AS positive, count(*) AS total
      FROM mentions m JOIN v ON m.app_id = v.app_id AND m.version = v.version AND rank <= 5 GROUP BY ALL),
cal AS (SELECT app_id, version, rank, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week
        FROM k GROUP BY app_id, version, rank)
SELECT app_id, version, 'version' AS section, CAST(NULL AS DATE) AS week, positive, total, positive / total AS rate, rank FROM v
UNION ALL
SELECT cal.app_id, cal.version, 'week', cal.week, coalesce(positive, 0), coalesce(total, 0),
       CASE WHEN total > 0 THEN positive / total ELSE 0 END, cal.rank
FROM cal LEFT JOIN k ON k.app_id = cal.app_id AND k.version = cal.version AND k.week = cal.week""", ["rate"]))
def q_version_report(spark, sf):
    """Versions with their rank and the weeks of the top ones from one grouped pass."""
    return rp.version_table(reviews(spark, sf))


def _p_sql(r: str, n: str) -> str:
    """Two-sided p-value of Student's t with n - 2 degrees of freedom. With t =
    sqrt(df) tan(a) the tail is an integral of cos(a)^(df - 1); Simpson's rule over 2,000
    panels."""
    k = f"({n} - 2)"
    top = f"asin(least(abs({r}), 1.0))"  # tan(a) = |t| / sqrt(df) <=> sin(a) = |r|
    area = (f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
            f" * pow(cos({top} * i / 2000), {k} - 1))) * {top} / 6000")
    unit = f"exp(lgamma(({k} + 1) / 2.0) - lgamma({k} / 2.0)) / sqrt(pi())"
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN abs({r}) >= 1 THEN 0.0 WHEN {n} > 2 THEN greatest(1 - 2 * {unit} * {area}, 0) END"


def _correlation_sql(keys: str, rows: str) -> str:
    by = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return rnd(f"""{R},
b AS ({rows}),
c AS (SELECT {lead}CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 THEN corr(x, y) END AS r, count(*) AS n FROM b {by})
SELECT {lead}r, n, CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t,
       {_p_sql("r", "n")} AS p_value FROM c""", ["r", "t", "p_value"])


@register("pearson_votes_quality_p", _correlation_sql("", """SELECT CAST(votes_up AS DOUBLE) AS x, sentiment_score AS y
  FROM reviews WHERE votes_up IS NOT NULL AND sentiment_score IS NOT NULL"""))
def q_pearson_p(spark, sf):
    """Correlation of two columns over all reviews with its p-value."""
    return stats.pearson_test(reviews(spark, sf), "votes_up", "sentiment_score")


@register("point_biserial_playtime_p", _correlation_sql("app_id", """SELECT app_id, author_playtime_forever / 60.0 AS x,
  CAST(voted_up AS DOUBLE) AS y FROM reviews WHERE author_playtime_forever IS NOT NULL"""))
def q_point_biserial_p(spark, sf):
    df = reviews(spark, sf).withColumn("playtime_hours", F.col("author_playtime_forever") / 60.0)
    return stats.point_biserial(df, "playtime_hours", "voted_up", ["app_id"])
