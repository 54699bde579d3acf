"""Review recommendation / ranking (2-I)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions.cleaning import round_to

from plaudit.functions import (detail_level, helpfulness, opinion_intensity, recency,
                               recommendation_score, simple_quality, usefulness_category)
from plaudit.operators.quality import _issue_flags, with_segment
from plaudit import lexicons as L
from plaudit.operators.scan import top_n_per_group

Keys = Sequence[str]


def _keys(keys) -> list[str]:
    return [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))


def latest_timestamp(df: DataFrame) -> Column:
    """The data's newest timestamp, used as 'now' for recency: a scalar inside the
    plan (no job runs before the plan does)."""
    return df.agg(F.max("timestamp_created")).scalar()


def score_reviews(df: DataFrame, as_of: int | Column | None = None) -> DataFrame:
    """quality (simple), helpfulness, intensity, recency, detail and the composite
    recommendation score. ``as_of`` replaces the wall clock (default: newest review)."""
    if as_of is None:
        as_of = latest_timestamp(df)
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of)
    d = df.withColumns({
        "quality_score": simple_quality("review", "votes_up"),
        "helpfulness": helpfulness("votes_up", "votes_funny"),
        "opinion_intensity": opinion_intensity("review"),
        "recency": recency("timestamp_created", as_of_col),
        "detail_level": detail_level("review"),
    })
    return d.withColumn("recommendation_score", recommendation_score(
        "quality_score", "helpfulness", "opinion_intensity", "recency", "detail_level"))


def _output(df: DataFrame, ks: list[str]) -> DataFrame:
    def number(name: str) -> Column:
        return (F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)).cast("long")

    author = F.col("author_num_reviews").cast("string") if "author_num_reviews" in df.columns else F.lit(None)
    return df.select(*ks, "rank", "recommendation_id",
                     round_to("recommendation_score", 2).alias("recommendation_score"),
                     round_to("quality_score", 2).alias("quality_score"),
                     F.when(F.col("voted_up") == 1, "Positive").otherwise("Negative").alias("sentiment"),
                     F.coalesce(F.col("votes_up"), F.lit(0)).cast("long").alias("helpful_votes"),
                     number("helpful_count").alias("helpful_count"),
                     F.coalesce(author, F.lit("Unknown")).alias("author"),
                     F.coalesce("review", F.lit("")).alias("review_text"), "author_steam_id",
                     F.coalesce(F.col("author_playtime_forever"), F.lit(0)).cast("long").alias("playtime"),
                     "timestamp_created")


def recommend_reviews(df: DataFrame, top_n: int = 10, sentiment: str | None = None,
                      segment: str | None = None, issue: str | None = None,
                      keys: Keys | None = ("app_id",), as_of=None) -> DataFrame:
    """Top ``top_n`` reviews per app by recommendation score (ties: id). The
    sentiment, segment and issue filters are all applied."""
    ks = _keys(keys)
    d = score_reviews(df, as_of)
    if sentiment in ("positive", "negative"):
        d = d.where(F.col("voted_up") == (1 if sentiment == "positive" else 0))
    if segment is not None:
        d = with_segment(d).where(F.col("segment") == segment)
    if issue is not None:
        names = list(L.ISSUE_CATEGORIES)
        d = _issue_flags(d, L.ISSUE_CATEGORIES).where(F.col(f"_i{names.index(issue)}"))
    top = top_n_per_group(d, ks, [F.col("recommendation_score").desc(), F.col("recommendation_id")],
                          top_n)
    return _output(top, ks)


def recommend_by_category(df: DataFrame, category: str, top_n: int = 5,
                          keys: Keys | None = ("app_id",), as_of=None) -> DataFrame:
    """Top ``top_n`` inside one usefulness category (on the rounded score)."""
    ks = _keys(keys)
    d = score_reviews(df, as_of).withColumn(
        "usefulness", usefulness_category(round_to("recommendation_score", 2)))
    d = d.where(F.col("usefulness") == category)
    top = top_n_per_group(d, ks, [F.col("recommendation_score").desc(), F.col("recommendation_id")],
                          top_n)
    return _output(top, ks)


def contrasting_reviews(df: DataFrame, top_n: int = 5, keys: Keys | None = ("app_id",),
                        as_of=None) -> DataFrame:
    """Best ``top_n`` positive and best ``top_n`` negative reviews per app."""
    ks = _keys(keys)
    d = score_reviews(df, as_of)
    top = top_n_per_group(d, [*ks, "voted_up"],
                          [F.col("recommendation_score").desc(), F.col("recommendation_id")], top_n)
    return _output(top, ks).withColumnRenamed("sentiment", "side")


def recommendation_summary(recs: DataFrame, keys: Keys | None = ("app_id",)) -> DataFrame:
    ks = _keys(keys)
    aggs = [F.count(F.lit(1)).alias("total_recommended"),
            F.avg("quality_score").alias("avg_quality_score"),
            F.avg("recommendation_score").alias("avg_recommendation_score"),
            F.max("helpful_votes").alias("most_helpful"),
            F.avg("helpful_votes").alias("avg_helpful_votes")]
    return recs.groupBy(*ks).agg(*aggs) if ks else recs.agg(*aggs)
