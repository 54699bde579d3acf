"""Review intensity, quality, issues and player segments (2-G) and the bundled
comprehensive report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions import (any_contained, intensity_label, intensity_score, lower_text,
                               quality_score, segment, text_or_empty, word_count)
from plaudit.operators import stats, timeseries
from plaudit.operators.scan import top_n_per_group, top_reviews

Keys = Sequence[str]


def _keys(keys) -> list[str]:
    return [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))


def with_intensity(df: DataFrame, lists=None) -> DataFrame:
    s = intensity_score("review", "voted_up", lists)
    return df.withColumn("intensity_score", s).withColumn(
        "sentiment_intensity", intensity_label("intensity_score"))


def sentiment_intensity(df: DataFrame, keys: Keys | None = None, lists=None) -> DataFrame:
    """Distribution (n, pct) of the four intensity labels."""
    return stats.label_distribution(with_intensity(df, lists), "sentiment_intensity", keys)


def with_quality(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_score", quality_score("review", "voted_up"))


def _issue_flags(df: DataFrame, categories: dict) -> DataFrame:
    d = df.withColumn("_low", lower_text("review"))
    return d.withColumns({f"_i{i}": any_contained(F.col("_low"), ws)
                          for i, ws in enumerate(categories.values())})


def detect_issues(df: DataFrame, keys: Keys | None = None, categories: dict | None = None,
                  only_present: bool = False) -> DataFrame:
    """Per issue category: reviews mentioning it and % of all reviews."""
    ks = _keys(keys)
    categories = categories or L.ISSUE_CATEGORIES
    d = _issue_flags(df, categories)
    aggs = [F.count(F.lit(1)).alias("_total")] + [F.count_if(f"_i{i}").alias(f"_c{i}")
                                                   for i in range(len(categories))]
    agg = d.groupBy(*ks).agg(*aggs) if ks else d.agg(*aggs)
    st = F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(f"_c{i}").alias("count"),
                                      (F.col(f"_c{i}") / F.col("_total") * 100).alias("pct"))
                             for i, n in enumerate(categories)]))
    out = agg.select(*ks, st.alias("_s")).select(*ks, "_s.*")
    return out.where(F.col("count") > 0) if only_present else out


def issue_samples(df: DataFrame, k: int = 3, width: int = 100, keys: Keys | None = None,
                  categories: dict | None = None) -> DataFrame:
    """First ``k`` reviews (time, id order) per issue: lower-cased, first 100 chars."""
    ks = _keys(keys)
    categories = categories or L.ISSUE_CATEGORIES
    d = _issue_flags(df, categories)
    hits = F.filter(F.array(*[F.when(F.col(f"_i{i}"), F.lit(n)) for i, n in enumerate(categories)]),
                    lambda x: x.isNotNull())
    e = d.select(*ks, "recommendation_id", "timestamp_created", "_low", F.explode(hits).alias("issue"))
    top = top_n_per_group(e, [*ks, "issue"], [F.col("timestamp_created"), F.col("recommendation_id")],
                          k, "sample_rank")
    return top.select(*ks, "issue", "sample_rank", "recommendation_id",
                      F.substring("_low", 1, width).alias("sample"))


def with_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", segment("voted_up", word_count("review")))


def segment_players(df: DataFrame, keys: Keys | None = None) -> DataFrame:
    """Counts and % per segment (all five segments, zero kept)."""
    ks = _keys(keys)
    d = with_segment(df)
    aggs = [F.count(F.lit(1)).alias("_total")] + [F.count_if(F.col("segment") == s).alias(f"_s{i}")
                                                   for i, s in enumerate(L.SEGMENTS)]
    agg = d.groupBy(*ks).agg(*aggs) if ks else d.agg(*aggs)
    st = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.col(f"_s{i}").alias("count"),
                                      (F.col(f"_s{i}") / F.col("_total") * 100).alias("pct"))
                             for i, s in enumerate(L.SEGMENTS)]))
    return agg.select(*ks, st.alias("_x")).select(*ks, "_x.*")


def segment_samples(df: DataFrame, k: int = 3, keys: Keys | None = None) -> DataFrame:
    ks = _keys(keys)
    d = with_segment(df)
    top = top_n_per_group(d, [*ks, "segment"], [F.col("timestamp_created"), F.col("recommendation_id")],
                          k, "sample_rank")
    return top.select(*ks, "segment", "sample_rank", "recommendation_id")


def enrich_quality(df: DataFrame) -> DataFrame:
    """intensity, quality and segment columns in one projection."""
    return with_segment(with_quality(with_intensity(df)))


def comprehensive_report(df: DataFrame, keys: Keys | None = ("app_id",), persist: bool = True) -> dict:
    """The analyser's bundle as a dict of DataFrames over one enriched frame.

    The enriched frame is persisted (memory+disk, recomputable from lineage if an
    executor is lost) so the seven reports do not re-run the text expressions.
    """
    from pyspark import StorageLevel
    ks = _keys(keys)
    base = enrich_quality(df)
    if persist:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "intensity": stats.label_distribution(base, "sentiment_intensity", ks),
        "quality": stats.describe_scores(base, "quality_score", ks),
        "issues": detect_issues(base, ks),
        "segments": segment_players(base, ks),
        "trends": timeseries.temporal_trends(base, "daily", ks),
        "comparison": stats.comparison_metrics(base, ks),
        "top_reviews": top_reviews(base, 5, "quality_score", ks or None),
        "_base": base,
    }
