"""Filtered scans, point lookups, sorted limits and per-app top-N (2-C)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.functions import text_or_empty

#: projection of the list endpoint
REVIEW_FIELDS = ["recommendation_id", "app_id", "language", "review", "voted_up",
                 "timestamp_created"]


def get_reviews(df: DataFrame, app_id: str | None = None, limit: int | None = None,
                start: int | None = None, end: int | None = None,
                min_playtime: float | None = None, max_playtime: float | None = None,
                language: str | Sequence[str] | None = None,
                sentiment_min: float | None = None, sentiment_max: float | None = None,
                voted_up: bool | None = None,
                playtime_col: str = "author_playtime_forever") -> DataFrame:
    """Conjunction of optional, inclusive predicates; newest first; optional limit.

    Bounds are compared with ``is not None`` (a 0 bound is a real bound). Playtime
    bounds are in hours and the stored column is in minutes. All predicates are
    plain column comparisons, so Catalyst pushes them into the Parquet scan and a
    table partitioned by ``app_id`` is pruned to one folder.
    """
    cond = F.lit(True)
    if app_id is not None:
        cond = cond & (F.col("app_id") == str(app_id))
    if start is not None:
        cond = cond & (F.col("timestamp_created") >= start)
    if end is not None:
        cond = cond & (F.col("timestamp_created") <= end)
    if min_playtime is not None:
        cond = cond & (F.col(playtime_col) >= float(min_playtime) * 60)
    if max_playtime is not None:
        cond = cond & (F.col(playtime_col) <= float(max_playtime) * 60)
    if language is not None:
        langs = [language] if isinstance(language, str) else list(language)
        lc = F.col("language").isin(langs)
        if "detected_language" in df.columns:
            lc = lc | F.col("detected_language").isin(langs)
        cond = cond & lc
    if sentiment_min is not None:
        cond = cond & (F.col("sentiment_score") >= sentiment_min)
    if sentiment_max is not None:
        cond = cond & (F.col("sentiment_score") <= sentiment_max)
    if voted_up is not None:
        cond = cond & (F.col("voted_up") == (1 if voted_up else 0))
    out = df.filter(cond).orderBy(F.col("timestamp_created").desc(), F.col("recommendation_id"))
    return out.limit(limit) if limit is not None else out


def get_review(df: DataFrame, recommendation_id: str) -> DataFrame:
    return df.filter(F.col("recommendation_id") == str(recommendation_id))


def list_reviews(df: DataFrame, app_id: str | None = None, limit: int = 10,
                 language: str | None = None, offset: int = 0) -> DataFrame:
    """REST list: filter first (the original over-fetched, then filtered), newest first.
    ``language`` is the store language alone; only ``get_reviews`` also takes the
    detected one."""
    if language is not None:
        df = df.where(F.col("language") == language)
    out = get_reviews(df, app_id=app_id).select(*REVIEW_FIELDS)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                    rank_col: str = "rank") -> DataFrame:
    """Top ``n`` rows per group by ``order``.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so each map task forwards at most ``n`` rows per group: a hot group
    (say a third of all rows) never reaches one task whole.
    """
    if not keys:
        # global top-n: TakeOrderedAndProject keeps n rows per partition, then the
        # rank is numbered over the n survivors only
        top = df.orderBy(*order).limit(n)
        return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def latest_per_app(df: DataFrame, limit: int = 10, app_ids: Sequence[str] | None = None) -> DataFrame:
    if app_ids is not None:
        df = df.filter(F.col("app_id").isin(list(app_ids)))
    return top_n_per_group(df, ["app_id"], [F.col("timestamp_created").desc(),
                                            F.col("recommendation_id")], limit)


def recent_votes(df: DataFrame, n: int = 100) -> DataFrame:
    """Last ``n`` reviews by time, returned oldest first."""
    last = df.orderBy(F.col("timestamp_created").desc(), F.col("recommendation_id").desc()).limit(n)
    return last.orderBy("timestamp_created", "recommendation_id")


def preview(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    cols = [c for c in (cols or df.columns) if c in df.columns]
    return df.select(*cols).limit(n)


def truncate_text(c, width: int = 200):
    t = text_or_empty(c)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)


def vote_samples(df: DataFrame, k: int = 3, width: int = 200,
                 keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """First ``k`` positive and ``k`` negative reviews per app, text cut to ``width``."""
    out = top_n_per_group(df, [*keys, "voted_up"], [F.col("timestamp_created"),
                                                    F.col("recommendation_id")], k, "sample_rank")
    return out.select(*keys, "voted_up", "sample_rank", "recommendation_id",
                      truncate_text("review", width).alias("review_excerpt"))


def top_reviews(df: DataFrame, n: int = 5, by: str = "quality_score",
                keys: Sequence[str] | None = ("app_id",)) -> DataFrame:
    """Top ``n`` reviews by a score (ties: id ascending), per app or overall."""
    order = [F.col(by).desc(), F.col("recommendation_id")]
    cols = ["recommendation_id", "review", by, "voted_up"]
    if keys:
        return top_n_per_group(df, list(keys), order, n).select(*keys, "rank", *cols)
    return df.orderBy(*order).limit(n).select(*cols)
