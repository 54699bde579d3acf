"""Time series (2-E): calendar buckets, gap filling, trends, forecasts, anomalies, ranks.

All windows here run over *aggregated* per-(app, bucket) rows, so a window
partition holds one app's calendar (days/weeks), never its raw reviews.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaudit.functions.cleaning import round_to

Keys = Sequence[str]

FREQ_STEP = {"D": "1 day", "W": "7 days", "M": "1 month"}


def _keys(keys) -> list[str]:
    return [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))


def event_date(ts_col: str = "timestamp_created") -> Column:
    return F.to_date(F.timestamp_seconds(F.col(ts_col)))


def bucket(freq: str, ts_col: str = "timestamp_created") -> Column:
    """Calendar bucket label as a date: day; week ending Sunday (pandas 'W');
    month end (pandas 'M')."""
    d = event_date(ts_col)
    if freq == "D":
        return d
    if freq == "W":
        return F.date_add(F.date_trunc("week", d).cast("date"), 6)
    if freq == "M":
        return F.last_day(d)
    raise ValueError(f"unknown freq {freq}")


def _calendar(agg: DataFrame, ks: list[str], freq: str) -> DataFrame:
    """One row per group and bucket between the group's first and last bucket."""
    span = agg.groupBy(*ks).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    if freq == "M":
        n = F.months_between("_hi", "_lo").cast("int")
        seq = F.transform(F.sequence(F.lit(0), n), lambda i: F.last_day(F.add_months("_lo", i)))
    else:
        seq = F.sequence("_lo", "_hi", F.expr(f"interval {FREQ_STEP[freq]}"))
    return span.select(*ks, F.explode(seq).alias("bucket"))


def fill_calendar(agg: DataFrame, freq: str, keys: Keys | None = ("app_id",),
                  fill: dict | None = None) -> DataFrame:
    """Left-join an aggregated (keys, bucket, ...) frame onto its full calendar."""
    ks = _keys(keys)
    out = _calendar(agg, ks, freq).join(agg, [*ks, "bucket"], "left")
    return out.fillna(fill) if fill else out


def bucket_counts(df: DataFrame, freq: str = "D", keys: Keys | None = ("app_id",)) -> DataFrame:
    ks = _keys(keys)
    return df.groupBy(*ks, bucket(freq).alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.sum("voted_up").cast("long").alias("positive"))


def daily_trend(df: DataFrame, keys: Keys | None = ("app_id",)) -> DataFrame:
    """Per day count, positives and rate; empty days are not emitted."""
    return bucket_counts(df, "D", keys).withColumn(
        "positive_rate", F.col("positive") / F.col("total")).withColumnRenamed("bucket", "date")


def daily_stats(df: DataFrame, keys: Keys | None = ("app_id",)) -> DataFrame:
    ks = _keys(keys)
    return df.groupBy(*ks, event_date().alias("date")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("voted_up").cast("long").alias("positive"),
        round_to(F.avg("voted_up"), 3).alias("mean"),
        round_to(F.avg("voted_up") * 100, 1).alias("positive_pct"))


def weekly_sentiment(df: DataFrame, keys: Keys | None = ("app_id",)) -> DataFrame:
    """Weeks ending Sunday, empty weeks kept with null ratios."""
    ks = _keys(keys)
    agg = bucket_counts(df, "W", ks)
    out = fill_calendar(agg, "W", ks)
    return out.select(
        *ks, F.col("bucket").alias("week"),
        F.coalesce("positive", F.lit(0)).cast("long").alias("positive_count"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        (F.coalesce("total", F.lit(0)) - F.coalesce("positive", F.lit(0))).cast("long").alias("negative"),
        F.try_divide(F.col("positive"), F.col("total")).alias("positive_ratio"),
        F.try_divide(F.col("total") - F.col("positive"), F.col("total")).alias("negative_ratio"))


def temporal_trends(df: DataFrame, period: str = "daily", keys: Keys | None = ("app_id",)) -> DataFrame:
    """sum / count / mean (3 dp) of votes per day, week (ending Sunday) or month;
    no gap filling."""
    freq = {"daily": "D", "weekly": "W", "monthly": "M"}[period]
    ks = _keys(keys)
    return df.groupBy(*ks, bucket(freq).alias("bucket")).agg(
        F.sum("voted_up").cast("long").alias("sum"), F.count(F.lit(1)).alias("count"),
        round_to(F.avg("voted_up"), 3).alias("mean"))


def trend_direction(df: DataFrame, period: str = "daily", keys: Keys | None = ("app_id",)) -> DataFrame:
    """'improving' iff the last bucket's mean exceeds the first bucket's."""
    ks = _keys(keys)
    t = temporal_trends(df, period, ks).withColumn("_m", F.col("sum") / F.col("count"))
    out = t.groupBy(*ks).agg(F.max_by("_m", "bucket").alias("last_mean"),
                             F.min_by("_m", "bucket").alias("first_mean"))
    return out.withColumn("trend", F.when(F.col("last_mean") > F.col("first_mean"), "improving")
                          .otherwise("declining"))


def period_features(df: DataFrame, freq: str = "W", keys: Keys | None = ("app_id",),
                    length_col: str | None = None, sentiment_col: str | None = None) -> DataFrame:
    """positive, total, positive_rate, avg_length, avg_sentiment, negative per bucket,
    gap-filled, missing values 0."""
    ks = _keys(keys)
    if length_col:
        ln = F.col(length_col)
    elif "review" in df.columns:
        ln = F.length(F.coalesce(F.col("review"), F.lit("")))
    else:
        ln = F.lit(None).cast("double")
    sent = F.avg(F.col(sentiment_col)) if sentiment_col else F.lit(None).cast("double")
    agg = df.groupBy(*ks, bucket(freq).alias("bucket")).agg(
        F.sum("voted_up").cast("double").alias("positive"),
        F.count(F.lit(1)).cast("double").alias("total"),
        F.avg(F.col("voted_up").cast("double")).alias("positive_rate"),
        F.avg(ln.cast("double")).alias("avg_length"), sent.alias("avg_sentiment"))
    out = fill_calendar(agg, freq, ks)
    out = out.fillna(0.0, ["positive", "total", "positive_rate", "avg_length", "avg_sentiment"])
    return out.withColumn("negative", F.col("total") - F.col("positive"))


def _quadratic_fit(feat: DataFrame, ks: list[str], min_periods: int = 4) -> DataFrame:
    """Least-squares y = a + b*u + c*u^2 per group with u = t - mean(t), from the
    sufficient statistics; solved by Cramer's rule (exact for the 3x3 system)."""
    w = Window.partitionBy(*ks).orderBy("bucket")
    f = feat.withColumn("t", (F.row_number().over(w) - 1).cast("double"))
    g = f.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("tm"),
                          F.max("bucket").alias("last_bucket"),
                          F.max_by("positive_rate", "bucket").alias("current_rate"),
                          F.avg("positive_rate").alias("average_rate"),
                          F.stddev_samp("positive_rate").alias("volatility"),
                          F.sum("total").cast("long").alias("total_reviews"))
    f = f.join(g.select(*ks, "tm"), ks)
    u = F.col("t") - F.col("tm")
    y = F.col("positive_rate")
    s = f.groupBy(*ks).agg(
        F.count(F.lit(1)).cast("double").alias("s0"), F.sum(u).alias("s1"),
        F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"),
        F.sum(y).alias("y0"), F.sum(u * y).alias("y1"), F.sum(u * u * y).alias("y2"))
    s = s.join(g, ks).where(F.col("n") >= min_periods)

    def det3(a11, a12, a13, a21, a22, a23, a31, a32, a33):
        return (a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31)
                + a13 * (a21 * a32 - a22 * a31))

    c = {k: F.col(k) for k in ("s0", "s1", "s2", "s3", "s4", "y0", "y1", "y2")}
    D = det3(c["s0"], c["s1"], c["s2"], c["s1"], c["s2"], c["s3"], c["s2"], c["s3"], c["s4"])
    Da = det3(c["y0"], c["s1"], c["s2"], c["y1"], c["s2"], c["s3"], c["y2"], c["s3"], c["s4"])
    Db = det3(c["s0"], c["y0"], c["s2"], c["s1"], c["y1"], c["s3"], c["s2"], c["y2"], c["s4"])
    Dc = det3(c["s0"], c["s1"], c["y0"], c["s1"], c["s2"], c["y1"], c["s2"], c["s3"], c["y2"])
    return s.select(*ks, "n", "tm", "last_bucket", "current_rate", "average_rate", "volatility",
                    "total_reviews", (Da / D).alias("a"), (Db / D).alias("b"), (Dc / D).alias("c"))


def forecast_dates(last: Column, step: Column, freq: str) -> Column:
    """k-th (1-based) bucket after ``last``: next days, next Sundays, or month ends
    starting from the month end on or after last + 30 days."""
    if freq == "D":
        return F.date_add(last, step)
    if freq == "W":
        return F.date_add(last, step * 7)
    return F.last_day(F.add_months(F.last_day(F.date_add(last, 30)), step - 1))


def forecast_rate(df: DataFrame, freq: str = "W", horizon: int = 30,
                  keys: Keys | None = ("app_id",)) -> DataFrame:
    """Degree-2 polynomial fit of the bucket positive rate on the bucket index,
    predictions for the next ``horizon`` buckets clipped to [0, 1]. Groups with
    fewer than 4 buckets produce no rows."""
    ks = _keys(keys)
    fit = _quadratic_fit(period_features(df, freq, ks), ks)
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    u = F.col("n") - 1 + F.col("step") - F.col("tm")
    pred = F.col("a") + F.col("b") * u + F.col("c") * u * u
    return steps.select(*ks, "step", forecast_dates(F.col("last_bucket"), F.col("step"), freq)
                        .alias("date"), F.least(F.greatest(pred, F.lit(0.0)), F.lit(1.0))
                        .alias("predicted_rate"))


def forecast_trend(pred: DataFrame, keys: Keys | None = ("app_id",)) -> DataFrame:
    """mean(second half) - mean(first half) of the forecast: > .05 improving,
    < -.05 declining, else stable (fewer than 2 steps: stable)."""
    ks = _keys(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*ks)) if ks else F.count(F.lit(1)).over(Window.partitionBy())
    p = pred.withColumn("_h", F.floor(n / 2))
    g = p.groupBy(*ks).agg(F.count(F.lit(1)).alias("horizon"),
                          F.avg(F.when(F.col("step") <= F.col("_h"), F.col("predicted_rate"))).alias("first_half"),
                          F.avg(F.when(F.col("step") > F.col("_h"), F.col("predicted_rate"))).alias("second_half"))
    diff = F.col("second_half") - F.col("first_half")
    return g.withColumn("trend", F.when(F.col("horizon") < 2, "stable").when(diff > 0.05, "improving")
                        .when(diff < -0.05, "declining").otherwise("stable"))


def rate_statistics(df: DataFrame, freq: str = "W", keys: Keys | None = ("app_id",)) -> DataFrame:
    """current (last bucket) rate, mean, sample std and total reviews per group."""
    ks = _keys(keys)
    f = period_features(df, freq, ks)
    return f.groupBy(*ks).agg(F.max_by("positive_rate", "bucket").alias("current_rate"),
                              F.avg("positive_rate").alias("average_rate"),
                              F.stddev_samp("positive_rate").alias("volatility"),
                              F.sum("total").cast("long").alias("total_reviews"))


def detect_anomalies(df: DataFrame, window: int = 7, threshold: float = 2.0,
                     keys: Keys | None = ("app_id",)) -> DataFrame:
    """Daily rate (empty day = 0), rolling mean/std over the last ``window`` days
    including today, |z| > threshold -> spike / drop. Groups with fewer than
    2*window days produce nothing; a (numerically) flat window has no z."""
    ks = _keys(keys)
    agg = df.groupBy(*ks, bucket("D").alias("bucket")).agg(
        F.avg(F.col("voted_up").cast("double")).alias("rate"))
    days = fill_calendar(agg, "D", ks, {"rate": 0.0})
    w = Window.partitionBy(*ks).orderBy("bucket").rowsBetween(-(window - 1), 0)
    n_days = F.count(F.lit(1)).over(Window.partitionBy(*ks))
    d = days.select(*ks, "bucket", "rate", F.avg("rate").over(w).alias("moving_average"),
                    F.stddev_samp("rate").over(w).alias("_sd"), F.count("rate").over(w).alias("_n"),
                    n_days.alias("_days"))
    z = (F.col("rate") - F.col("moving_average")) / F.col("_sd")
    d = d.where((F.col("_days") >= 2 * window) & (F.col("_n") == window) & (F.col("_sd") >= 1e-12))
    d = d.withColumn("z_score", z).where(F.abs("z_score") > threshold)
    return d.select(*ks, F.col("bucket").alias("date"), F.col("rate").alias("positive_rate"),
                    "moving_average", "z_score",
                    F.when(F.col("z_score") > 0, "spike").otherwise("drop").alias("type"))


# ---------------------------------------------------------------- ranks

def rank_average(df: DataFrame, col: str, out: str | None = None, ascending: bool = False,
                 keys: Keys | None = None) -> DataFrame:
    """pandas rank(method='average'): ties share the mean of their positions.
    Meant for aggregated frames (one row per game)."""
    ks = _keys(keys)
    o = F.col(col).asc() if ascending else F.col(col).desc()
    w = Window.partitionBy(*ks).orderBy(o)
    ties = Window.partitionBy(*ks, col)
    return df.withColumn(out or f"{col}_rank",
                         F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def percentile_rank(df: DataFrame, col: str, out: str | None = None,
                    keys: Keys | None = None) -> DataFrame:
    """Share (in %) of rows whose value is strictly smaller."""
    ks = _keys(keys)
    w = Window.partitionBy(*ks).orderBy(F.col(col).asc())
    n = F.count(F.lit(1)).over(Window.partitionBy(*ks))
    return df.withColumn(out or f"{col}_percentile", (F.rank().over(w) - 1) / n * 100.0)
