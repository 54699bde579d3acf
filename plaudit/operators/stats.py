"""Aggregations and statistics (2-D). Every operator is one grouped aggregate
(partial + final hash aggregate, so hot keys are combined map-side)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaudit.functions.cleaning import round_to
from pyspark.sql import types as T

from plaudit import lexicons as L
from plaudit.functions import length_bin, playtime_bin, review_length, word_count

Keys = Sequence[str]


def _keys(keys) -> list[str]:
    return [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))


def _agg(df: DataFrame, keys, *aggs):
    ks = _keys(keys)
    return df.groupBy(*ks).agg(*aggs) if ks else df.agg(*aggs)


def review_stats(df: DataFrame, keys: Keys | None = None, app_id: str | None = None,
                 start: int | None = None, end: int | None = None) -> DataFrame:
    """total, positive = SUM(voted_up) (null -> 0), negative."""
    if app_id is not None:
        df = df.filter(F.col("app_id") == str(app_id))
    if start is not None:
        df = df.filter(F.col("timestamp_created") >= start)
    if end is not None:
        df = df.filter(F.col("timestamp_created") <= end)
    out = _agg(df, keys, F.count(F.lit(1)).alias("total"),
               F.coalesce(F.sum("voted_up"), F.lit(0)).cast("long").alias("positive"))
    return out.withColumn("negative", F.col("total") - F.col("positive"))


def with_positive_rate(stats: DataFrame) -> DataFrame:
    """positive / total * 100, rounded to 2 places; 0 when there are no reviews."""
    return stats.withColumn("positive_rate", F.when(F.col("total") > 0, round_to(
        F.col("positive") / F.col("total") * 100, 2)).otherwise(F.lit(0.0)))


def positive_rate(df: DataFrame, keys: Keys | None = None, **kw) -> DataFrame:
    return with_positive_rate(review_stats(df, keys, **kw))


def stats_by_game(df: DataFrame) -> DataFrame:
    return positive_rate(df, ["app_id"]).orderBy(F.col("total").desc(), F.col("app_id"))


def available_languages(df: DataFrame, app_id: str | None = None) -> DataFrame:
    if app_id is not None:
        df = df.filter(F.col("app_id") == str(app_id))
    return df.select("language").where(F.col("language").isNotNull()).distinct().orderBy("language")


def date_range(df: DataFrame, keys: Keys | None = None) -> DataFrame:
    out = _agg(df, keys, F.min("timestamp_created").alias("min_ts"),
               F.max("timestamp_created").alias("max_ts"))
    return out.withColumns({
        "first_review": F.date_format(F.timestamp_seconds("min_ts"), "yyyy-MM-dd HH:mm:ss"),
        "last_review": F.date_format(F.timestamp_seconds("max_ts"), "yyyy-MM-dd HH:mm:ss")})


def playtime_range(df: DataFrame, keys: Keys | None = None,
                   col: str = "author_playtime_forever") -> DataFrame:
    return _agg(df, keys, F.coalesce(F.min(col), F.lit(0.0)).alias("min_playtime"),
                F.coalesce(F.max(col), F.lit(0.0)).alias("max_playtime"))


def filter_metadata(df: DataFrame, keys: Keys | None = None,
                    col: str = "author_playtime_forever") -> DataFrame:
    """Languages, date span and playtime span in one aggregate."""
    out = _agg(df, keys,
               F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"),
               F.min("timestamp_created").alias("min_ts"), F.max("timestamp_created").alias("max_ts"),
               F.coalesce(F.min(col), F.lit(0.0)).alias("min_playtime"),
               F.coalesce(F.max(col), F.lit(0.0)).alias("max_playtime"))
    return out


def label_distribution(df: DataFrame, col: str, keys: Keys | None = None,
                       top: int | None = None) -> DataFrame:
    """value counts of ``col`` with percentage of the group total.

    The percentage uses a window over the *aggregated* counts, i.e. over at most
    (#groups x #labels) rows, never over raw reviews.
    """
    ks = _keys(keys)
    counts = df.groupBy(*ks, col).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*ks)) if ks else F.sum("n").over(Window.partitionBy())
    out = counts.withColumn("pct", round_to(F.col("n") / tot * 100, 2))
    if top is not None:
        w = Window.partitionBy(*ks).orderBy(F.col("n").desc(), F.col(col))
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return out


def language_counts(df: DataFrame, top: int | None = None, keys: Keys | None = None) -> DataFrame:
    return label_distribution(df, "language", keys, top)


def modal_value(df: DataFrame, col: str, keys: Keys | None = None) -> DataFrame:
    """Most frequent value; ties go to the smallest value (as pandas mode)."""
    ks = _keys(keys)
    counts = df.where(F.col(col).isNotNull()).groupBy(*ks, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*ks).orderBy(F.col("n").desc(), F.col(col))
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def flag_summary(df: DataFrame, flag: str, keys: Keys | None = None) -> DataFrame:
    """count and positive % per flag value (early access, device, free copy ...)."""
    ks = _keys(keys)
    return df.groupBy(*ks, flag).agg(F.count(F.lit(1)).alias("n"),
                                    (F.avg("voted_up") * 100).alias("positive_pct"))


def early_access_summary(df: DataFrame, keys: Keys | None = None) -> DataFrame:
    return flag_summary(df, "written_during_early_access", keys)


def flag_counts(df: DataFrame, flag: str = "primarily_steam_deck",
                keys: Keys | None = None) -> DataFrame:
    return df.groupBy(*_keys(keys), flag).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, keys: Keys | None = None) -> DataFrame:
    n = review_length("review")
    return _agg(df, keys, F.avg(n).alias("avg_length"), F.max(n).alias("max_length"),
                F.min(n).alias("min_length"))


def _bin_labels(kind: str) -> list[str]:
    return (L.PLAYTIME_BIN_LABELS + [L.PLAYTIME_OVERFLOW_LABEL]) if kind == "playtime" \
        else list(L.LENGTH_BIN_LABELS)


def with_bins(df: DataFrame, playtime_col: str = "author_playtime_forever") -> DataFrame:
    return df.withColumns({
        "playtime_bin": playtime_bin(F.col(playtime_col) / 60.0),
        "length_bin": length_bin(review_length("review")),
    })


def bin_counts(df: DataFrame, kind: str = "playtime", keys: Keys | None = None) -> DataFrame:
    """Counts per bin in bin order, empty bins kept. The bin grid is generated per
    group by exploding the fixed label list (no join against a side table)."""
    ks = _keys(keys)
    col = f"{kind}_bin"
    binned = with_bins(df).where(F.col(col).isNotNull())
    counts = binned.groupBy(*ks, col).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(col, "bin")
    labels = F.array(*[F.lit(x) for x in _bin_labels(kind)])
    groups = df.select(*ks).distinct() if ks else df.sparkSession.range(1).select()
    grid = groups.select(*ks, F.posexplode(labels).alias("bin_order", "bin"))
    return grid.join(counts, [*ks, "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("long"))


def sentiment_share_by(df: DataFrame, key: str, keys: Keys | None = None) -> DataFrame:
    """Row-normalised Negative / Positive shares per value of ``key``."""
    ks = _keys(keys)
    out = df.where(F.col(key).isNotNull()).groupBy(*ks, key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("voted_up").cast("double")).alias("Positive"))
    return out.withColumn("Negative", 1 - F.col("Positive"))


def _value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _v, _n): how often each value occurs. The shuffle is keyed by the value
    too, so one large group spreads over all tasks."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def join_small(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Join a frame that has one row per key. The rows of a key are dealt out over
    ``salts`` parts and the small side is repeated once per part, so a hot key never
    meets in one task, whatever join Spark picks."""
    part = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", part).join(each, [*keys, "_salt"]).drop("_salt")


#: rank error of the sketch and half the width of a quantile's bracket, as shares of n
SKETCH_ACCURACY, BRACKET = 10_000, 0.001
WHOLE_BRACKET = 4 / BRACKET  # fewer values than this are one bracket: a bracket holds ranks on both sides


def exact_quantiles(df: DataFrame, counts: DataFrame, keys: list[str], value: str,
                    probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles per key: one row per key with ``_q`` (array) and
    ``_total``. ``counts`` are the ``_value_counts`` of ``df``.

    A mergeable sketch per key (partial in the tasks) gives for each quantile a bracket
    of values, equal in depth whatever the tails look like: its ends are the values at
    BRACKET below and above, ten times the sketch's rank error. The values below it are only
    summed up; those inside, 0.2 % of a key's values, are ranked. A bracket that missed
    its rank would be an error, never a wrong value."""
    v = F.col(value).cast("double")
    ends = [max(0.0, p - BRACKET) for p in probs] + [min(1.0, p + BRACKET) for p in probs]
    sketch = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(v, ends, SKETCH_ACCURACY).alias("_e"), F.count(F.lit(1)).alias("_total"),
        F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    m = len(probs)
    sketch = sketch.withColumn("_e", F.when(F.col("_total") >= WHOLE_BRACKET, F.col("_e")).otherwise(
        F.concat(F.array_repeat("_lo", m), F.array_repeat("_hi", m)))).drop("_lo", "_hi")
    placed = join_small(counts, sketch, keys)
    inside = F.array_compact(F.array(*[
        F.when(F.col("_v").between(F.col("_e")[k], F.col("_e")[m + k]), F.lit(k)) for k in range(m)]))
    below = placed.groupBy(*keys, "_total").agg(F.array(*[
        F.sum(F.when(F.col("_v") < F.col("_e")[k], F.col("_n")).otherwise(0)) for k in range(m)]).alias("_below"))
    near = placed.select(*keys, "_v", "_n", F.explode(inside).alias("_k"))
    order = Window.partitionBy(*keys, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_to", F.sum("_n").over(order)).join(below, keys)
    off = F.get("_below", F.col("_k"))
    near = near.withColumns({"_to": F.col("_to") + off, "_p": F.get(F.array(*map(F.lit, map(float, probs))), F.col("_k")) *
                             (F.col("_total") - 1)})

    def order_stat(i):
        return F.max(F.when((F.col("_to") - F.col("_n") <= i) & (i < F.col("_to")), F.col("_v")))

    got = near.groupBy(*keys, "_total", "_k", "_p").agg(order_stat(F.floor("_p")).alias("_a"),
                                                        order_stat(F.ceil("_p")).alias("_b"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    q = F.when(F.col("_a").isNull() | F.col("_b").isNull(), missed) \
        .when(F.ceil("_p") == F.floor("_p"), F.col("_a")) \
        .otherwise((F.ceil("_p") - F.col("_p")) * F.col("_a") + (F.col("_p") - F.floor("_p")) * F.col("_b"))
    return got.groupBy(*keys, "_total").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_k", q.alias("q")))), lambda x: x["q"]).alias("_q"))


def box_stats(df: DataFrame, value: str, by: str = "voted_up", keys: Keys | None = None,
              approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Five-number summary per ``by`` value: quartiles (linear interpolation) and
    Tukey whiskers (min/max inside 1.5 IQR), all from the counts of distinct values.

    ``approx=True`` takes the quartiles from the mergeable sketch
    (percentile_approx), whose memory is bounded per group.
    """
    ks = [*_keys(keys), by]
    counts = _value_counts(df.where(F.col(by).isNotNull()), ks, value)
    if approx:
        v = F.col(value).cast("double")
        q = df.where(v.isNotNull() & F.col(by).isNotNull()).groupBy(*ks).agg(
            F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("_q"), F.count(F.lit(1)).alias("_total"))
    else:
        q = exact_quantiles(df.where(F.col(by).isNotNull()), counts, ks, value, (0.25, 0.5, 0.75))
    q = q.select(*ks, F.col("_total").alias("n"), F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return join_small(counts, q, ks).groupBy(*ks, "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= lo, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= hi, F.col("_v"))).alias("whisker_high"),
        F.min("_v").alias("min"), F.max("_v").alias("max"))


def histogram(df: DataFrame, col: str, nbins: int = 10, keys: Keys | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is right-closed; empty bins kept.
    Bins are counted from the counts of distinct values."""
    ks = _keys(keys) or ["_g"]
    base = df.withColumn("_g", F.lit(0)) if ks == ["_g"] else df
    counts = _value_counts(base, ks, col)
    rng = counts.groupBy(*ks).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(
        F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * nbins) + 1,
        F.lit(nbins))).cast("int")
    per_bin = join_small(counts, rng, ks).groupBy(*ks, idx.alias("bin")).agg(F.sum("_n").alias("n"))
    width = (F.col("hi") - F.col("lo")) / nbins
    grid = rng.select(*ks, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(nbins))).alias("bin"))
    out = grid.join(per_bin, [*ks, "bin"], "left").select(
        *ks, "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_low"),
        (F.col("lo") + F.col("bin") * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.drop("_g")


def describe_scores(df: DataFrame, col: str, keys: Keys | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear, exact), max."""
    ks = _keys(keys) or ["_g"]
    base = df.withColumn("_g", F.lit(0)) if ks == ["_g"] else df
    v = F.col(col).cast("double")
    plain = base.groupBy(*ks).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                  F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(base, _value_counts(base, ks, col), ks, col, (0.25, 0.5, 0.75)).select(*ks, "_q")
    out = plain.join(q, ks, "left").select(*ks, "count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                                           F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")
    return out.drop("_g")


# ---------------------------------------------------------------- correlation

def _beta_fraction(a, b, x, tolerance=1e-15, most=100_000):
    """Continued fraction of the incomplete beta function (DLMF 8.17.22) by its
    convergents, scaled as they grow, until none of them moves any more."""
    import numpy as np
    num, num_before = np.ones_like(x), np.zeros_like(x)
    den, den_before = np.ones_like(x), np.ones_like(x)
    value = np.ones_like(x)
    for k in range(1, most):
        half = k // 2
        if k % 2:
            step = -(a + half) * (a + b + half) * x / ((a + k - 1) * (a + k))
        else:
            step = half * (b - half) * x / ((a + k - 1) * (a + k))
        num, num_before = num + step * num_before if k > 1 else np.ones_like(x), num
        den, den_before = den + step * den_before, den
        size = np.maximum(np.abs(den), np.abs(num))
        num, num_before, den, den_before = num / size, num_before / size, den / size, den_before / size
        new = num / den
        if k > 1 and np.all(np.abs(new - value) <= tolerance * np.abs(new)):
            return new
        value = new
    return value


def student_t_two_sided_p(t, df):
    """Two-sided p-value of Student's t: the regularised incomplete beta function
    at df / (df + t^2), taken from the side where its fraction converges fast."""
    import numpy as np
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    x, a, b = df / (df + t * t), df / 2.0, np.full_like(df, 0.5)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    tiny = np.finfo(float).tiny
    edge = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(np.maximum(x, tiny))
                  + b * np.log(np.maximum(1 - x, tiny)))
    near = x < (a + 1) / (a + b + 2)
    p, q, y = np.where(near, a, b), np.where(near, b, a), np.where(near, x, 1 - x)
    part = edge * _beta_fraction(p, q, y) / p
    return np.where(near, part, 1.0 - part)


@F.pandas_udf(T.DoubleType())
def _t_pvalue(t, n):  # pragma: no cover - runs in the Python worker
    import numpy as np
    import pandas as pd
    df = n.astype(float) - 2
    ok = (df > 0) & t.notna()
    out = np.full(len(t), np.nan)
    if ok.any():
        out[ok.values] = student_t_two_sided_p(t[ok].abs().values, df[ok].values)
    return pd.Series(out)


def pearson_test(df: DataFrame, x: str, y: str, keys: Keys | None = None,
                 with_p: bool = True) -> DataFrame:
    """Pearson r over pairwise-complete rows, t statistic and two-sided p-value.
    The aggregate runs in the JVM; only the one-row-per-group result passes
    through the small Arrow UDF for the t-distribution tail."""
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    # r = cov / (sd_x sd_y); a constant column gives null instead of an ANSI error
    sd = F.stddev_samp(xc) * F.stddev_samp(yc)
    r = F.when(sd > 0, F.try_divide(F.covar_samp(xc, yc), sd))
    out = _agg(base, keys, r.alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    out = out.withColumn("t", F.when((F.col("n") > 2) & (F.abs("r") < 1), t))
    if with_p:
        out = out.withColumn("p_value", F.when(F.abs("r") >= 1, F.lit(0.0))
                             .otherwise(_t_pvalue(F.col("t"), F.col("n"))))
    return out


def point_biserial(df: DataFrame, x: str, vote: str = "voted_up", keys: Keys | None = None,
                   with_p: bool = True) -> DataFrame:
    return pearson_test(df, x, vote, keys, with_p)


# ---------------------------------------------------------------- summaries

def sentiment_overview(df: DataFrame, keys: Keys | None = None) -> DataFrame:
    s = review_stats(df, keys)
    return s.withColumns({
        "positive_share": F.when(F.col("total") > 0, F.col("positive") / F.col("total")),
        "negative_share": F.when(F.col("total") > 0, F.col("negative") / F.col("total"))})


def comparison_metrics(df: DataFrame, keys: Keys | None = None,
                       quality_col: str | None = "quality_score") -> DataFrame:
    """Total words (the original's 'avg_review_length'), true average words,
    mean quality, positive %, review count."""
    wc = word_count("review")
    aggs = [F.sum(wc).cast("long").alias("total_words"), F.avg(wc).alias("avg_words"),
            (F.avg("voted_up") * 100).alias("positive_rate"),
            F.count(F.lit(1)).alias("review_count")]
    if quality_col and quality_col in df.columns:
        aggs.append(F.avg(quality_col).alias("avg_quality_score"))
    return _agg(df, keys, *aggs)


def data_quality_summary(df: DataFrame, ts_col: str = "timestamp_created") -> DataFrame:
    """rows, columns, missing cells and date span (days) in one pass."""
    missing = None
    for c in df.columns:
        term = F.sum(F.when(F.col(c).isNull(), 1).otherwise(0))
        missing = term if missing is None else missing + term
    out = df.agg(F.count(F.lit(1)).alias("rows"), missing.cast("long").alias("missing_cells"),
                 F.min(ts_col).alias("_lo"), F.max(ts_col).alias("_hi"))
    return out.select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing_cells",
                      F.datediff(F.to_date(F.timestamp_seconds("_hi")),
                                 F.to_date(F.timestamp_seconds("_lo"))).cast("long").alias("date_span_days"))


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Remove columns without any value (runs one aggregate action)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])
