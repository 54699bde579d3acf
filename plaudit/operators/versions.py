"""Version / update impact (2-H)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.functions.cleaning import round_to

from plaudit.functions import detect_versions as detect_versions_col
from plaudit.operators import timeseries as ts
from plaudit.operators.keywords import with_tokens
from plaudit.operators.scan import top_n_per_group
from plaudit.session import scratch_path

Keys = Sequence[str]
DAY_S = 86400


def _keys(keys) -> list[str]:
    return [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))


def detect_versions(df: DataFrame, keys: Keys | None = ("app_id",)) -> DataFrame:
    """One row per (review, mentioned version); reviews without a mention are omitted."""
    ks = _keys(keys)
    cols = [c for c in ["recommendation_id", *ks, "timestamp_created", "voted_up"] if c in df.columns]
    return df.select(*cols, F.explode(detect_versions_col("review")).alias("version"))


def sentiment_by_version(mentions: DataFrame, keys: Keys | None = ("app_id",)) -> DataFrame:
    ks = _keys(keys)
    out = mentions.groupBy(*ks, "version").agg(
        F.sum("voted_up").cast("long").alias("positive"), F.count(F.lit(1)).alias("total"))
    return out.withColumns({"negative": F.col("total") - F.col("positive"),
                            "satisfaction_rate": F.col("positive") / F.col("total") * 100})


def version_summary(mentions: DataFrame, keys: Keys | None = ("app_id",)) -> DataFrame:
    """Per version: rate rounded to 2, sample size; sorted by rate desc."""
    s = sentiment_by_version(mentions, keys)
    return s.withColumn("satisfaction_rate", round_to("satisfaction_rate", 2)).orderBy(
        F.col("satisfaction_rate").desc(), F.col("version"))


def trending_versions(mentions: DataFrame, limit: int = 10, keys: Keys | None = ("app_id",)) -> DataFrame:
    ks = _keys(keys)
    c = mentions.groupBy(*ks, "version").agg(F.count(F.lit(1)).alias("mentions"))
    return top_n_per_group(c, ks, [F.col("mentions").desc(), F.col("version")], limit)


def version_over_time(mentions: DataFrame, unit: str = "W", top: int = 5,
                      keys: Keys | None = ("app_id",)) -> DataFrame:
    """Top ``top`` versions per app: gap-filled per-bucket positive / total / rate
    (empty buckets 0). Mentions are counted per bucket once and written; the top list
    adds these counts up. It is a semi join, never collected."""
    ks = _keys(keys)
    agg = _written(mentions.groupBy(*ks, "version", ts.bucket(unit).alias("bucket")).agg(
        F.sum("voted_up").cast("long").alias("positive"), F.count(F.lit(1)).alias("total")), "buckets")
    counts = agg.groupBy(*ks, "version").agg(F.sum("total").alias("mentions"))
    tv = top_n_per_group(counts, ks, [F.col("mentions").desc(), F.col("version")], top).select(*ks, "version")
    agg = agg.join(tv, [*ks, "version"], "left_semi")
    out = ts.fill_calendar(agg, unit, [*ks, "version"], {"positive": 0, "total": 0})
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("positive") / F.col("total"))
                          .otherwise(F.lit(0.0)))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"impact/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _prefix_probe(points: DataFrame, probes: DataFrame, ks: list[str], probe_keys: list[str],
                  block_s: int) -> DataFrame:
    """P(x) = (#reviews, #positive) with a second < x, for every probe point x.

    ``points`` holds one row per (keys, second). Running sums come from a two-level tree
    of time blocks: inside a block of ``block_s`` seconds, over the blocks of a day, over
    the days. No window holds more than a block's seconds, a day's blocks or an app's
    days, however many reviews or probes there are.
    """
    rows = points.select(*ks, F.col("timestamp_created").alias("x"), "n", "p", F.lit(1).alias("_kind"),
                         *[F.lit(None).cast(probes.schema[k].dataType).alias(k) for k in probe_keys])
    none = F.lit(0).cast("long")
    pr = probes.select(*ks, "x", none.alias("n"), none.alias("p"), F.lit(0).alias("_kind"), *probe_keys)
    u = rows.unionByName(pr).withColumn("block", F.floor(F.col("x") / block_s))
    # probes sort before reviews at the same second
    inside = Window.partitionBy(*ks, "block").orderBy("x", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    u = u.withColumns({"cn": F.sum("n").over(inside), "cp": F.sum("p").over(inside)})
    # running sums only grow, so the largest of a block is its total
    day = F.floor(F.col("block") * block_s / DAY_S)
    blocks = (u.groupBy(*ks, "block").agg(F.max("cn").alias("tn"), F.max("cp").alias("tp"))
              .withColumn("day", day))

    def before(col, w):
        return F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), none)

    in_day = Window.partitionBy(*ks, "day").orderBy("block")
    blocks = blocks.withColumns({"bn": before("tn", in_day), "bp": before("tp", in_day)})
    days = blocks.groupBy(*ks, "day").agg((F.max(F.col("bn") + F.col("tn"))).alias("dn"),
                                          (F.max(F.col("bp") + F.col("tp"))).alias("dp"))
    in_app = Window.partitionBy(*ks).orderBy("day")
    days = days.select(*ks, "day", before("dn", in_app).alias("on"), before("dp", in_app).alias("op"))
    offs = blocks.join(days, [*ks, "day"]).select(
        *ks, "block", (F.col("bn") + F.col("on")).alias("bn"), (F.col("bp") + F.col("op")).alias("bp"))
    return u.where(F.col("_kind") == 0).join(offs, [*ks, "block"]).select(
        *ks, *probe_keys, (F.col("bn") + F.col("cn")).alias("P_n"), (F.col("bp") + F.col("cp")).alias("P_p"))


def update_impact(df: DataFrame, window_days: int = 7, keys: Keys | None = ("app_id",),
                  block_s: int = 3600) -> DataFrame:
    """Per version: mean positive % of all reviews in [t - w, t) and in (t, t + w]
    around each mention time t; impact = after - before, null only when a side has
    no reviews (a 0 % side is a real value).

    The rates depend on the second alone, so mentions are counted per (version, second)
    and each second is probed once: a patch day's mentions, however many, are at most
    86,400 probes an app. The frame is read twice, for its reviews and for its mentions;
    both sums are written to the shared folder, as each is needed more than once. Rows
    without a key or a time count nowhere."""
    ks = _keys(keys)
    w = window_days * DAY_S
    base = df.dropna(subset=["timestamp_created", *ks])
    points = base.groupBy(*ks, "timestamp_created").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("voted_up"), F.lit(0)).cast("long").alias("p"))
    seen = detect_versions(base, ks).groupBy(*ks, "version", F.col("timestamp_created").alias("t")).agg(
        F.count(F.lit(1)).alias("m"))
    points, seen = _written(points, "points"), _written(seen, "mentions")
    t = F.col("t")
    # four probes per second: t - w, t (before = [t-w, t)), t + 1, t + w + 1 (after = (t, t+w])
    probes = seen.select(*ks, "t").distinct().select(*ks, "t", F.posexplode(
        F.array(t - w, t, t + 1, t + w + 1)).alias("k", "x"))
    got = _prefix_probe(points, probes, ks, ["t", "k"], block_s)

    def at(k, c):
        return F.sum(F.when(F.col("k") == k, F.col(c)))

    per = got.groupBy(*ks, "t").agg(
        (at(1, "P_n") - at(0, "P_n")).alias("bn"), (at(1, "P_p") - at(0, "P_p")).alias("bp"),
        (at(3, "P_n") - at(2, "P_n")).alias("an"), (at(3, "P_p") - at(2, "P_p")).alias("ap"))
    per = per.select(*ks, "t",
                     F.when(F.col("bn") > 0, F.col("bp") / F.col("bn") * 100).alias("before_rate"),
                     F.when(F.col("an") > 0, F.col("ap") / F.col("an") * 100).alias("after_rate"))

    def mean(c):
        return F.try_divide(F.sum(F.col(c) * F.col("m")), F.sum(F.when(F.col(c).isNotNull(), F.col("m"))))

    out = seen.join(per, [*ks, "t"]).groupBy(*ks, "version").agg(
        F.sum("m").alias("mentions"), mean("before_rate").alias("before_avg"), mean("after_rate").alias("after_avg"))
    return out.withColumn("impact", F.col("after_avg") - F.col("before_avg"))


def version_keywords(df: DataFrame, top_n: int = 10, keys: Keys | None = ("app_id",)) -> DataFrame:
    """Top keywords of the reviews naming each version (cleaned English tokens)."""
    ks = _keys(keys)
    t = with_tokens(df.withColumn("_versions", detect_versions_col("review")))
    t = t.where(F.size("_versions") > 0)
    pairs = t.select(*ks, F.explode("_versions").alias("version"), "tokens") \
             .select(*ks, "version", F.explode("tokens").alias("word"))
    c = pairs.groupBy(*ks, "version", "word").agg(F.count(F.lit(1)).alias("count"))
    return top_n_per_group(c, [*ks, "version"], [F.col("count").desc(), F.col("word")], top_n)


def version_report(df: DataFrame, keys: Keys | None = ("app_id",)) -> dict:
    from pyspark import StorageLevel
    m = detect_versions(df, keys).persist(StorageLevel.MEMORY_AND_DISK)
    return {"mentions": m, "summary": version_summary(m, keys),
            "trending": trending_versions(m, 10, keys), "over_time": version_over_time(m, "W", 5, keys),
            "impact": update_impact(df, 7, keys), "keywords": version_keywords(df, 10, keys)}
