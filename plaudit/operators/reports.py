"""Report bundles as one table each (2-G, 2-H): every section of a report comes from
one grouped pass over the reviews (``GROUPING SETS``), so the frame is read once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.functions import word_count
from plaudit.functions.cleaning import round_to
from plaudit.operators import timeseries as ts
from plaudit.operators.quality import _issue_flags, _keys, enrich_quality
from plaudit.operators.versions import detect_versions

Keys = Sequence[str]
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
# grouping_id of the three item columns (label, score, day): a bit is 0 where it is a key
ALL, BY_LABEL, BY_SCORE, BY_DAY = 0b111, 0b011, 0b101, 0b110


def comprehensive_table(df: DataFrame, keys: Keys | None = ("app_id",), categories: dict | None = None) -> DataFrame:
    """(*keys, section, item, count, positive, value) with the sections

    * ``intensity``: reviews per intensity label, their share in % (2 places);
    * ``issue``: reviews per issue category, their share in %;
    * ``segment``: reviews per player segment (all five), their share in %;
    * ``trend``: reviews and positive ones per day, mean vote (3 places);
    * ``quality``: mean, std, min, quartiles and max of the quality score;
    * ``comparison``: total and average words, positive rate, average quality.

    Quality scores are whole numbers up to 100, so their quantiles are exact from the
    counts per score. Windows hold a group's days, scores and labels, never reviews.
    Reviews without a time are one trend item without a name; without votes the rates
    are null."""
    ks = _keys(keys)
    categories = categories or L.ISSUE_CATEGORIES
    flags = [f"_i{i}" for i in range(len(categories))]
    d = _issue_flags(enrich_quality(df), categories).select(
        *ks, F.col("sentiment_intensity").alias("_label"), F.col("quality_score").alias("_score"),
        ts.bucket("D").alias("_day"), "segment", "voted_up", word_count("review").alias("_words"), *flags)
    group = [F.col(k) for k in ks]
    items = [F.col("_label"), F.col("_score"), F.col("_day")]
    agg = d.groupingSets([group, *[[*group, c] for c in items]], *group, *items).agg(
        F.grouping_id(*group, *items).alias("_set"), F.count(F.lit(1)).alias("n"),
        F.sum("voted_up").cast("long").alias("pos"), F.count("voted_up").alias("votes"), F.sum("_words").alias("words"),
        *[F.count_if(F.col(f)).alias(f) for f in flags],
        *[F.count_if(F.col("segment") == s).alias(f"_s{i}") for i, s in enumerate(L.SEGMENTS)])
    of_all, scored = F.col("_set") == ALL, F.col("_set") == BY_SCORE
    per = Window.partitionBy(*ks)
    agg = agg.withColumns({
        "total": F.max(F.when(of_all, F.col("n"))).over(per),
        "upto": F.sum("n").over(Window.partitionBy(*ks, "_set").orderBy("_score").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)),
        "s1": F.sum(F.when(scored, F.col("_score") * F.col("n"))).over(per).cast("double"),
        "s2": F.sum(F.when(scored, F.col("_score") * F.col("_score") * F.col("n"))).over(per).cast("double"),
        "lo": F.min(F.when(scored, F.col("_score"))).over(per), "hi": F.max(F.when(scored, F.col("_score"))).over(per)})
    quart = {}
    for name, p in QUARTILES.items():
        at = (F.col("total") - 1) * F.lit(p)
        below, above = (F.min(F.when(scored & (F.col("upto") > edge), F.col("_score"))).over(per)
                        for edge in (F.floor(at), F.ceil(at)))
        quart[name] = below + (above - below) * (at - F.floor(at))
    agg = agg.withColumns(quart)

    def item(section, name, count, value, positive=None):
        return F.struct(F.lit(section).alias("section"), name.cast("string").alias("item"), count.cast("long").alias("count"),
                        (F.lit(None) if positive is None else positive).cast("long").alias("positive"),
                        value.cast("double").alias("value"))

    n, total = F.col("n"), F.col("total")
    std = F.when(n > 1, F.sqrt(F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1), F.lit(0.0))))
    quality = {"mean": F.col("s1") / n, "std": std, "min": F.col("lo"), **{q: F.col(q) for q in QUARTILES}, "max": F.col("hi")}
    comparison = {"total_words": F.col("words"), "avg_words": F.col("words") / n,
                  "positive_rate": F.try_divide(F.col("pos"), F.col("votes")) * 100, "avg_quality_score": F.col("s1") / n}
    whole = F.array(
        *[item("issue", F.lit(c), F.col(f), F.col(f) / n * 100) for c, f in zip(categories, flags)],
        *[item("segment", F.lit(s), F.col(f"_s{i}"), F.col(f"_s{i}") / n * 100) for i, s in enumerate(L.SEGMENTS)],
        *[item("quality", F.lit(k), n, v) for k, v in quality.items()],
        *[item("comparison", F.lit(k), n, v) for k, v in comparison.items()])
    lines = (F.when(of_all & (n > 0), whole)
             .when(F.col("_set") == BY_LABEL, F.array(item("intensity", F.col("_label"), n, round_to(n / total * 100, 2))))
             .when(F.col("_set") == BY_DAY, F.array(item(
                 "trend", F.col("_day"), n, round_to(F.try_divide(F.col("pos"), F.col("votes")), 3), F.col("pos")))))
    return agg.select(*ks, F.explode(lines).alias("_l")).select(*ks, "_l.*")


def version_table(df: DataFrame, keys: Keys | None = ("app_id",), top: int = 5) -> DataFrame:
    """(*keys, version, section, week, positive, total, rate, rank): one ``version`` row
    per mentioned version (rank by mentions, ties by name) and one ``week`` row per week
    between the first and the last mention of the ``top`` versions (weeks without a
    mention have zeros). Mentions without a time count in the version row alone."""
    ks = _keys(keys)
    m = detect_versions(df, ks).select(*ks, "version", ts.bucket("W").alias("week"), "voted_up")
    group = [*[F.col(k) for k in ks], F.col("version")]
    agg = m.groupingSets([group, [*group, F.col("week")]], *group, F.col("week")).agg(
        F.grouping(F.col("week")).alias("_whole"), F.coalesce(F.sum("voted_up"), F.lit(0)).cast("long").alias("positive"),
        F.count(F.lit(1)).alias("total"))
    whole = F.col("_whole") == 1
    agg = agg.withColumn("_mentions", F.max(F.when(whole, F.col("total"))).over(Window.partitionBy(*ks, "version")))
    # all rows of a version are peers here, so the dense rank numbers versions
    agg = agg.withColumn("rank", F.dense_rank().over(
        Window.partitionBy(*ks).orderBy(F.col("_mentions").desc(), F.col("version"))))
    agg = agg.where(whole | ((F.col("rank") <= top) & F.col("week").isNotNull()))
    after = F.lead("week").over(Window.partitionBy(*ks, "version", "_whole").orderBy("week"))
    weeks = F.when(whole, F.array(F.lit(None).cast("date"))).otherwise(
        F.expr("sequence(week, coalesce(date_sub(_after, 7), week), interval 7 days)"))
    agg = agg.withColumn("_after", after).withColumn("_weeks", weeks)
    out = agg.select(*ks, "version", F.when(whole, "version").otherwise("week").alias("section"), "positive", "total",
                     "rank", F.posexplode("_weeks").alias("_at", "week"))
    first = F.col("_at") == 0
    out = out.withColumns({"positive": F.when(first, F.col("positive")).otherwise(F.lit(0)).cast("long"),
                           "total": F.when(first, F.col("total")).otherwise(F.lit(0)).cast("long")})
    rate = F.when(F.col("total") > 0, F.col("positive") / F.col("total")).otherwise(F.lit(0.0))
    return out.select(*ks, "version", "section", "week", "positive", "total", rate.alias("rate"), "rank")
