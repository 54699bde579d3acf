"""Alert rules over per-bucket review statistics (2-K).

Rules are configuration (a short Python list); each becomes a column
expression, so evaluation is one projection over the stats frame, with no join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaudit import lexicons as L
from plaudit.operators import timeseries as ts

Keys = Sequence[str]

#: the named fields a rule's message may use, per condition
FIELDS = {
    "positive_rate_below": {"rate": lambda: F.try_divide(F.col("positive"), F.col("total")) * 100},
    "negative_reviews_spike": {"recent": lambda: F.coalesce(F.col("recent_negative"), F.lit(0)),
                               "avg": lambda: F.coalesce(F.col("avg_negative"), F.lit(1.0))},
    "total_reviews_below": {"total": lambda: F.coalesce(F.col("total"), F.lit(0))},
}


def message_column(condition: str, template: str) -> Column:
    """A rule's own text with its named fields filled in. A field may carry a number
    format of the kind ``.1f``, ``d`` or ``.0%``; shown decimals are rounded half up."""
    fmt, args = [], []
    for literal, name, spec, _ in Formatter().parse(template):
        fmt.append(literal.replace("%", "%%"))
        if name is None:
            continue
        if name not in FIELDS[condition]:
            raise ValueError(f"message of a {condition} rule has no field {name!r}")
        value = FIELDS[condition][name]()
        m = re.fullmatch(r"(,?)(?:\.(\d+))?([fd%]?)", spec or "")
        if m is None:
            raise ValueError(f"number format {spec!r} is not known")
        comma, places, kind = m.groups()
        if kind == "d" or (not spec and name != "rate" and name != "avg"):
            fmt.append(f"%{comma}d")
            value = value.cast("long")
        elif not spec:
            fmt.append("%s")
            value = value.cast("string")
        else:
            n = int(places) if places is not None else 6
            fmt.append(f"%{comma}.{n}f" + ("%%" if kind == "%" else ""))
            value = F.round((value * 100 if kind == "%" else value).cast("double"), n)
        args.append(value)
    return F.format_string("".join(fmt), *args)


def alert_stats(df: DataFrame, freq: str = "D", lookback: int = 7,
                keys: Keys | None = ("app_id",)) -> DataFrame:
    """Per (app, bucket): total, positive, recent_negative (this bucket) and
    avg_negative (mean negatives of the previous ``lookback`` buckets, gap-filled;
    null when there is no history)."""
    ks = list(keys or [])
    agg = df.groupBy(*ks, ts.bucket(freq).alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.sum("voted_up").cast("long").alias("positive"))
    full = ts.fill_calendar(agg, freq, ks, {"total": 0, "positive": 0})
    w = Window.partitionBy(*ks).orderBy("bucket").rowsBetween(-lookback, -1)
    neg = F.col("total") - F.col("positive")
    return full.withColumns({"recent_negative": neg}).withColumn(
        "avg_negative", F.avg("recent_negative").over(w))


def evaluate_alerts(stats: DataFrame, rules: Sequence[tuple] = L.DEFAULT_ALERT_RULES,
                    keys: Sequence[str] = ("app_id", "bucket")) -> DataFrame:
    """One row per (stats row, fired rule) with the rule's own message, formatted.

    positive_rate_below: total > 0 and positive/total < threshold;
    negative_reviews_spike: recent_negative > avg_negative * threshold (missing
    average counts as 1, as in the original); total_reviews_below: total < threshold.
    """
    avg = F.coalesce(F.col("avg_negative"), F.lit(1.0))
    fired = []
    for name, cond, thr, template in rules:
        if cond == "positive_rate_below":
            c = (F.col("total") > 0) & (F.try_divide(F.col("positive"), F.col("total")) < thr)
        elif cond == "negative_reviews_spike":
            c = F.coalesce(F.col("recent_negative"), F.lit(0)) > avg * thr
        elif cond == "total_reviews_below":
            c = F.coalesce(F.col("total"), F.lit(0)) < thr
        else:
            raise ValueError(f"unknown condition {cond}")
        fired.append(F.when(c, F.struct(F.lit(name).alias("rule"), F.lit(cond).alias("condition"),
                                         message_column(cond, template).alias("message"))))
    hits = F.filter(F.array(*fired), lambda x: x.isNotNull())
    ks = [k for k in keys if k in stats.columns]
    return stats.select(*ks, "total", "positive", "recent_negative", "avg_negative",
                    F.explode(hits).alias("a")).select(*ks, "a.*", "total", "positive",
                                                       "recent_negative", "avg_negative")


def record_alerts(alerts: DataFrame, path: str, alerted_at=None) -> None:
    """Append fired alerts (with time) to a Parquet history table."""
    ts_col = (F.current_timestamp() if alerted_at is None else
              alerted_at if isinstance(alerted_at, Column) else F.lit(alerted_at))
    alerts.withColumn("alerted_at", ts_col).write.mode("append").parquet(path)


def alert_history(history: DataFrame, keep: int = 100) -> DataFrame:
    """The newest ``keep`` alerts (time, rule, message, stats); ties by app and rule."""
    ties = [F.col(c) for c in ("app_id", "rule", "message") if c in history.columns]
    return history.orderBy(F.col("alerted_at").desc(), *ties).limit(keep)
