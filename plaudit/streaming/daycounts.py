"""Daily counts per app as streaming state, for alerts without reading any history.

The rows of a micro-batch are first counted per (app, day) in each task, so a hot app sends
a few rows per task and not its reviews. ``transformWithState`` then keeps one entry per day
of an app, and the app's first and last day. A batch gives out the days whose numbers or
averages it changes: its own days and the ``lookback`` days after each, the days that a newer
last day adds to the calendar, and those before an older first one. Only these entries are read.

Days are kept for good (three numbers a day), so a row may come however late and no
watermark is needed. Rows without a time are left out; a null vote is not positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "app_id string, day long, total long, positive long, recent_negative long, avg_negative double"


def _per_day(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.Table.from_batches([batch]).group_by(["app_id", "day"]).aggregate(
            [("vote", "count"), ("vote", "sum")])
        yield from counts.select(["app_id", "day", "vote_count", "vote_sum"]).rename_columns(
            ["app_id", "day", "total", "positive"]).to_batches()


class DayCounts(StatefulProcessor):
    def __init__(self, lookback: int):
        self.lookback = lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day long", "total long, positive long")
        self.span = handle.getValueState("span", "first long, last long")

    def _day(self, day: int) -> tuple[int, int]:
        return tuple(self.days.getValue((day,))) if self.days.containsKey((day,)) else (0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[int]] = {}
        for part in rows:
            for day, total, positive in zip(part["day"], part["total"], part["positive"]):
                at = new.setdefault(int(day), [0, 0])
                at[0] += int(total)
                at[1] += int(positive)
        known = {}
        for day, (total, positive) in new.items():
            had = self._day(day)
            known[day] = (had[0] + total, had[1] + positive)
            self.days.updateValue((day,), known[day])
        first, last = min(new), max(new)
        changed = {d + k for d in new for k in range(self.lookback + 1)}
        if self.span.exists():
            old_first, old_last = self.span.get()
            if first < old_first:
                changed.update(range(first, old_first + self.lookback))
            if last > old_last:
                changed.update(range(old_last + 1, last + 1))
            first, last = min(first, old_first), max(last, old_last)
        else:
            changed.update(range(first, last + 1))
        self.span.update((first, last))

        def at(day: int) -> tuple[int, int]:
            if day not in known:
                known[day] = self._day(day)
            return known[day]

        out = []
        for day in sorted(d for d in changed if first <= d <= last):
            total, positive = at(day)
            past = [at(d) for d in range(max(first, day - self.lookback), day)]
            average = sum(t - p for t, p in past) / len(past) if past else None
            out.append((key[0], day, total, positive, total - positive, average))
        yield pd.DataFrame(out, columns=["app_id", "day", "total", "positive", "recent_negative", "avg_negative"])

    def close(self) -> None:
        pass


def changed_days(df: DataFrame, lookback: int = 7) -> DataFrame:
    """A streaming frame of reviews -> (app_id, bucket, total, positive, recent_negative,
    avg_negative) of the days that each micro-batch changes, as ``alert_stats`` has them
    for all reviews so far. Needs the RocksDB state store."""
    day = F.unix_date(F.timestamp_seconds("timestamp_created").cast("date")).cast("long")
    counts = (df.where("timestamp_created is not null")
              .select(F.col("app_id").cast("string").alias("app_id"), day.alias("day"),
                      F.coalesce(F.col("voted_up").cast("long"), F.lit(0).cast("long")).alias("vote"))
              .mapInArrow(_per_day, "app_id string, day long, total long, positive long"))
    stats = counts.groupBy("app_id").transformWithStateInPandas(DayCounts(lookback), OUT, "Update", "None")
    return stats.select("app_id", F.date_from_unix_date(F.col("day").cast("int")).alias("bucket"),
                        "total", "positive", "recent_negative", "avg_negative")
