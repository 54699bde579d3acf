"""Exact quantiles on heavy tails, ties and small groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.operators import stats


def test_heavy_tail_is_exact_and_balanced(spark):
    """One far outlier and a third of all rows equal: brackets stay small and exact."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("app_id"),
        F.when(F.col("id") == 3, F.lit(1e15)).when(F.col("id") % 5 == 0, F.lit(0.0))
        .otherwise(F.exp(F.col("id") % 40_000 / 2000.0)).alias("v"))
    got = {r["app_id"]: r for r in stats.describe_scores(df, "v", ["app_id"]).collect()}
    rows = df.toPandas()
    for app, g in rows.groupby("app_id"):
        want = np.quantile(g["v"], [0.25, 0.5, 0.75])
        assert [got[app][c] for c in ("p25", "p50", "p75")] == pytest.approx(list(want), rel=1e-12)
    counts = stats._value_counts(df, ["app_id"], "v")
    sketch = df.groupBy("app_id").agg(F.percentile_approx("v", [0.25 - stats.BRACKET, 0.25 + stats.BRACKET],
                                                          stats.SKETCH_ACCURACY).alias("e"))
    share = counts.join(sketch, "app_id").groupBy("app_id").agg(
        F.avg(F.col("_v").between(F.col("e")[0], F.col("e")[1]).cast("int")).alias("s")).agg(F.max("s")).first()[0]
    assert share <= 0.01


@pytest.mark.parametrize("values", [[7.0], [1.0, 2.0], [3.0] * 50, [1.0, 1.0, 9.0, None], list(range(101))])
def test_small_groups(spark, values):
    df = spark.createDataFrame([("a", None if v is None else float(v)) for v in values], "app_id string, v double")
    r = stats.describe_scores(df, "v", ["app_id"]).first()
    want = np.quantile([v for v in values if v is not None], [0.25, 0.5, 0.75])
    assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(list(want))


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "app_id string, v double")
    r = stats.describe_scores(df, "v", ["app_id"]).first()
    assert r["count"] == 0 and r["p50"] is None
    assert stats.describe_scores(df.where("false"), "v", ["app_id"]).count() == 0
