"""Report tables: one read of the frame, defined results for odd rows."""

import pytest

from plaudit.operators import reports as rp
from plaudit.sources.fixtures import reviews

SCHEMA = "recommendation_id string, app_id string, review string, timestamp_created long, voted_up int"


def _scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("parquet")


@pytest.mark.parametrize("table", [rp.comprehensive_table, rp.version_table])
def test_reads_the_frame_once(spark, table):
    df = reviews(spark, "/root/testdata/sf0.001")
    assert _scans(table(df)) == _scans(df)


def test_odd_rows(spark):
    rows = [("1", "a", "v1.5.2 good", 1_700_000_000, 1), ("2", "a", None, None, None), ("3", None, "", 0, 0),
            ("4", "a", "1.5.2", 1_700_000_000 + 21 * 86_400, 0), ("4", "a", "1.5.2", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("total", rp.F.lit(1))
    got = {(r.app_id, r.section, r.item): r for r in rp.comprehensive_table(df).collect()}
    assert got["a", "comparison", "positive_rate"].value == pytest.approx(100 / 3)
    assert got["a", "trend", None]["count"] == 2 and got["a", "trend", "2023-11-14"].value == 1.0
    assert got[None, "quality", "std"].value is None and got[None, "quality", "p50"]["count"] == 1
    assert sum(r["count"] for k, r in got.items() if k[:2] == ("a", "segment")) == 4
    v = sorted(rp.version_table(df).collect(), key=lambda r: (r.section, str(r.week)))
    assert (v[0].section, v[0].version, v[0].total, v[0].positive, v[0].rank) == ("version", "1.5.2", 3, 1, 1)
    assert [(r.total, r.positive) for r in v[1:]] == [(1, 1), (0, 0), (0, 0), (1, 0)]
    empty = df.where("false")
    assert rp.comprehensive_table(empty).collect() == [] and rp.version_table(empty).collect() == []
    whole = rp.comprehensive_table(df, None).where("section = 'quality' and item = 'mean'").collect()
    assert [r["count"] for r in whole] == [5]
