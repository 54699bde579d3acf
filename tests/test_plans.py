"""Physical-plan properties that matter at scale."""

import re

import pytest

from plaudit.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["latest_per_app", "recommend_reviews", "keyword_counts_by_app",
                                  "polarity_keywords", "trending_versions"])
def test_per_group_top_n_is_limited_before_shuffle(spark, name):
    assert "WindowGroupLimit" in _plan(spark, name)


@pytest.mark.parametrize("name", ["keyword_counts", "bigram_counts", "get_reviews", "recent_votes"])
def test_global_top_n_uses_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in _plan(spark, name)


@pytest.mark.parametrize("name", ["keyword_summary", "histogram_playtime", "bin_counts_playtime",
                                  "evaluate_alerts", "update_impact", "benchmark_games",
                                  "enrich_sentiment", "with_game_name"])
def test_no_cartesian_or_nested_loop(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", _plan(spark, name))


def test_filters_reach_the_scan(spark):
    plan = _plan(spark, "reviews_table_roundtrip")
    assert "PartitionFilters: [isnotnull(app_id" in plan and "PushedFilters" in plan


@pytest.mark.parametrize("name", ["box_stats_playtime", "box_stats_length", "histogram_playtime", "describe_playtime"])
def test_rows_are_not_dealt_by_the_group_alone(spark, name):
    """Only rows that are already one per group meet by the group's key."""
    plan = _plan(spark, name)
    for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        names = [re.sub(r"#.*", "", k).strip() for k in keys.split(",")[:-1]]
        if set(names) <= {"voted_up", "app_id", "_g"}:
            below = plan[plan.index(f"hashpartitioning({keys})"):]
            # the rows come out of an aggregate, not of a scan or a join of scans
            assert 0 <= below.find("Aggregate(keys=") < below.find("Scan parquet"), names


def test_view_reads(spark):
    """The filters' counts read every table of the view once."""
    assert _plan(spark, "review_filters").count("Scan parquet") == 3
