"""Benchmark: headline operator groups on the derived review view.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``
and prints one JSON line. Each query is fully evaluated with the ``noop`` sink
(no driver collection); timing = median of 3 runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plaudit.plans import catalog  # noqa: E402
from plaudit.session import get_session, scratch_path  # noqa: E402

HEADLINE = {
    "enrich_sentiment": "enrich_sentiment",
    "quality_score": "quality_score",
    "detect_issues": "detect_issues",
    "segment_players": "segment_players",
    "stats_by_game": "stats_by_game",
    "box_stats_playtime": "box_stats_playtime",
    "weekly_sentiment": "weekly_sentiment",
    "detect_anomalies": "detect_anomalies",
    "forecast_rate_weekly": "forecast_rate_weekly",
    "keyword_counts": "keyword_counts",
    "polarity_keywords": "polarity_keywords",
    "detect_versions": "detect_versions",
    "update_impact": "update_impact",
    "recommend_reviews": "recommend_reviews",
    "benchmark_games": "benchmark_games",
    "rank_games": "rank_games",
}


def staged(spark, sf_dir: str, parts: int) -> str:
    """The read tables rewritten as ``parts`` files each: the test tables are single
    row groups, which one task would read alone. Part of no timing."""
    to = scratch_path(spark, f"bench-{uuid.uuid4().hex}")
    for name in ("documents", "events", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts).write.parquet(f"{to}/{name}.parquet")
    return to


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    spark = get_session(f"local[{cpus}]", "plaudit-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    sf_dir = staged(spark, sf_dir, int(cpus) * 2)
    n_reviews = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = {}
    for name, key in HEADLINE.items():
        fn = catalog.QUERIES[key]
        times = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    total = round(sum(out.values()), 3)
    print(json.dumps({"metric": "headline_operator_groups_total", "value": total, "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "reviews": n_reviews,
                      "reviews_per_sec_all_groups": round(n_reviews / total, 1) if total else None}))
    spark.stop()


if __name__ == "__main__":
    main()
