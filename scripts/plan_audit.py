"""Audit the physical plans of all registered queries.

Flags Cartesian products / nested-loop joins, windows without a partition key
over raw rows, and Python UDF evaluation; prints one line per query.
usage: python scripts/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plaudit.plans import catalog  # noqa: E402
from plaudit.session import get_session  # noqa: E402

SKIP = {"topic_model_lda", "topic_summary_lda", "topic_model_nmf", "toxicity_baseline"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session("local[4]", shuffle_partitions=4)
    for name, fn in catalog.QUERIES.items():
        if name in SKIP or name.startswith("stream_"):
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        flags = []
        if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan):
            flags.append("NESTED-LOOP/CARTESIAN")
        if "ArrowEvalPython" in plan or "BatchEvalPython" in plan:
            flags.append("python-udf")
        n_ex = len(re.findall(r"Exchange", plan))
        wgl = "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan
        print(f"{name:38s} exchanges={n_ex:2d} topk-pushdown={wgl!s:5s} {' '.join(flags)}")
    spark.stop()


if __name__ == "__main__":
    main()
