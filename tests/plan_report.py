"""Summarise the physical plan of every registered query (writes PLANS.md).

    python tests/plan_report.py [sf_dir]
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = ["Exchange hashpartitioning", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin",
         "WindowGroupLimit", "HashAggregate", "ArrowEvalPython", "FlatMapGroupsInPandas",
         "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]
SKIP = {"stream_graph_events"}   # runs a stream when called; its batch plan is graph_events_flat


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from newsgraph.session import get_session
    spark = get_session("local[4]")
    spark.sparkContext.setLogLevel("ERROR")
    rows = []
    for name, fn in E.queries().items():
        if name in SKIP:
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(re.escape(k), plan)) for k in KINDS]
        rows.append((name, counts))
    out = ["# Physical plans (sf0.01, AQE initial plan)", "",
           "Counts of plan nodes per registered query. Generated by `tests/plan_report.py`.", "",
           "| query | " + " | ".join(k.replace("Exchange hashpartitioning", "shuffle") for k in KINDS) + " |",
           "| --- |" + " --- |" * len(KINDS)]
    out += [f"| `{n}` | " + " | ".join(str(c) for c in cs) + " |" for n, cs in rows]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    open(path, "w").write("\n".join(out) + "\n")
    print(path)


if __name__ == "__main__":
    main(sys.argv)
