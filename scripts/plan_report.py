"""Physical-plan summary of every registered query -> PLANS.md.

Usage: python scripts/plan_report.py [sf_dir]
Counts, per query, the shuffles (hash / range / single partition), broadcast
exchanges, aggregate operators and joins in the executed (pre-AQE) plan, and
flags anything that should never appear (Python UDF, cartesian product,
nested-loop join).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from batchtrail.plans.registry import all_queries  # noqa: E402
from batchtrail.session import build_session  # noqa: E402

PATTERNS = {
    "hash shuffles": r"Exchange hashpartitioning",
    "range shuffles": r"Exchange rangepartitioning",
    "single-partition": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "hash agg": r"\bHashAggregate\(",
    "sort agg": r"\bSortAggregate\(",
    "object agg": r"ObjectHashAggregate\(",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "windows": r"\bWindow \[",
}
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 16)
    rows = []
    for key, fn in all_queries().items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(p, plan)) for p in PATTERNS.values()]
        bad = [f for f in FORBIDDEN if f in plan]
        rows.append((key, counts, bad))
    out = ["# PLANS — physical plan summary per registered query", "",
           f"Generated by `scripts/plan_report.py` on `{sf_dir}` (plans before AQE's runtime changes: at run time",
           "AQE may turn a sort-merge join into a broadcast join and coalesce partitions).", "",
           "| query | " + " | ".join(PATTERNS) + " | forbidden |",
           "| --- | " + " | ".join("---" for _ in PATTERNS) + " | --- |"]
    for key, counts, bad in rows:
        out.append(f"| `{key}` | " + " | ".join(str(c) for c in counts) + f" | {', '.join(bad) or '-'} |")
    totals = [sum(r[1][i] for r in rows) for i in range(len(PATTERNS))]
    out.append("| **total** | " + " | ".join(str(t) for t in totals) + " | |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out) + "\n")
    print(f"wrote {path}: {len(rows)} queries, forbidden in {sum(1 for r in rows if r[2])}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
