"""Per-query physical plan summary (the plan Spark starts from; AQE may
turn sort-merge joins into broadcast joins and coalesce partitions at run time).

    python tools/plan_report.py /root/testdata/sf0.1 [name ...] > PLANS.md

For each registered query: shuffles (hash / range / single), broadcasts,
aggregates (hash / sort), joins by kind, scans with pushed filters, and
whether any Python evaluation appears in the plan.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from innkeep.plans import catalog  # noqa: E402
from innkeep.session import get_spark  # noqa: E402

PATTERNS = {
    "hash shuffle": r"Exchange hashpartitioning",
    "range shuffle": r"Exchange rangepartitioning",
    "single-partition": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "hash agg": r"\bHashAggregate\(",
    "sort agg": r"\bSortAggregate\(",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "scans": r"FileScan parquet|Scan ExistingRDD",
    "python": r"BatchEvalPython|ArrowEvalPython|PythonUDF|FlatMapGroupsInPandas",
}


def summarise(plan: str) -> dict[str, int]:
    return {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}


def main() -> None:
    directory = sys.argv[1]
    names = sys.argv[2:] or catalog.names()
    spark = get_spark("local[8]", conf={"spark.sql.shuffle.partitions": "16"})
    print("| query | " + " | ".join(PATTERNS) + " |")
    print("| --- | " + " | ".join("---" for _ in PATTERNS) + " |")
    totals: Counter = Counter()
    for name in names:
        df = catalog.build(name, spark, directory)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        totals.update(s)
        print(f"| {name} | " + " | ".join(str(s[k]) for k in PATTERNS) + " |")
    print("| **total** | " + " | ".join(str(totals[k]) for k in PATTERNS) + " |")


if __name__ == "__main__":
    main()
