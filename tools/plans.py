"""Per query: shuffles, single-partition exchanges, nested-loop joins, Python stages in the physical plan."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from check_oracle import session  # noqa: E402


def main():
    import suite

    spark = session()
    for name, fn in suite.QUERIES.items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        plan = fn(spark, f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}")._jdf.queryExecution().executedPlan().toString()
        count = {k: plan.count(v) for k, v in {
            "shuffle": "Exchange hashpartitioning", "single": "Exchange SinglePartition", "nested": "BroadcastNestedLoopJoin",
            "cartesian": "CartesianProduct", "smj": "SortMergeJoin", "bhj": "BroadcastHashJoin", "window": "Window [",
            "python": "InPandas"}.items()}
        print(f"{name:26s}", "  ".join(f"{k}={v}" for k, v in count.items() if v))
        if sys.argv[2:]:
            print(plan)
    spark.stop()


if __name__ == "__main__":
    main()
