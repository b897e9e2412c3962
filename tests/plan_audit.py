"""Print what each query's physical plan contains: ``python -m tests.plan_audit SF_DIR``."""

import re
import sys

from demandloom import get_spark
from demandloom.plans.catalog import QUERIES

MARKS = {
    "cartesian": "CartesianProduct", "nested": "BroadcastNestedLoopJoin", "python": "ArrowEvalPython|BatchEvalPython|MapInPandas",
    "smj": "SortMergeJoin", "shj": "ShuffledHashJoin", "bhj": "BroadcastHashJoin", "window": r"\+- Window|Window \[",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def marks(plan: str) -> dict[str, int]:
    found = {name: len(re.findall(pattern, plan)) for name, pattern in MARKS.items()}
    found["exchange"] = len(re.findall(r"Exchange (?:hash|range|single|round)", plan))
    found["single"] = len(re.findall(r"Exchange SinglePartition", plan))
    return {k: v for k, v in found.items() if v}


if __name__ == "__main__":
    spark = get_spark(master="local[4]")
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or QUERIES:
        print(name, marks(plan_of(QUERIES[name](spark, sys.argv[1]))), flush=True)
