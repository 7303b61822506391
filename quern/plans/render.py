"""Plans as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def render(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan that Spark explains, or with ``query`` the tree of operators before it is optimized."""
    if mode == "query":
        return df._jdf.queryExecution().logical().treeString()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def count_operators(df: DataFrame) -> dict[str, int]:
    """How many exchanges, scans, joins and Python steps the plan has."""
    text = df._jdf.queryExecution().executedPlan().toString()
    names = ("Exchange hashpartitioning", "BroadcastExchange", "FileScan", "SortMergeJoin", "BroadcastHashJoin", "MapInArrow", "HashAggregate", "SortAggregate", "BroadcastNestedLoopJoin")
    return {n: text.count(n) for n in names}
