"""Connected components by repeated min-label joins, nothing held on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import drop, stage


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the least node of its component.

    Each round every node takes the least label among its neighbours, then the
    label of its label, so paths shorten by more than half. Edges are counted
    up by partial aggregation, so a hub costs one row a task. Rounds go on until
    no label changes; every round is written to the shared folder.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = stage(both.select("a", "b").union(both.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        step = stage(low.join(jump, "low").select("node", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("moved")), "labels")
        drop(labels)
        labels = step.select("node", "root")
        if step.where("moved").isEmpty():
            drop(both)
            return labels
