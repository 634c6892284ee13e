"""Connected components by joins: smallest label, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.workspace import materialise


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every end of ``edges`` (a, b); the component is its smallest node.

    Every round takes the smallest label among the neighbours (a partial
    aggregate, so a hub is never gathered in one task) and then the label's own
    label, which halves path lengths. Labels live in written tables, so lineage
    stays short and nothing but a flag reaches the driver. Null ends are ignored;
    loops and repeated edges change nothing.
    """
    edges = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a is not null and b is not null")
    both = materialise(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = materialise(step.join(jump, "label").select("node", "was", F.least("label", "far").alias("label")), "labels")
        if after.where("was <> label").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
