"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node reachable.

    Each round takes the least label among a node's neighbours and its label's label, so
    chains shorten geometrically. All state is in written tables; no links or labels reach
    the driver, only whether anything changed. Both sides of the joins on hot labels are
    table reads, which adaptive execution can split.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    changed = not state.isEmpty()
    while changed:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        above = state.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = state.join(above, "label").join(near, "node")
        best = F.least("label", "above", "near")
        moved = written(step.select("node", best.alias("label"), (best < F.col("label")).alias("moved")), "labels")
        changed = not moved.where("moved").isEmpty()
        discard(state)
        state = moved.drop("moved")
    discard(both)
    return state
