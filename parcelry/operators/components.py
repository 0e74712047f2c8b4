"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.sources.scratch import discard, keep


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs to (node, component): the smallest node each one is linked with.

    Edges may repeat, point either way or join a node with itself; an edge with a null end is
    ignored. Each round takes the smallest label among a node's neighbours and then the label of that label, so
    the number of rounds follows the logarithm of the longest path, not its length. Every round is
    written down; nothing but the number of changes reaches the driver.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = keep(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = keep(labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("next"), (F.col("near") < F.col("component")).alias("moved")), "step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = keep(step.join(jump, "next").select("node", F.least("next", "far").alias("component"), (F.col("moved") | (F.col("far") < F.col("next"))).alias("moved")), "labels")
        discard(labels, step)
        labels = new
        if not new.filter("moved").head(1):
            discard(both)
            return labels.drop("moved")
