"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``: component is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the label
    of that label, so that chains shorten geometrically. Rounds are written to the
    shared folder; hubs are summed up before the shuffle.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = materialize(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("further"))
        moved = materialize(step.join(jump, "new", "left").select("node", "old", F.least("new", "further").alias("component")), "labels")
        done = moved.where("old <> component").limit(1).count() == 0
        labels = moved.select("node", "component")
        if done:
            return labels
