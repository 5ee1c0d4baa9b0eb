"""Connected components of links, by smallest label: joins and minima only, a table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.sources.stage import Stages


def connected_components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a, b): comp is the smallest node reachable.

    Each round takes the smallest label next to a node and then that label's own label, so a star
    ends after two rounds and a chain of n after about log n.  Minima are combined before the
    shuffle, so a node with very many links is no single task.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stages.save(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
    labels = stages.save(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("node").alias("over"), F.col("comp").alias("beyond"))
        step = step.join(jump, step["comp"] == jump["over"]).select("node", "old", F.least("comp", "beyond").alias("comp"))
        step = stages.save(step, "step")
        stages.drop(labels)
        labels = step
        if not step.where("old <> comp").limit(1).count():
            stages.drop(both)
            return step.select("node", "comp")
