"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges (a, b).

    Each round takes the smallest label of the neighbours, then the label of
    that label; rounds grow with the logarithm of the longest path.  Labels
    stay distributed; only the number of changes comes to the driver.  Hot
    nodes: minima are combined before the shuffle, and joins can be split.
    """
    both = written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        least = written(least, "least")
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = written(
            least.join(jump, "component").select("node", F.least("component", "next").alias("component"), "was"), "labels"
        )
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
