"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), for nodes with links.

    Each round takes the least label of a node and its neighbours, then follows
    the label to its own label. Rounds are written to the shared folder; only
    whether a row has changed reaches the driver.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("next")))
    edges = materialize(both.where("node IS NOT NULL AND next IS NOT NULL").distinct(), "edges")
    labels = materialize(edges.groupBy("node").agg(F.min(F.least("node", "next")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = edges.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        after = materialize(step.join(jump, "to").select("node", F.least("to", "jump").alias("component"), "was"), "labels")
        labels = after.select("node", "component")
        if after.where("component <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")
