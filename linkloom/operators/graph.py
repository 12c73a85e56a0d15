"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import Scratch


def connected_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``nodes(node, label)`` and ``edges(a, b)`` -> ``(node, label)`` with the smallest label of each component.

    Each round sends every node's label over the edges and then lets a node take
    the label of the node that owns its current label (pointer jumping), so the
    rounds grow with the logarithm of the diameter. Labels are written to the
    shared folder after each round; nothing but one flag reaches the driver.
    A node without edges keeps its label. Edges may repeat or be loops; those with
    a null end or an end outside ``nodes`` are ignored.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "components")
    both = edges.select("a", "b").where("a <> b")
    both = scratch.table("edges", both.union(both.select("b", "a")))
    owners = nodes.select(F.col("node").alias("owner"), F.col("label").alias("first"))
    labels = nodes.select("node", "label")
    while True:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        low = labels.join(heard, "node", "left").select("node", F.least("label", "heard").alias("low"), F.col("label").alias("was"))
        low = scratch.table("low", low)
        owned = owners.join(low.select(F.col("node").alias("owner"), F.col("low").alias("jump")), "owner").groupBy(F.col("first").alias("low")).agg(F.min("jump").alias("jump"))
        new = scratch.table("labels", low.join(owned, "low", "left").select("node", F.least("low", "jump").alias("label"), "was"))
        labels = new.select("node", "label")
        if new.where("label < was").isEmpty():
            return labels
