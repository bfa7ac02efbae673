"""Connected components of an edge table, by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of `edges` (a, b): label is the least node it can reach.

    Each round takes the least label among neighbours (map-side minima, so a node with very
    many neighbours is no large group), then the label of that label. Rounds end when no
    label changes; each is written to the shared folder, which bounds the lineage.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = settle(both, "edges")
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = lower.join(up, "label", "left").select("node", "old", F.least("label", "jump").alias("label"))
        moved = settle(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels
