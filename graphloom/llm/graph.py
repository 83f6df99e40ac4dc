"""Connected components of links between binary keys, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then the label's own label, so
    the rounds grow with the logarithm of the longest chain. Labels are written between rounds; only
    the number of changes comes to the driver.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
    edges = written(both.where("node != near").distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        low = edges.join(labels.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("low"))
        step = labels.join(low, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = written(step.join(root, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
        changed = step.where("was != label").count()
        labels = step.select("node", "label")
        if not changed:
            return labels
