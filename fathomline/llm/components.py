"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node it is joined to, of every node in ``links`` (columns a, b).

    Each round takes the smallest label among a node, its neighbours and the neighbours of all nodes that it labels, then the label of that label. A
    region's root thus moves with the region, and rounds grow with the logarithm of a chain. Labels only fall, so it ends, and only when nothing changes.
    All steps are joins with one row per link or node, pre-aggregated by node, so a node with very many links is no task of its own.
    """
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(near, "node")
        hook = near.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        step = near.join(hook, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near", "hook").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        moved = staged(step, "cc-labels")
        changed = not moved.filter(F.col("old") != F.col("label")).isEmpty()
        discard(labels)
        labels = moved.select("node", "label")
        if not changed:
            return labels
