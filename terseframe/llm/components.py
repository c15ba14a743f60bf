"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node of the component.

    Every round takes the smallest label among neighbours and then that label's own label. Tables are
    written between rounds, so a lost executor repeats one round's tasks at most; joins are between
    plain tables, which lets adaptive execution split the rows of a node with many neighbours.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        near = labels.join(seen, "node").select("node", F.least("label", "_near").alias("label"), F.col("label").alias("_old"))
        near = materialise(near, "cc-near")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        new = materialise(near.join(up, "label", "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), "_old"), "cc-labels")
        labels = new.select("node", "label")
        if new.where("label <> _old").limit(1).count() == 0:
            return labels
