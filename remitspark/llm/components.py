"""Connected components of a link table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, *, start: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b); the label is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label's own label, so paths shorten by more than
    half; only the number of changed nodes comes to the driver. ``start`` gives labels known before (node, label).
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    if start is not None:
        nodes = nodes.unionByName(start.select("node", "label"))
    labels = stored(nodes.groupBy("node").agg(F.min("label").alias("label")))
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("heard"))
        # what a node hears its label hears too, so whole components move at once
        met = labels.join(heard, labels["node"] == heard["to"], "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("best"))
        met = stored(met)
        raised = met.groupBy(F.col("label").alias("root")).agg(F.min("best").alias("root_best"))
        moved = met.join(raised, met["label"] == raised["root"]).select("node", F.col("label").alias("old"), F.least("best", "root_best").alias("mid"))
        moved = stored(moved)
        jump = moved.select(F.col("node").alias("at"), F.col("mid").alias("further"))
        out = stored(moved.join(jump, moved["mid"] == jump["at"], "left").select("node", "old", F.coalesce("further", "mid").alias("label")))
        changed = out.filter("old <> label").isEmpty()
        labels = out.select("node", "label")
        if changed:
            return labels
