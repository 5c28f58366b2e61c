"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label): label is the least node reachable; nodes without links have no row.

    A round takes the least label among a node's neighbours, then the label of that label, so rounds
    grow with the logarithm of a component's width.  All steps are joins and aggregations with partial sums.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        roots = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        moved = written(lower.join(roots, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("label <> was").limit(1).count():
            return labels
