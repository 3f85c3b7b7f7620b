"""Connected components of links, by smallest label, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of
    that label; a chain of n nodes needs about log n rounds. Nulls and loops are no links.
    The state of a round is written to the shared folder, so a lost executor costs one round.
    """
    links = links.where("a != b").select("a", "b").distinct()
    both = freeze(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = freeze(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        least = (
            near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            .join(labels, "node")
            .select("node", F.col("label").alias("old"), F.least("near", "label").alias("label"))
        )
        # Labels are nodes themselves, so each has a label of its own.
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        stepped = freeze(
            least.join(far, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels"
        )
        labels = stepped.select("node", "label")
        if stepped.where("old != label").isEmpty():
            return labels
