"""Connected components of a graph given by its edges, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its least node.

    Each round takes the least label among a node and its neighbours, then the label of that
    label.  Neighbours are never gathered: minima combine before their shuffle, and a hub's
    edges may be split over tasks.  Rounds end when no label changes.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = settle(ordered.unionByName(ordered.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        target = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        labels = settle(
            spread.join(target, F.col("label") == F.col("to"), "left").select(
                "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
            )
        )
        changed = labels.where("label < old").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
