"""Connected components of a distributed edge list.

Each round takes the smallest label among a node's neighbours, hooks the node's own label to
it too, and then follows the label's own label (pointer jumping), so rounds grow with the logarithm of a component's width. Every
round is cut to the shared folder; nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge, label being its component's smallest node.

    ``edges`` should be cheap to count (a written table).
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut(both.union(both.select("v", "u")).distinct(), "edges", 2 * edges.count())
    size = both.count()  # nodes are no more than directed edges
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels", size)
    for _ in range(MAX_ROUNDS):
        near = (
            both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v")
            .groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        )
        seen = labels.join(near, "node")
        hooks = seen.select("node", "near").union(seen.select(F.col("label").alias("node"), "near"))
        own = labels.join(hooks.groupBy("node").agg(F.min("near").alias("near")), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = cut(own.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels", size)
        moved = after.where("old <> label").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
