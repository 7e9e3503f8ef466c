"""Connected components of distributed edges between numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..heavy import join_unique
from ..tables import cut, discard

#: More rounds than a graph of 2**63 nodes needs.
MAX_ROUNDS = 130


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge with its component's smallest node.

    Each round a node takes the smallest label around it, gives it to its own label too, and follows
    its label's label, so rounds grow with the logarithm of a component's width. Nodes with very many
    neighbours are joined by broadcast.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut(both.union(both.select("v", "u")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label"), F.count(F.lit(1)).alias("n")), "labels")
    for _ in range(MAX_ROUNDS):
        around = join_unique(both, labels.select(F.col("node").alias("v"), F.col("label").alias("near"), "n"), ["v"], "n")
        near = around.groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        seen = cut(labels.join(near, "node"), "seen")
        hooks = seen.select("node", "near").union(seen.select(F.col("label").alias("node"), "near")).groupBy("node").agg(F.min("near").alias("near"))
        own = cut(seen.drop("near").join(hooks, "node").select("node", "n", F.col("label").alias("old"), F.least("label", "near").alias("label")), "own")
        sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("times"))
        far = sizes.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        after = cut(join_unique(own, cut(far, "far"), ["label"], "times").select("node", "n", "old", F.least("label", "far").alias("label")), "labels")
        moved = after.where("old <> label").limit(1).count()
        for table in (labels, seen, own):
            discard(table)
        if not moved:
            return after.select("node", "label")
        labels = after.drop("old")
    raise RuntimeError("components did not settle")
