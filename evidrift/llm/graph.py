"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). node and root (the smallest node of its component) of every node that has an edge.

    Each round takes the least label of the neighbours and then the label's own label, so that chains halve; rounds end
    when no label changes. Labels and edges stay distributed; the driver sees a count a round. Sums before the shuffle and
    joins that Spark can split keep a node with very many edges from gathering in one task."""
    both = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.where("a <> b").select(F.explode(both).alias("e")).select("e.a", "e.b").distinct())
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        closer = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        moved = stored(closer.join(jump, "to", "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("root"), (F.least("to", F.coalesce("beyond", "to")) < F.col("root")).alias("changed")))
        forget(labels)
        labels = moved.select("node", "root")
        changed = moved.where("changed").count()
        labels._stored_at = moved._stored_at
        if not changed:
            forget(edges)
            return labels
