"""Connected components of an edge table, without the edges ever reaching the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, filed, heavy_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of the component.

    Labels start as the nodes themselves. Each round takes the least label of the neighbours and then the label of that
    label, so long paths shrink by half at least; rounds end when no label changes. Each round's labels are written to
    the shared folder as a table (a checkpoint hands its plan's constraints on, which multiply from round to round), and
    deleted when the next round's are there. Nodes of very many neighbours, and roots of very many nodes, are dealt out over tasks. No edges
    give no rows.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct())
    total = both.count()
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), "degree"))
    held = None
    while True:
        near = heavy_join(both, labels.select(F.col("node").alias("b"), "root", "degree"), ["b"], "degree", total=total).groupBy("a").agg(F.min("root").alias("m"))
        lower = filed(labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "degree", F.col("root").alias("old"), F.least("root", "m").alias("root")))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next")).join(lower.groupBy("root").agg(F.count(F.lit(1)).alias("nodes")), "root")
        after = filed(heavy_join(lower, jump, ["root"], "nodes", "left", total=total).select("node", "degree", "old", F.least("root", "next").alias("root")))
        discard(lower)
        if held is not None:
            discard(held)
        held = after
        moved = after.where(F.col("old") != F.col("root")).limit(1).count()
        labels = after.drop("old")
        if not moved:
            return labels.drop("degree")
