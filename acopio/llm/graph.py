"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: BIGINT): the smallest node reachable.

    Each round a node takes the smallest root among its neighbours', then its root's root, so the number
    of rounds follows the logarithm of the longest chain. Rounds end when no root changed. Neighbours
    are reduced before the shuffle, and labels are written between rounds. ``edges`` is computed once.
    """
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(edges.select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
                .withColumnRenamed("a", "node"))
        best = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        roots = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = best.join(roots, "root").select("node", "old", F.least("root", "up").alias("root"))
        new = stage(new, "labels")
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return labels
