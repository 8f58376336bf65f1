"""Connected components of undirected links by alternating star joins.

Neither links nor labels leave the executors; the driver only sees two sums per
round.  A node of very many links is met by partial aggregation and by joins
whose large partitions adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.lineage import cut


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of all ends of ``links`` (a, b); a component is its smallest node.

    With ``rounds`` it stops after so many contractions: nodes of one component
    may then still have several labels, but never do two components share one.
    Links of a node with itself and repeated links are harmless; null ends are
    ignored.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, done = None, 0
    while rounds is None or done < rounds:
        edges = cut(_small_star(_large_star(edges)))
        done += 1
        if rounds is None:
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return labels.unionByName(roots.join(labels, "node", "left_anti").withColumn("component", F.col("node")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, and it itself, are linked to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = edges.join(low, F.col("v") == F.col("w")).select(F.col("u"), F.col("m").alias("v"))
    return moved.unionByName(low.filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    moved = edges.join(low, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
