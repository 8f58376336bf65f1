"""Reachability over edges by semi-naive joins.

Each round joins only the frontier with the edges and drops what was visited, so a
round costs what it discovers.  Lineage is cut every round in the shared folder.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.lineage import cut


def _links(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.filter("source <> target").select(F.col("source").alias("at"), F.col("target").alias("next"))
    back = edges.filter("source <> target").select(F.col("target").alias("at"), F.col("source").alias("next"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


#: Layers of a walk that lie apart before they are written together.
LAYERS = 8


def spread(links: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """All labels that ``links`` (at, next) reach from ``seeds`` (label), seeds included.

    Links are dealt by ``at`` once and kept so for all rounds; what was visited is written
    together every ``LAYERS`` rounds only, and the last layers are joined beside it.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = links.repartition(parts, "at").persist()
    layers = [cut(seeds)]
    try:
        for done in itertools.count():
            if done == depth:
                break
            reached = layers[-1].withColumnRenamed("label", "at").join(held, "at").select(F.col("next").alias("label")).distinct()
            fresh = cut(reached.join(reduce(DataFrame.union, layers), "label", "left_anti"))
            if fresh.isEmpty():
                break
            layers.append(fresh)
            if len(layers) > LAYERS:
                layers = [cut(reduce(DataFrame.union, layers[:-1]).coalesce(parts)), fresh]
        return reduce(DataFrame.union, layers)
    finally:
        held.unpersist()


def walk(edges: DataFrame, seeds: DataFrame, direction: str = "out", depth: int | None = None) -> DataFrame:
    """All labels in reach of ``seeds`` (label), seeds included; at most ``depth`` steps if given."""
    return spread(_links(edges, direction), seeds.select("label").distinct(), depth)


def focus(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    return walk(edges, seeds, "both", depth)


def reachable_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return walk(edges, seeds, "out")


def dependents_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return walk(edges, seeds, "in")
