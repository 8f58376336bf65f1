"""Graph reports: select, induce, collapse, aggregate, number."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.functions.patterns import Filter
from edgeloom.operators import traversal
from edgeloom.plans import edges as E
from edgeloom.plans.collapse import Collapse
from edgeloom.plans.lineage import cut


@dataclass
class Query:
    focus: list[tuple[Filter, int]] = field(default_factory=list)
    reachable_from: list[Filter] = field(default_factory=list)
    dependents_of: list[Filter] = field(default_factory=list)
    include_external: bool = False
    include_self: bool = False
    collapse: Collapse | None = None
    title: str = "Dependency graph"


@dataclass
class Snapshot:
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame
    title: str


def select_nodes(edges: DataFrame, query: Query) -> DataFrame:
    """The union of all selections; without any, all nodes."""
    everything = E.nodes(edges, include_external=True)
    parts = [traversal.focus(edges, everything.filter(f.column("label")), d) for f, d in query.focus]
    parts += [traversal.reachable_from(edges, everything.filter(f.column("label"))) for f in query.reachable_from]
    parts += [traversal.dependents_of(edges, everything.filter(f.column("label"))) for f in query.dependents_of]
    if not parts:
        return everything
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def aggregate(edges: DataFrame, collapse: Collapse | None = None, include_self: bool = False) -> DataFrame:
    """(source, target, count, external, kinds) after collapsing; external if any edge is."""
    fold = collapse or (lambda c: c)
    folded = edges.withColumns({"source": fold(F.col("source")), "target": fold(F.col("target"))})
    folded = folded if include_self else folded.filter("source <> target")
    mask = F.bit_or(E.kind_mask("kinds"))
    out = folded.groupBy("source", "target").agg(F.count(F.lit(1)).alias("count"), F.bool_or("external").alias("external"), mask.alias("kinds"))
    return out.withColumn("kinds", E.kinds_of(F.col("kinds")))


def numbered(labels: DataFrame) -> DataFrame:
    """(id, label): n0, n1, .. in the order of the labels.

    Ranges are sorted in parallel; only their sizes are summed over all.
    """
    # cut, so that both uses below see the ranges of one evaluation
    parts = cut(labels.repartitionByRange("label").sortWithinPartitions("label").select("label", F.spark_partition_id().alias("p")))
    own = F.row_number().over(Window.partitionBy("p").orderBy("label"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", before.alias("before"))
    out = parts.withColumn("own", own).join(sizes, "p")
    return out.select(F.concat(F.lit("n"), (F.col("before") + F.col("own") - 1).cast("string")).alias("id"), "label")


def snapshot(edges: DataFrame, query: Query | None = None) -> Snapshot:
    query = query or Query()
    edges = edges if query.include_external else edges.filter("not external")
    selected = select_nodes(edges, query)
    raw = E.induced(edges, selected)
    raw = raw if query.include_self else raw.filter("source <> target")
    shown = aggregate(raw, query.collapse, query.include_self)
    fold = query.collapse or (lambda c: c)
    ends = shown.select(F.col("source").alias("label")).union(shown.select("target"))
    labels = selected.select(fold(F.col("label")).alias("label")).union(ends).distinct()
    counts = raw.agg(F.count(F.lit(1)).alias("raw_edge_count"), F.count_if("external").alias("external_edge_count"))
    summary = labels.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(shown.agg(F.count(F.lit(1)).alias("edge_count"))).crossJoin(counts)
    return Snapshot(numbered(labels), shown, summary, query.title)
