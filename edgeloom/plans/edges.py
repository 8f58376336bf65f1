"""The edge relation: (source, target, external, kinds), one row per pair.

``kinds`` is an array of struct<ord, kind>, sorted by the order in which the kinds
are declared; :func:`kind_names` gives the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In this order kinds are listed (fixed values).
KINDS = ["use", "pub_use", "extern_crate", "mod", "path_reference", "macro_reference"]

_KIND = "array<struct<ord:int,kind:string>>"


def kind_struct(kind: Column) -> Column:
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1
    return F.struct(order.alias("ord"), kind.alias("kind"))


def kind_names(kinds: Column | str) -> Column:
    return F.transform(kinds, lambda k: k["kind"])


def kind_mask(kinds: Column | str) -> Column:
    """The set of kinds as bits, by their order: what grows together in an aggregate stays one number."""
    return F.aggregate(kinds, F.lit(0), lambda mask, k: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1), k["ord"])))


def kinds_of(mask: Column) -> Column:
    """The sorted array of kinds of a :func:`kind_mask`."""
    known = F.array(*(kind_struct(F.lit(k)) for k in KINDS))
    return F.filter(known, lambda k: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), k["ord"])) != 0)


def merge_edges(refs: DataFrame) -> DataFrame:
    """The canonical graph of reference rows (source, target, external, kind).

    References without a target are no edges; a reference to the own file becomes
    the file's plain self-edge; ``external`` is true only if all rows say so.
    """
    own = F.col("source") == F.col("target")
    rows = refs.filter("target is not null").select(
        "source", "target", F.when(own, F.lit(False)).otherwise(F.col("external")).alias("external"),
        F.when(~own & F.col("kind").isNotNull(), kind_struct(F.col("kind"))).alias("kind"),
    )
    return rows.groupBy("source", "target").agg(F.bool_and("external").alias("external"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def self_edges(files: DataFrame, column: str = "identifier") -> DataFrame:
    return files.select(F.col(column).alias("source"), F.col(column).alias("target"), F.lit(False).alias("external"), F.lit(None).cast("string").alias("kind"))


def graph(refs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Merged references, and a self-edge for each file so that isolated files are nodes."""
    rows = refs.select("source", "target", "external", "kind")
    return merge_edges(rows if files is None else rows.unionByName(self_edges(files)))


# ---- projections ----------------------------------------------------------------


def per_edge(edges: DataFrame) -> DataFrame:
    return edges.filter("source <> target")


def per_internal_edge(edges: DataFrame) -> DataFrame:
    return edges.filter("not external and source <> target")


def per_external_edge(edges: DataFrame) -> DataFrame:
    return edges.filter("external and source <> target")


def identity(edges: DataFrame) -> DataFrame:
    return edges


def labelled(edges: DataFrame, source_label: Column, target_label: Column) -> DataFrame:
    """(source_label, target_label, source, target, external, kinds): the evidence of projected edges, a row each; a null label drops the edge."""
    out = edges.select(source_label.alias("source_label"), target_label.alias("target_label"), "source", "target", "external", "kinds")
    return out.filter("source_label is not null and target_label is not null")


def project_edges(edges: DataFrame, source_label: Column, target_label: Column) -> DataFrame:
    """(source_label, target_label, n_edges, any_external, kinds): edges grouped by two labels; :func:`labelled` holds their evidence."""
    grouped = labelled(edges, source_label, target_label).groupBy("source_label", "target_label")
    out = grouped.agg(F.count(F.lit(1)).alias("n_edges"), F.bool_or("external").alias("any_external"), F.bit_or(kind_mask("kinds")).alias("kinds"))
    return out.withColumn("kinds", kinds_of(F.col("kinds")))


def nodes(edges: DataFrame, include_external: bool = False) -> DataFrame:
    """The labels of all nodes; external targets only on request."""
    targets = edges if include_external else edges.filter("not external")
    return edges.select(F.col("source").alias("label")).union(targets.select(F.col("target").alias("label"))).distinct()


def project_to_nodes(edges: DataFrame, include_external: bool = False) -> DataFrame:
    """(label, n_in, n_out); a self-edge only registers its node. :func:`node_edges` holds the edges of each node."""
    ends = node_edges(edges, include_external).select("label", "direction")
    alone = nodes(edges, include_external).select("label", F.lit(None).cast("string").alias("direction"))
    count = lambda d: F.count_if(F.col("direction") == d)
    return ends.unionByName(alone).groupBy("label").agg(count("in").alias("n_in"), count("out").alias("n_out"))


def node_edges(edges: DataFrame, include_external: bool = False) -> DataFrame:
    """(label, direction, source, target, external, kinds): a row for each edge at each of its ends."""
    real = per_edge(edges).select("source", "target", "external", "kinds")
    into = real if include_external else real.filter("not external")
    return real.select(F.col("source").alias("label"), F.lit("out").alias("direction"), "*").unionByName(into.select(F.col("target").alias("label"), F.lit("in").alias("direction"), "*"))


def without_kinds(edges: DataFrame, *kinds: str) -> DataFrame:
    """Edges without these kinds; an edge with none left goes (also one that had none)."""
    left = F.filter("kinds", lambda k: ~k["kind"].isin(*kinds))
    return edges.withColumn("kinds", left).filter(F.size("kinds") > 0)


def induced(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends among ``selected`` (label)."""
    return edges.join(selected.select(F.col("label").alias("source")), "source", "left_semi").join(selected.select(F.col("label").alias("target")), "target", "left_semi").select(edges.columns)
