"""Slice labels of files, and edges between slices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import UserError
from edgeloom.functions import identifiers as ids
from edgeloom.functions.patterns import Filter, PatternSpec, checked_regex, glob_to_regex, group_names
from edgeloom.plans.edges import labelled, project_edges


@dataclass(frozen=True)
class Slices:
    """``label`` maps an identifier to its slice, or to null."""

    label_of: Callable[[Column], Column]
    exclusions: tuple[Filter, ...] = ()

    def label(self, identifier: Column) -> Column:
        out = F.nullif(self.label_of(identifier), F.lit(""))
        for exclusion in self.exclusions:
            out = F.when(~exclusion.column(identifier), out)
        return out

    def project(self, edges: DataFrame) -> DataFrame:
        """Edges between slices, as counts; an external target keeps its own name."""
        return project_edges(self.evidence(edges), F.col("source_label"), F.col("target_label")).filter("source_label <> target_label or any_external")

    def evidence(self, edges: DataFrame) -> DataFrame:
        """Every edge with the labels of its ends."""
        source = self.label(F.col("source"))
        target = F.when(F.col("external"), F.col("target")).otherwise(self.label(F.col("target")))
        return labelled(edges.filter("source <> target"), source, target)

    def labels(self, edges: DataFrame) -> DataFrame:
        """All slices, isolated ones too; external targets are none."""
        inner = edges.select(F.col("source").alias("f")).union(edges.filter("not external").select(F.col("target").alias("f")))
        return inner.select(self.label(F.col("f")).alias("label")).filter("label is not null").distinct()


def _spec(spec: str | PatternSpec, syntax: str) -> PatternSpec:
    return spec if isinstance(spec, PatternSpec) else PatternSpec(spec, syntax)


def by_pattern(spec: str | PatternSpec) -> Slices:
    """A glob in which ``(**)`` stands once for the segment that names the slice."""
    spec = _spec(spec, "glob")
    before, capture, after = spec.text.replace("\\", "/").partition("(**)")
    if not capture or "(**)" in after or "(" in before + after:
        raise UserError(f"slice pattern {spec.text!r} needs exactly one (**)")
    prefix = glob_to_regex(before) if before.strip("/") else before
    if before.endswith("/") and not prefix.endswith(("/", "/)?")):
        prefix += "/"
    regex = rf"\A{prefix}([^/]+){_rest(after)}.*\z"
    return Slices(lambda c: F.regexp_extract(ids.normalize_candidate(c), regex, 1), spec.filter("path").exclusions if spec.exceptions else ())


def _rest(after: str) -> str:
    if not after.strip("/"):
        return after
    return glob_to_regex(after) + ("/" if after.endswith("/") else "")


def by_regex(spec: str | PatternSpec) -> Slices:
    """The first capture of a regular expression that is not anchored."""
    spec = _spec(spec, "regex")
    regex = checked_regex(spec.text)
    if not group_names(spec.text):
        raise UserError(f"slice pattern {spec.text!r} needs a capture group")
    exclusions = tuple(Filter(spec.compile(t), kind or "path") for kind, t in spec.exceptions)
    return Slices(lambda c: F.regexp_extract(ids.normalize_candidate(c), regex, 1), exclusions)


def by_file_suffix(suffixes: dict[str, str]) -> Slices:
    """The label of the longest suffix of the file's stem."""
    if not suffixes or not all(k and v for k, v in suffixes.items()):
        raise UserError("suffixes and labels must not be empty")

    def label(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for suffix, name in sorted(suffixes.items(), key=lambda kv: (len(kv[0]), kv[0]), reverse=False):
            out = F.when(ids.stem(c).endswith(suffix), F.lit(name)).otherwise(out)
        return out

    return Slices(label)


def identity() -> Slices:
    return Slices(lambda c: c)
