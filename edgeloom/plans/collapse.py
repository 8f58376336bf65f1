"""Folding nodes of a report into folders or into what a pattern captures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.errors import UserError
from edgeloom.functions.patterns import Pattern, PatternSpec

Collapse = Callable[[Column], Column]


def folder_depth(depth: int) -> Collapse:
    """The first ``depth`` folders; a file name is never part of the label."""
    if depth < 1:
        raise UserError("a folder depth must be at least 1")

    def label(node: Column) -> Column:
        parts = F.filter(F.split(node, "/"), lambda s: s != "")
        kept = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(depth), F.size(parts) - 1))), "/")
        return F.when(F.size(parts) <= 1, node).otherwise(kept)

    return label


def by_pattern(spec: str | PatternSpec, replacement: str = "${1}") -> Collapse:
    """The replacement of a match of the whole node; other nodes stay. An empty replacement or result is an error."""
    if not replacement:
        raise UserError("a replacement must not be empty")
    compiled = spec.compile() if isinstance(spec, PatternSpec) else Pattern.regex(spec)

    def label(node: Column) -> Column:
        made = compiled.replaced(node, replacement)
        empty = F.raise_error(F.concat(F.lit("collapsing gave an empty label for "), node)).cast("string")
        return F.when(~compiled.matches(node), node).when(made == "", empty).otherwise(made)

    return label
