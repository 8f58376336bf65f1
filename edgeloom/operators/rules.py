"""Architecture rules: each gives a DataFrame of violations.

``negated`` is the mood: an allowlist (should) reports what does not match, a
denylist (should not) what does.  Configuration is checked when a rule is built,
before anything is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import UserError
from edgeloom.functions.patterns import Filter, all_of, any_of
from edgeloom.operators.cycles import elementary_cycles
from edgeloom.plans import edges as E
from edgeloom.plans.lineage import cut
from edgeloom.plans.slices import Slices


def empty_guard(subjects: DataFrame, subject: str, negated: bool = False, allow_empty: bool = False) -> DataFrame:
    """One row (subject, is_negated) if no subject was selected, else none."""
    counted = subjects.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") == 0) & F.lit(not allow_empty)).select(F.lit(subject).alias("subject"), F.lit(negated).alias("is_negated"))


def select_files(edges: DataFrame, filters: list[Filter]) -> DataFrame:
    return E.nodes(edges).filter(all_of(filters, "label"))


def file_pattern(edges: DataFrame, subjects: list[Filter], check: Filter, negated: bool) -> DataFrame:
    """(label): selected files whose match equals the mood."""
    return select_files(edges, subjects).filter(check.column("label") == F.lit(negated))


def _dependency(edges: DataFrame, subjects: list[Filter], hit: Column, negated: bool) -> DataFrame:
    return edges.filter(all_of(subjects, "source") & (hit == F.lit(negated))).select("source", "target", "external", "kinds")


def file_dependencies(edges: DataFrame, subjects: list[Filter], objects: list[Filter], negated: bool) -> DataFrame:
    """Internal dependencies of the subjects; objects are combined by AND."""
    hit = all_of(objects, "target") if objects else F.lit(False)
    return _dependency(E.per_internal_edge(edges), subjects, hit, negated)


def external_dependencies(edges: DataFrame, subjects: list[Filter], objects: list[Filter], negated: bool) -> DataFrame:
    """Dependencies on external modules; objects are combined by OR."""
    hit = any_of(objects, "target") if objects else F.lit(False)
    return _dependency(E.per_external_edge(edges), subjects, hit, negated)


def no_cycles(edges: DataFrame, subjects: list[Filter], excluded_kinds: tuple[str, ...] = ()) -> DataFrame:
    """(path): the cycles among the selected files, closed by their first file."""
    inner = E.induced(E.per_internal_edge(edges), select_files(edges, subjects))
    inner = E.without_kinds(inner, *excluded_kinds) if excluded_kinds else inner
    return elementary_cycles(inner).select(F.concat("cycle", F.slice("cycle", 1, 1)).alias("path"))


def custom_files(files: DataFrame, subjects: list[Filter], predicate: Column, message: str, negated: bool) -> DataFrame:
    """(path, message): files (path, name, extension, directory, content, ..) whose predicate equals the mood."""
    if not message.strip():
        raise UserError("a custom rule needs a message")
    hit = F.coalesce(predicate, F.lit(False))
    return files.filter(all_of(subjects, "path") & (hit == F.lit(negated))).select("path", F.lit(message).alias("message"))


# ---- layers -----------------------------------------------------------------------


@dataclass
class Layers:
    """Layers in order of declaration (the first that matches a file wins) and what they may use."""

    definitions: list[tuple[str, list[Filter]]] = field(default_factory=list)
    allowed: dict[str, set[str]] = field(default_factory=dict)
    blocked: dict[str, set[str]] = field(default_factory=dict)

    def layer(self, name: str, *filters: Filter) -> Layers:
        if not name.strip() or not filters:
            raise UserError("a layer needs a name and a definition")
        for i, (known, old) in enumerate(self.definitions):
            if known == name:
                self.definitions[i] = (name, [*old, *filters])
                return self
        self.definitions.append((name, [*filters]))
        return self

    def may_only_depend_on(self, name: str, *targets: str) -> Layers:
        """Replaces an earlier allowlist; without targets the layer is sealed."""
        self.allowed[name] = set(targets)
        return self

    def may_not_depend_on(self, name: str, *targets: str) -> Layers:
        """Adds to an earlier blocklist."""
        if not targets:
            raise UserError("a blocklist needs at least one layer")
        self.blocked.setdefault(name, set()).update(targets)
        return self

    def checked(self) -> Layers:
        known = {n for n, _ in self.definitions}
        used = {*self.allowed, *self.blocked}.union(*self.allowed.values(), *self.blocked.values())
        if used - known:
            raise UserError(f"undefined layers: {', '.join(sorted(used - known))}")
        return self

    def label(self, identifier: Column | str) -> Column:
        return F.coalesce(*(F.when(any_of(filters, identifier), F.lit(name)) for name, filters in self.definitions), F.lit(None))

    def violations(self, edges: DataFrame) -> DataFrame:
        """(source_layer, target_layer, source, target, rule); a block wins over an allowlist.

        The policy is as small as the rule's text, so it becomes part of the plan.  The
        merged edges are cut first and labelled in a generator: else the filters on labels
        would move below the merge, and every pattern would run on every raw reference.
        """
        self.checked()
        merged = cut(E.per_internal_edge(edges).select("source", "target"))
        labels = F.struct(self.label("source").alias("source_layer"), self.label("target").alias("target_layer"))
        out = merged.select("source", "target", F.inline(F.array(labels)))
        out = out.filter("source_layer is not null and target_layer is not null and source_layer <> target_layer")
        pair = lambda policy: [(a, b) for a, targets in policy.items() for b in targets]
        is_pair = lambda pairs: F.concat_ws("\u0001", "source_layer", "target_layer").isin(*(f"{a}\u0001{b}" for a, b in pairs)) if pairs else F.lit(False)
        restricted = F.col("source_layer").isin(*self.allowed) if self.allowed else F.lit(False)
        rule = F.when(is_pair(pair(self.blocked)), F.lit("may-not-depend-on-layers")).when(restricted & ~is_pair(pair(self.allowed)), F.lit("may-only-depend-on-layers"))
        return out.withColumn("rule", rule).filter("rule is not null").select("source_layer", "target_layer", "source", "target", "rule")

    def empty_layers(self, edges: DataFrame, allow_empty: bool = False) -> DataFrame:
        """One row for each layer with a policy that no file is in; the check goes on beside it."""
        guarded = [(n, f) for n, f in self.definitions if n in self.allowed or n in self.blocked]
        out = None
        for name, filters in guarded:
            row = empty_guard(E.nodes(edges).filter(any_of(filters, "label")), f"layer '{name}'", True, allow_empty)
            out = row if out is None else out.unionByName(row)
        return out if out is not None else empty_guard(edges.limit(0), "layers", allow_empty=True)


# ---- slices -----------------------------------------------------------------------


def forbidden_slice(edges: DataFrame, slices: Slices, source: str, target: str) -> DataFrame:
    return slices.project(edges).filter((F.col("source_label") == source) & (F.col("target_label") == target))


def diagram_adherence(edges: DataFrame, slices: Slices, components: list[str], allowed: list[tuple[str, str]], ignore_orphans: bool = False, ignore_external: bool = False) -> DataFrame:
    """Slice edges that a diagram does not draw."""
    out = slices.project(edges)
    if ignore_external:
        out = out.filter("not any_external")
    if ignore_orphans:
        out = out.filter(F.col("source_label").isin(*components) & F.col("target_label").isin(*components))
    drawn = F.concat_ws("\u0001", "source_label", "target_label").isin(*(f"{a}\u0001{b}" for a, b in allowed)) if allowed else F.lit(False)
    return out.filter(~drawn)
