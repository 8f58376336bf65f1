"""Fluent rules over an edge relation.

    Files(edges).in_path("src/api/**").should_not().depend_on_files().in_path("src/db/**").check()

Builders are immutable.  Patterns compile at once, so a bad one fails before anything
is read.  ``violations()`` is a DataFrame; ``check()`` gives a :class:`Result`.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import results
from edgeloom.errors import TechnicalError, UserError
from edgeloom.functions.identifiers import edge_text
from edgeloom.functions.patterns import Filter, PatternSpec, all_of, in_file, in_folder, in_path, types_matching, with_name
from edgeloom.operators import metrics, report, rules
from edgeloom.plans.collapse import by_pattern, folder_depth
from edgeloom.plans.edges import kind_names
from edgeloom.plans.slices import Slices, identity
from edgeloom.plans.slices import by_pattern as by_slice_pattern
from edgeloom.plans.slices import by_regex as by_slice_regex
from edgeloom.results import Finding, Result, ResultOptions
from edgeloom.sinks import render
from edgeloom.sources import plantuml

Spec = str | PatternSpec


class Rule:
    """What has ``violations()`` and perhaps a guard can be checked. Subclass it for rules of your own."""

    allow_empty = False

    def title(self) -> str:
        """The kind of violation, as a heading."""
        return "Architecture violation"

    def violations(self) -> DataFrame:
        raise NotImplementedError

    def text(self, violations: DataFrame) -> DataFrame:
        """One column ``text`` that tells of each violation."""
        return violations.select(F.to_json(F.struct("*")).alias("text"))

    def guard(self) -> DataFrame | None:
        """Rows if no subject was selected."""
        return None

    def allow_empty_tests(self):
        return replace(self, allow_empty=True)

    def findings(self, limit: int = 1000) -> list[Finding]:
        """Single violations for people, one more than ``limit`` at most; ``violations()`` has them all as rows."""
        guard = None if self.allow_empty else self.guard()
        empty = [] if guard is None else [Finding("Empty test violation", f"no subject was selected: {r['subject']}") for r in guard.collect()]
        if empty and not isinstance(self, LayerRules):
            return empty
        return [*empty, *(Finding(self.title(), r["text"]) for r in self.text(self.violations()).orderBy("text").limit(limit + 1).collect())]

    def result(self, options: ResultOptions | None = None) -> Result:
        """The check with headings, colours and the expectation of ``options``; a rule that is wrong or can't run is a result too."""
        options = options or ResultOptions()
        try:
            return results.shaped(self.findings(options.limit), options)
        except (UserError, TechnicalError) as e:
            return results.shaped_error(e, options)

    def check(self, expect_violations: bool = False, limit: int = 1000) -> Result:
        found = self.findings(limit)
        empty = sum(f.message == "Empty test violation" for f in found)
        lines = [f.details for f in found[: empty + limit]]
        if len(found) > empty + limit:
            lines.append(f"there are more than {limit} violations; violations() has them all")
        message = "\n".join(f"{i}. {line}" for i, line in enumerate(lines, 1))
        passed = bool(lines) == expect_violations
        return Result(passed, message or ("no violations, though some were expected" if not passed else "no violations"))


def assert_passes(rule: Rule) -> None:
    result = rule.check()
    if not result.passed:
        raise AssertionError(result.message)


def _edge_lines(df: DataFrame) -> DataFrame:
    return df.select(edge_text(F.col("source"), F.col("target"), F.col("external"), kind_names("kinds")).alias("text"))


# ---- files ---------------------------------------------------------------------


@dataclass(frozen=True)
class Files:
    edges: DataFrame
    facts: DataFrame | None = None
    subjects: tuple[Filter, ...] = ()

    def _and(self, f: Filter) -> Files:
        return replace(self, subjects=(*self.subjects, f))

    def with_name(self, spec: Spec) -> Files:
        return self._and(with_name(spec))

    def in_folder(self, spec: Spec) -> Files:
        return self._and(in_folder(spec))

    def in_path(self, spec: Spec) -> Files:
        return self._and(in_path(spec))

    def in_file(self, path: str) -> Files:
        return self._and(in_file(path))

    def should(self) -> FileMood:
        return FileMood(self, False)

    def should_not(self) -> FileMood:
        return FileMood(self, True)


@dataclass(frozen=True)
class FileMood:
    files: Files
    negated: bool

    def _pattern(self, f: Filter) -> FileRule:
        return FileRule(self.files, lambda e, s: rules.file_pattern(e, s, f, self.negated), lambda v: v.select(F.col("label").alias("text")))

    def have_name(self, spec: Spec) -> FileRule:
        return self._pattern(with_name(spec))

    def be_in_folder(self, spec: Spec) -> FileRule:
        return self._pattern(in_folder(spec))

    def be_in_path(self, spec: Spec) -> FileRule:
        return self._pattern(in_path(spec))

    def depend_on_files(self) -> DependencyRule:
        return DependencyRule(self.files, self.negated, False)

    def depend_on_external_modules(self) -> DependencyRule:
        return DependencyRule(self.files, self.negated, True)

    def have_no_cycles(self, *excluded_kinds: str) -> FileRule:
        if self.negated:
            raise UserError("have_no_cycles follows should()")
        return FileRule(self.files, lambda e, s: rules.no_cycles(e, s, excluded_kinds), lambda v: v.select(F.array_join("path", " -> ").alias("text")), heading="Circular dependency detected")

    def adhere_to(self, predicate: Column, message: str) -> FileRule:
        facts = self.files.facts
        if facts is None:
            raise UserError("a custom rule needs file facts")
        if not message.strip():
            raise UserError("a custom rule needs a message")
        return FileRule(self.files, lambda _, s: rules.custom_files(facts, s, predicate, message, self.negated), lambda v: v.select(F.concat_ws(": ", "path", "message").alias("text")), heading="Custom file violation")


@dataclass(frozen=True)
class FileRule(Rule):
    files: Files
    find: Callable[[DataFrame, list[Filter]], DataFrame]
    show: Callable[[DataFrame], DataFrame]
    allow_empty: bool = False
    heading: str = "File pattern violation"

    def title(self) -> str:
        return self.heading

    def violations(self) -> DataFrame:
        return self.find(self.files.edges, [*self.files.subjects])

    def text(self, violations: DataFrame) -> DataFrame:
        return self.show(violations)

    def guard(self) -> DataFrame:
        return rules.empty_guard(rules.select_files(self.files.edges, [*self.files.subjects]), "file")


@dataclass(frozen=True)
class DependencyRule(Rule):
    files: Files
    negated: bool
    external: bool
    objects: tuple[Filter, ...] = ()
    allow_empty: bool = False

    def _and(self, f: Filter) -> DependencyRule:
        return replace(self, objects=(*self.objects, f))

    def with_name(self, spec: Spec) -> DependencyRule:
        return self._and(with_name(spec))

    def in_folder(self, spec: Spec) -> DependencyRule:
        return self._and(in_folder(spec))

    def in_path(self, spec: Spec) -> DependencyRule:
        return self._and(in_path(spec))

    matching = in_path

    def title(self) -> str:
        return "External module dependency violation" if self.external else "File dependency violation"

    def violations(self) -> DataFrame:
        find = rules.external_dependencies if self.external else rules.file_dependencies
        return find(self.files.edges, [*self.files.subjects], [*self.objects], self.negated)

    def text(self, violations: DataFrame) -> DataFrame:
        return _edge_lines(violations)

    def guard(self) -> DataFrame:
        return rules.empty_guard(rules.select_files(self.files.edges, [*self.files.subjects]), "file", self.negated)


# ---- layers and slices ------------------------------------------------------------


@dataclass(frozen=True)
class LayerRules(Rule):
    edges: DataFrame
    layers: rules.Layers = field(default_factory=rules.Layers)
    allow_empty: bool = False

    def _with(self, change: Callable[[rules.Layers], rules.Layers]) -> LayerRules:
        return replace(self, layers=change(deepcopy(self.layers)))

    def layer(self, name: str, spec: Spec, folder: bool = False) -> LayerRules:
        return self._with(lambda layers: layers.layer(name, (in_folder if folder else in_path)(spec)))

    def may_only_depend_on_layers(self, name: str, *targets: str) -> LayerRules:
        return self._with(lambda layers: layers.may_only_depend_on(name, *targets))

    def may_not_depend_on_layers(self, name: str, *targets: str) -> LayerRules:
        return self._with(lambda layers: layers.may_not_depend_on(name, *targets))

    def title(self) -> str:
        return "Layer dependency violation"

    def violations(self) -> DataFrame:
        return self.layers.violations(self.edges)

    def text(self, violations: DataFrame) -> DataFrame:
        return violations.select(F.format_string("layer '%s' %s: '%s' (%s -> %s)", "source_layer", "rule", "target_layer", "source", "target").alias("text"))

    def guard(self) -> DataFrame:
        return self.layers.checked().empty_layers(self.edges)


@dataclass(frozen=True)
class SliceScope:
    """How files fall into slices, before a mood is chosen; each file is its own slice at first."""

    edges: DataFrame
    slices: Slices = field(default_factory=identity)

    def defined_by(self, spec: Spec) -> SliceScope:
        return replace(self, slices=by_slice_pattern(spec))

    def defined_by_regex(self, spec: Spec) -> SliceScope:
        return replace(self, slices=by_slice_regex(spec))

    def with_projection(self, slices: Slices) -> SliceScope:
        return replace(self, slices=slices)

    def should(self) -> SliceMood:
        return SliceMood(SliceRule(self.edges, self.slices), False)

    def should_not(self) -> SliceMood:
        return SliceMood(SliceRule(self.edges, self.slices), True)

    def to_plantuml(self) -> str:
        return SliceRule(self.edges, self.slices).to_plantuml()

    def export_as_plantuml(self, path: str) -> None:
        render.export(self.to_plantuml(), path)


@dataclass(frozen=True)
class SliceMood:
    rule: SliceRule
    negated: bool

    def contain_dependency(self, source: str, target: str) -> SliceRule:
        if not self.negated:
            raise UserError("contain_dependency follows should_not()")
        return self.rule.should_not_contain_dependency(source, target)

    def adhere_to_diagram(self, text: str, ignoring_orphans: bool = False, ignoring_external: bool = False) -> SliceRule:
        if self.negated:
            raise UserError("adhere_to_diagram follows should()")
        return self.rule.should_adhere_to_diagram(text, ignoring_orphans, ignoring_external)

    def adhere_to_diagram_in_file(self, path: str, ignoring_orphans: bool = False, ignoring_external: bool = False) -> SliceRule:
        try:
            text = Path(path).read_text(encoding="utf-8")
        except OSError as e:
            raise TechnicalError(str(e)) from e
        return self.adhere_to_diagram(text, ignoring_orphans, ignoring_external)


@dataclass(frozen=True)
class SliceRule(Rule):
    edges: DataFrame
    slices: Slices
    find: Callable[[DataFrame, Slices], DataFrame] | None = None
    allow_empty: bool = False

    def should_not_contain_dependency(self, source: str, target: str) -> SliceRule:
        return replace(self, find=lambda e, s: rules.forbidden_slice(e, s, source, target))

    def should_adhere_to_diagram(self, text: str, ignoring_orphans: bool = False, ignoring_external: bool = False) -> SliceRule:
        names, arrows = plantuml.parse(text)
        return replace(self, find=lambda e, s: rules.diagram_adherence(e, s, names, arrows, ignoring_orphans, ignoring_external))

    def title(self) -> str:
        return "Slice dependency violation"

    def violations(self) -> DataFrame:
        if self.find is None:
            raise UserError("the rule has no condition")
        return self.find(self.edges, self.slices)

    def text(self, violations: DataFrame) -> DataFrame:
        return violations.select(F.format_string("slice '%s' uses '%s' (%d edges)", "source_label", "target_label", "n_edges").alias("text"))

    def guard(self) -> DataFrame:
        return rules.empty_guard(self.slices.labels(self.edges), "slice")

    def to_plantuml(self) -> str:
        return render.to_plantuml(self.slices.project(self.edges), self.slices.labels(self.edges))

    def export_as_plantuml(self, path: str) -> None:
        render.export(self.to_plantuml(), path)


# ---- graph reports and metrics ------------------------------------------------------


@dataclass(frozen=True)
class GraphReport:
    edges: DataFrame
    query: report.Query = field(default_factory=report.Query)

    def _set(self, **change) -> GraphReport:
        return replace(self, query=replace(self.query, **change))

    def include_external_dependencies(self) -> GraphReport:
        return self._set(include_external=True)

    def include_self_dependencies(self) -> GraphReport:
        return self._set(include_self=True)

    def focus_on(self, spec: Spec, depth: int = 1) -> GraphReport:
        return self._set(focus=[*self.query.focus, (in_path(spec), depth)])

    def reachable_from(self, spec: Spec) -> GraphReport:
        return self._set(reachable_from=[*self.query.reachable_from, in_path(spec)])

    def dependents_of(self, spec: Spec) -> GraphReport:
        return self._set(dependents_of=[*self.query.dependents_of, in_path(spec)])

    def collapse_to_folder_depth(self, depth: int) -> GraphReport:
        return self._set(collapse=folder_depth(depth))

    def collapse_by_pattern(self, spec: Spec, replacement: str = "${1}") -> GraphReport:
        return self._set(collapse=by_pattern(spec, replacement))

    def titled(self, title: str) -> GraphReport:
        return self._set(title=title)

    def snapshot(self) -> report.Snapshot:
        return report.snapshot(self.edges, self.query)

    def summary(self) -> DataFrame:
        return self.snapshot().summary

    def render(self, kind: str) -> str:
        return render.render(self.snapshot(), kind)

    def export(self, kind: str, path: str) -> None:
        render.export(self.render(kind), path)


@dataclass(frozen=True)
class MetricRule(Rule):
    """A threshold, a predicate or a zone over measured rows (type or file, and value)."""

    measured: DataFrame
    find: Callable[[DataFrame], DataFrame] | None = None
    allow_empty: bool = False
    zone: str = ""

    def for_types_matching(self, spec: Spec, column: str = "type") -> MetricRule:
        """Selects after measuring, as counts over the project must not change."""
        return replace(self, measured=self.measured.filter(types_matching(spec).column(column)))

    def should_be(self, verb: str, threshold: float) -> MetricRule:
        metrics.threshold_violations(self.measured.limit(0), verb, threshold)
        return replace(self, find=lambda m: metrics.threshold_violations(m, verb, threshold))

    def should_satisfy(self, predicate: Column) -> MetricRule:
        return replace(self, find=lambda m: metrics.predicate_violations(m, predicate))

    def not_in_zone_of_pain(self) -> MetricRule:
        return replace(self, find=metrics.in_zone_of_pain, zone="pain")

    def not_in_zone_of_uselessness(self) -> MetricRule:
        return replace(self, find=metrics.in_zone_of_uselessness, zone="uselessness")

    def title(self) -> str:
        return "Metric zone violation" if self.zone else "Metric violation"

    def violations(self) -> DataFrame:
        if self.find is None:
            raise UserError("the rule has no condition")
        return self.find(self.measured)

    def text(self, violations: DataFrame) -> DataFrame:
        return metrics.zone_text(violations, self.zone) if self.zone else super().text(violations)

    def guard(self) -> DataFrame:
        return rules.empty_guard(self.measured, "metric")


LCOM = {
    "lcom1": metrics.lcom1, "lcom4": metrics.lcom4,
    **dict.fromkeys(("lcom96a", "lcom3", "lcom5", "lcom_star"), lambda *r: metrics.lcom96a(metrics.lcom_inputs(*r))),
    **dict.fromkeys(("lcom96b", "lcom2"), lambda *r: metrics.lcom96b(metrics.lcom_inputs(*r))),
}
DISTANCE = ("abstractness", "instability", "distance", "coupling_factor", "normalized_distance")


@dataclass(frozen=True)
class Metrics:
    """What a project's types hold, and selectors over them.

    ``types`` (type, kind, file), ``methods`` (type, method), ``fields`` (type, field),
    ``accesses`` (type, method, field); ``files`` (file and its counts; traits, concrete and
    loc for distances) and ``edges`` where counts of files or distances are asked for.
    Coupling is always measured over the whole project; selectors take rows afterwards.
    """

    types: DataFrame
    methods: DataFrame
    fields: DataFrame
    accesses: DataFrame
    files: DataFrame | None = None
    edges: DataFrame | None = None
    filters: tuple[Filter, ...] = ()

    def _and(self, f: Filter) -> Metrics:
        return replace(self, filters=(*self.filters, f))

    def with_name(self, spec: Spec) -> Metrics:
        return self._and(with_name(spec))

    def in_folder(self, spec: Spec) -> Metrics:
        return self._and(in_folder(spec))

    def in_path(self, spec: Spec) -> Metrics:
        return self._and(in_path(spec))

    def for_types_matching(self, spec: Spec) -> Metrics:
        return self._and(types_matching(spec))

    def _on(self, of_types: bool) -> list[Filter]:
        return [f for f in self.filters if (f.target == "type") == of_types]

    def _files(self) -> DataFrame:
        if self.files is None:
            raise UserError("counts of files and distances need files")
        return self.files

    def selected_types(self) -> DataFrame:
        return self.types.filter(all_of(self._on(False), "file") & all_of(self._on(True), "type"))

    def selected_files(self) -> DataFrame:
        """Files that the file selectors leave; with a type selector types are counted anew and files without any go."""
        files = self._files().filter(all_of(self._on(False), "file"))
        return metrics.retain_types(self.types, all_of(self._on(True), "type"), files) if self._on(True) else files

    def count(self, what: str) -> MetricRule:
        """``methods`` or ``fields`` of each type, or a count of each file by its column's name."""
        if what in ("methods", "fields"):
            types = self.selected_types()
            return MetricRule(metrics.method_count(types, self.methods) if what == "methods" else metrics.field_count(types, self.fields))
        if what == "file" or what not in {*self._files().columns, *(("concrete_types", "traits") if self._on(True) else ())}:
            raise UserError(f"unknown count {what!r}")
        return MetricRule(self.selected_files().select("file", F.col(what).alias("value")))

    def lcom(self, name: str) -> MetricRule:
        if name not in LCOM:
            raise UserError(f"unknown cohesion metric {name!r}")
        return MetricRule(LCOM[name](self.selected_types(), self.methods, self.fields, self.accesses))

    def distances(self) -> DataFrame:
        """The selected components with all five values; a type selector keeps those that hold a matching type."""
        files = self._files()
        if self.edges is None:
            raise UserError("distances need edges")
        infos = metrics.distance_metrics(files.join(metrics.coupling(files.select("file"), self.edges), "file")).filter(all_of(self._on(False), "file"))
        return metrics.components_with_type(infos, self.types, all_of(self._on(True), "type")) if self._on(True) else infos

    def distance(self, name: str = "distance") -> MetricRule:
        if name not in DISTANCE:
            raise UserError(f"unknown distance metric {name!r}")
        return MetricRule(self.distances().withColumn("value", F.col(name)))

    def custom_metric(self, name: str, description: str, value: Column) -> MetricRule:
        """``value`` over (type, m, a, s): methods, fields and distinct accesses of structs that have a method."""
        inputs = metrics.lcom_inputs(self.selected_types(), self.methods, self.fields, self.accesses)
        return MetricRule(metrics.custom_metric(inputs, name, description, value))

    def measure(self, names: tuple[str, ...] = ("methods", "fields", "lcom96a", "lcom96b")) -> DataFrame:
        """(name, value) of all selected types: ``type.metric`` and its value."""
        out = None
        for name in names:
            rows = (self.count(name) if name in ("methods", "fields") else self.lcom(name)).measured
            rows = rows.select(F.concat_ws(".", "type", F.lit(name)).alias("name"), F.col("value").cast("double").alias("value"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise UserError("measure() needs a metric")
        return out

    def export_as_html(self, path: str, title: str = "Metrics", css: str = "", stamp: int | None = None) -> None:
        render.export(render.metrics_html(self.measure(), title, css, stamp), path, ".html")
