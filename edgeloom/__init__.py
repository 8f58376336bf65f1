"""Architecture and dependency analytics as Spark DataFrame plans."""

from __future__ import annotations

_PUBLIC = {
    "api": ["DependencyRule", "FileRule", "Files", "GraphReport", "LayerRules", "MetricRule", "Metrics", "Rule", "SliceRule", "SliceScope", "assert_passes"],
    "errors": ["TechnicalError", "UserError"],
    "functions.patterns": ["Filter", "Pattern", "in_file", "in_folder", "in_path", "pattern", "types_matching", "with_name"],
    "operators.cycles": ["cycle_edges", "cycle_evidence", "elementary_cycles", "strong_components"],
    "operators.traversal": ["dependents_of", "focus", "reachable_from", "walk"],
    "results": ["Finding", "Result", "ResultOptions", "shaped", "shaped_error", "styled", "terminal_has_colors"],
    "sinks.render": ["render", "to_csv", "to_d2", "to_dot", "to_html", "to_json", "to_mermaid", "to_plantuml"],
    "sources.crates": ["extract_workspace"],
    "sources.plantuml": ["parse"],
    "sources.rust": ["extract_graph"],
}
__all__ = sorted(name for names in _PUBLIC.values() for name in names)


def __getattr__(name: str):
    """Public names, imported when asked for: tasks of one module need not load the others."""
    from importlib import import_module

    for module, names in _PUBLIC.items():
        if name in names:
            return getattr(import_module(f"edgeloom.{module}"), name)
    raise AttributeError(f"module 'edgeloom' has no attribute {name!r}")
