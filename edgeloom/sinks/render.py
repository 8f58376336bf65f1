"""Reports as text: one row per line where lines follow from edges, documents at the edge."""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.errors import TechnicalError, UserError
from edgeloom.functions.identifiers import utc_stamp
from edgeloom.operators.report import Snapshot
from edgeloom.plans.lineage import cut
from edgeloom.plans.edges import kind_names



def _q() -> Column:
    return F.lit('"')


def _r(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def quoted(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = _r(c, old, new)
    return F.concat(_q(), c, _q())


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(_q(), _r(c, '"', '""'), _q())).otherwise(c)


def mermaid_label(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = _r(c, old, new)
    return F.regexp_replace(c, r"\r\n|\r|\n", "<br/>")


def single_line(c: Column) -> Column:
    return F.translate(c, "\r\n", "  ")


def csv_lines(edges: DataFrame) -> DataFrame:
    kinds = F.array_join(kind_names("kinds"), "|")
    line = F.concat_ws(",", csv_field(F.col("source")), csv_field(F.col("target")), F.col("count").cast("string"), F.col("external").cast("string"), csv_field(kinds))
    return edges.select("source", "target", line.alias("line"))


def dot_lines(edges: DataFrame) -> DataFrame:
    label = F.when(F.col("count") > 1, F.concat(F.lit('label="'), F.col("count").cast("string"), _q()))
    style = F.when(F.col("external"), F.lit("style=dashed"))
    tooltip = F.when(F.size("kinds") > 0, F.concat(F.lit("tooltip="), quoted(F.array_join(kind_names("kinds"), ", "))))
    attributes = F.concat_ws(", ", label, style, tooltip)
    line = F.concat(quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.when(attributes != "", F.concat(F.lit(" ["), attributes, F.lit("]"))).otherwise(F.lit("")))
    return edges.select("source", "target", line.alias("line"))


def mermaid_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between numbered nodes; an edge with an unknown end is not drawn."""
    a = nodes.select(F.col("label").alias("source"), F.col("id").alias("a"))
    b = nodes.select(F.col("label").alias("target"), F.col("id").alias("b"))
    arrow = F.when(F.col("external"), F.lit("-.->")).otherwise(F.lit("-->"))
    count = F.when(F.col("count") > 1, F.concat(F.lit("|"), F.col("count").cast("string"), F.lit("| "))).otherwise(F.lit(""))
    return edges.join(a, "source").join(b, "target").select("source", "target", F.concat("a", F.lit(" "), arrow, F.when(F.col("count") > 1, count).otherwise(F.lit(" ")), "b").alias("line"))


def d2_lines(edges: DataFrame) -> DataFrame:
    count = F.when(F.col("count") > 1, F.concat(F.lit(': "'), F.col("count").cast("string"), _q())).otherwise(F.lit(""))
    dash = F.when(F.col("external"), F.lit(" { style.stroke-dash: 4 }")).otherwise(F.lit(""))
    return edges.select("source", "target", F.concat(quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), count, dash).alias("line"))


def plantuml_lines(slices: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, line): declared components, then arrows; both sorted and unique."""
    ends = slices.select(F.col("source_label").alias("c")).union(slices.select("target_label"))
    ends = ends if labels is None else ends.union(labels.select("label"))
    arrows = slices.select(F.concat(F.lit("["), "source_label", F.lit("] --> ["), "target_label", F.lit("]")).alias("line")).distinct()
    return ends.distinct().select(F.lit(0).alias("part"), F.concat(F.lit("component ["), "c", F.lit("]")).alias("line")).unionByName(arrows.select(F.lit(1).alias("part"), "line"))


# ---- documents (collected: a rendered report is one string) --------------------------


def _sorted(df: DataFrame) -> list[str]:
    return [r["line"] for r in df.orderBy("source", "target").collect()]


def to_csv(s: Snapshot) -> str:
    return "\n".join(["source,target,count,external,import_kinds", *_sorted(csv_lines(s.edges))])


def _data(s: Snapshot) -> dict:
    nodes = [{"id": r["id"], "label": r["label"]} for r in s.nodes.orderBy(F.length("id"), "id").collect()]
    rows = s.edges.withColumn("kinds", kind_names("kinds")).orderBy("source", "target").collect()
    edges = [{"source": r["source"], "target": r["target"], "count": r["count"], "external": r["external"], "import_kinds": r["kinds"]} for r in rows]
    return {"title": s.title, "nodes": nodes, "edges": edges, "summary": s.summary.first().asDict()}


def to_json(s: Snapshot) -> str:
    return json.dumps(_data(s), indent=2, sort_keys=True, ensure_ascii=False)


def to_dot(s: Snapshot) -> str:
    nodes = [r["line"] for r in s.nodes.orderBy("label").select(quoted(F.col("label")).alias("line")).collect()]
    body = "\n".join(f"  {line};" for line in [*nodes, *_sorted(dot_lines(s.edges))])
    return "digraph dependencies {\n  rankdir=LR;\n" + body + "\n}\n"


def to_mermaid(s: Snapshot) -> str:
    text = F.concat("id", F.lit('["'), mermaid_label(F.col("label")), F.lit('"]'))
    nodes = [r["line"] for r in s.nodes.orderBy(F.length("id"), "id").select(text.alias("line")).collect()]
    return "flowchart LR\n" + "\n".join(f"  {line}" for line in [*nodes, *_sorted(mermaid_lines(s.edges, s.nodes))]) + "\n"


def to_d2(s: Snapshot) -> str:
    nodes = [r["line"] for r in s.nodes.orderBy("label").select(quoted(F.col("label")).alias("line")).collect()]
    return "\n".join([*nodes, *_sorted(d2_lines(s.edges))]) + "\n"


def to_plantuml(slices: DataFrame, labels: DataFrame | None = None) -> str:
    body = [r["line"] for r in plantuml_lines(slices, labels).orderBy("part", "line").collect()]
    return "\n".join(["@startuml", *body, "@enduml"]) + "\n"


def to_html(s: Snapshot) -> str:
    data, esc = _data(s), html.escape
    summary = "".join(f"<li>{esc(k)}: {v}</li>" for k, v in data["summary"].items())
    nodes = "".join(f"<li><code>{n['id']}</code> {esc(n['label'])}</li>" for n in data["nodes"])
    rows = "".join(f"<tr><td>{esc(e['source'])}</td><td>{esc(e['target'])}</td><td>{e['count']}</td><td>{'yes' if e['external'] else 'no'}</td><td>{esc(', '.join(e['import_kinds']))}</td></tr>" for e in data["edges"])
    sources = "".join(f"<h2>{name}</h2><pre>{esc(make(s))}</pre>" for name, make in (("Mermaid", to_mermaid), ("DOT", to_dot), ("D2", to_d2), ("JSON", to_json)))
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{esc(s.title)}</title></head><body><h1>{esc(s.title)}</h1><ul>{summary}</ul><ul>{nodes}</ul><table><tr><th>source</th><th>target</th><th>count</th><th>external</th><th>kinds</th></tr>{rows}</table>{sources}</body></html>"


def metrics_html(measured: DataFrame, title: str = "Metrics", css: str = "", stamp: int | None = None) -> str:
    """(name, value) rows in the order of their names; ``stamp``, in seconds since 1970, is shown as UTC."""
    styles = re.sub("(?i)</(?=style)", r"<\\/", css)
    at = "" if stamp is None else f"<p>{measured.sparkSession.range(1).select(utc_stamp(F.lit(stamp))).first()[0]}</p>"
    rows = "".join(f"<tr><td>{html.escape(r['name'])}</td><td>{html.escape(str(r['value']))}</td></tr>" for r in measured.orderBy("name").collect())
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title><style>{styles}</style></head><body><h1>{html.escape(title)}</h1>{at}<table>{rows}</table></body></html>"


RENDERERS = {"csv": to_csv, "json": to_json, "dot": to_dot, "mermaid": to_mermaid, "d2": to_d2, "html": to_html}


#: Nodes and edges of a drawn report, at most: it is one string on the driver.
MAX_DRAWN = 200_000


def settled(s: Snapshot) -> Snapshot:
    """The snapshot computed once, however often a format reads it; one too large to draw is refused."""
    out = Snapshot(cut(s.nodes), cut(s.edges), cut(s.summary), s.title)
    n = out.nodes.count() + out.edges.count()
    if n > MAX_DRAWN:
        raise UserError(f"{n} nodes and edges are too many for one document: collapse or select, or write the lines of csv_lines and its kin as a table")
    return out


def render(s: Snapshot, kind: str) -> str:
    if kind not in RENDERERS:
        raise UserError(f"unknown report format {kind!r}")
    return RENDERERS[kind](settled(s))


def export(text: str, path: str, suffix: str = "") -> None:
    """Writes a document; ``suffix`` is appended to a path that does not end in it."""
    if not path.strip():
        raise UserError("an export needs a path")
    path += "" if path.lower().endswith(suffix) else suffix
    try:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    except OSError as e:
        raise TechnicalError(str(e)) from e
