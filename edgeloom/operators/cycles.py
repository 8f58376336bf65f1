"""Strongly connected components, elementary cycles and their evidence.

*Components.*  Links are trimmed a few rounds (a node without an inner predecessor or
successor is a component of its own) and cut into weakly connected parts.  Parts
of at most ``IN_ONE_TASK`` links are finished inside tasks, several parts to a task.  Of each
larger part one pivot, the best connected node, is searched forward and backward
at the same time as those of all other parts; what both searches reach is its component,
and the links left inside *reached forward only*, *backward only* and *not at all* go
on as new parts.  Only a part that is larger than a task and deep as well costs
a round for each step of its depth.

*Cycles.*  Paths grow by joins inside a component, over nodes larger than their start, so
every cycle is found once, from its smallest node, and only over nodes from which the start
is reached back through larger nodes: a part of the graph that leads nowhere adds no path.
The number of cycles can be exponential; all are found unless ``max_cycles`` is given,
which raises rather than drops.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.errors import TechnicalError
from edgeloom.operators.components import components
from edgeloom.operators.traversal import spread
from edgeloom.plans.lineage import cut

#: Links of a part, at most, that one task finishes: some 300 bytes each while it does.
IN_ONE_TASK = 100_000
TRIMS = 3


def _both_ends_in(links: DataFrame, labels: DataFrame) -> DataFrame:
    out = links.join(labels.withColumnRenamed("label", "source"), "source", "left_semi")
    return out.join(labels.withColumnRenamed("label", "target"), "target", "left_semi")


def _trimmed(links: DataFrame) -> DataFrame:
    """Links without those that touch a node that nothing enters or nothing leaves; a few rounds of that."""
    for _ in range(TRIMS):
        inner = links.select(F.col("source").alias("label")).intersect(links.select("target"))
        links = cut(_both_ends_in(links, inner))
    return links


def _finished(links: DataFrame) -> DataFrame:
    """(label, component) of the components of two nodes and more; each ``bucket`` holds whole parts and is one group."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        codes, labels = pd.factorize(pd.concat([rows["source"], rows["target"]]), sort=True)
        tails, heads = codes[: len(rows)], codes[len(rows) :]
        n = len(labels)

        def neighbours(of, to):
            order = of.argsort(kind="stable")
            return of[order].searchsorted(range(n + 1)).tolist(), to[order].tolist()

        def collect(starts, first, to, seen):
            """Nodes in the order in which a depth-first search leaves them, a list for each start that was still unseen."""
            place = first[:n]
            for start in starts:
                if seen[start]:
                    continue
                seen[start], stack, left = True, [start], []
                while stack:
                    node = stack[-1]
                    if place[node] == first[node + 1]:
                        left.append(stack.pop())
                        continue
                    after = to[place[node]]
                    place[node] += 1
                    if not seen[after]:
                        seen[after] = True
                        stack.append(after)
                yield left

        ordered = [node for part in collect(range(n), *neighbours(tails, heads), [False] * n) for node in part]
        found = [part for part in collect(reversed(ordered), *neighbours(heads, tails), [False] * n) if len(part) > 1]
        members = [node for part in found for node in part]
        least = [low for part in found for low in [min(part)] * len(part)]
        return pd.DataFrame({"label": labels.take(members), "component": labels.take(least)})

    kind = links.schema["source"].dataType.simpleString()
    return links.groupBy("bucket").applyInPandas(solve, f"label {kind}, component {kind}")


def _searched(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(label, ahead): labels that ``links`` reach from ``seeds``, and those that reach them, seeds included; one walk for both."""
    on = lambda ahead, name, to: F.struct(F.lit(ahead).alias("ahead"), F.col(name).alias("label")).alias(to)
    out, back = (links.select(on(ahead, a, "at"), on(ahead, b, "next")) for ahead, a, b in ((True, "source", "target"), (False, "target", "source")))
    starts = seeds.select(F.explode(F.array(on(True, "label", "s"), on(False, "label", "s"))).alias("label"))
    return spread(out.unionByName(back), starts).select("label.label", "label.ahead")


def _pivoted(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((label, component) of one component of each part, the links left)."""
    ends = links.select("part", F.col("source").alias("label"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(links.select("part", F.col("target").alias("label"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    degree = ends.groupBy("part", "label").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    pivots = degree.groupBy("part").agg(F.max_by("label", F.struct(F.col("out") * F.col("in"), "label")).alias("label")).select("label")
    found = _searched(links, pivots)
    sides = cut(found.groupBy("label").agg(F.sum(F.when(F.col("ahead"), 1).otherwise(2)).alias("side")))
    of_part = degree.select("part", "label").join(sides.filter("side = 3"), "label")
    named = of_part.select("label", F.min("label").over(Window.partitionBy("part")).alias("component"))
    end = lambda name: sides.withColumnsRenamed({"label": name, "side": f"{name}_side"})
    marked = links.join(end("source"), "source", "left").join(end("target"), "target", "left")
    same = F.coalesce("source_side", F.lit(0)) == F.coalesce("target_side", F.lit(0))
    return cut(named), cut(marked.filter(same & (F.coalesce("source_side", F.lit(0)) != 3)).select("source", "target"))


def strong_components(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(label, component) of all nodes; a component is named by its smallest label."""
    every = cut(edges.select("source", "target").distinct())
    links = every.filter("source <> target")
    found = []
    while size := links.count():
        if size <= in_one_task:
            found.append(cut(_finished(links.withColumn("bucket", F.lit(0)))))
            break
        links = _trimmed(links)
        parts = components(links.select(F.col("source").alias("a"), F.col("target").alias("b")))
        links = cut(links.join(parts.select(F.col("node").alias("source"), F.col("component").alias("part")), "source"))
        sizes = links.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        small = cut(links.join(sizes.filter(F.col("n") <= in_one_task).select("part"), "part"))
        if n := small.count():
            buckets = -(-n // max(in_one_task, 1))
            found.append(cut(_finished(small.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets))))))
        if n == links.count():
            break
        named, links = _pivoted(links.join(sizes.filter(F.col("n") > in_one_task).select("part"), "part"))
        found.append(named)
    nodes = every.select(F.col("source").alias("label")).union(every.select("target")).distinct()
    if not found:
        return nodes.withColumn("component", F.col("label"))
    known = reduce(DataFrame.unionByName, found)
    return nodes.join(known, "label", "left").select("label", F.coalesce("component", "label").alias("component"))


def _reaching_back(inner: DataFrame) -> DataFrame:
    """(start, at): nodes larger than ``start`` from which it is reached through larger nodes only."""
    step = inner.select(F.col("target").alias("at"), F.col("source").alias("before"))
    found = frontier = cut(inner.filter("source > target").select(F.col("target").alias("start"), F.col("source").alias("at")))
    while not frontier.isEmpty():
        back = frontier.join(step, "at").filter("before > start").select("start", F.col("before").alias("at")).distinct()
        frontier = cut(back.join(found, ["start", "at"], "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


def elementary_cycles(edges: DataFrame, max_cycles: int | None = None) -> DataFrame:
    """(cycle: array of labels, from the smallest on); self-edges are no cycles."""
    of = cut(strong_components(edges))
    links = edges.filter("source <> target").select("source", "target").distinct()
    source = of.withColumnsRenamed({"label": "source", "component": "cs"})
    target = of.withColumnsRenamed({"label": "target", "component": "ct"})
    inner = cut(links.join(source, "source").join(target, "target").filter("cs = ct").select("source", "target"))
    returns = _reaching_back(inner)
    step = inner.withColumnsRenamed({"source": "at", "target": "next"})
    paths = inner.filter("target > source").select(F.col("source").alias("start"), F.col("target").alias("at"), F.array("source", "target").alias("path"))
    found, n = [], 0
    while True:
        paths = cut(paths.join(returns, ["start", "at"], "left_semi"))
        if paths.isEmpty():
            break
        grown = paths.join(step, "at")
        closed = cut(grown.filter("next = start").select(F.col("path").alias("cycle")))
        n += closed.count() if max_cycles is not None else 0
        if max_cycles is not None and n > max_cycles:
            raise TechnicalError(f"more than {max_cycles} cycles: restrict the selection, or ask for all")
        found.append(closed)
        paths = grown.filter((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
    return reduce(DataFrame.unionByName, found) if found else inner.select(F.array("source").alias("cycle")).limit(0)


def _steps(cycles: DataFrame) -> DataFrame:
    """(cycle, position, source, target): each cycle's pairs of neighbours, in path order."""
    closed = F.concat("cycle", F.slice("cycle", 1, 1))
    steps = cycles.select("cycle", F.posexplode(F.arrays_zip(F.slice(closed, F.lit(1), F.size("cycle")).alias("s"), F.slice(closed, F.lit(2), F.size("cycle")).alias("t"))))
    return steps.select("cycle", F.col("pos").alias("position"), F.col("col")["s"].alias("source"), F.col("col")["t"].alias("target"))


def cycle_edges(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycle, position, source, target, kinds): the edges of each cycle in path order."""
    return _steps(cycles).join(edges.select("source", "target", "kinds"), ["source", "target"])


def cycle_evidence(cycles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(cycle, position, rank, source, target, external, kinds): the edges behind each step of each cycle.

    ``cycles`` run over labels; ``evidence`` has an edge a row with its two labels, as
    :func:`edgeloom.plans.edges.labelled` gives it.  Equal edges behind one step count once;
    ``rank`` (from 1) orders the others by source, target, external and kinds.  Edges are ranked
    once for each pair of labels, not for each cycle, and no array of them is built.
    """
    pair = Window.partitionBy("source_label", "target_label")
    rows = evidence.filter("source_label <> target_label").select("source_label", "target_label", "source", "target", "external", "kinds").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(pair.orderBy("source", "target", "external", "kinds")))
    steps = _steps(cycles).withColumnsRenamed({"source": "source_label", "target": "target_label"})
    return steps.join(ranked, ["source_label", "target_label"]).select("cycle", "position", "rank", "source", "target", "external", "kinds")
