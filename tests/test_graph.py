import csv
import io
import itertools
import random
import json
import time

import pytest
from pyspark.sql import functions as F

from edgeloom.errors import TechnicalError, UserError
from edgeloom.functions.patterns import in_folder, in_path, with_name
from edgeloom.operators import cycles, report, rules, traversal
from edgeloom.operators.components import components
from edgeloom.plans import collapse, slices
from edgeloom.plans import edges as E
from edgeloom.sinks import render
from edgeloom.sources import plantuml

#: A bakery: the counter may use the oven, the oven the store; books are shared.
BAKERY = [
    ("counter/till", "oven/baker", "use"), ("counter/till", "store/flour", "path_reference"), ("counter/window", "counter/till", "mod"), ("oven/baker", "store/flour", "use"),
    ("oven/baker", "store/sugar", "use"), ("oven/timer", "oven/baker", "mod"), ("store/sugar", "books/ledger", "use"), ("main", "counter/window", "mod"), ("main", "books/ledger", "use"),
]


def refs(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, external boolean, kind string")


@pytest.fixture(scope="module")
def bakery(spark):
    rows = [(f"src/{a}.rs", f"src/{b}.rs", False, k) for a, b, k in BAKERY]
    files = sorted({x for r in rows for x in r[:2]})
    return E.graph(refs(spark, rows), spark.createDataFrame([(f,) for f in files], "identifier string")).cache()


HARBOUR = [
    ("src/crane/arm.rs", "src/quay/berth.rs", False, "use"), ("src/crane/arm.rs", "src/quay/berth.rs", False, "macro_reference"), ("src/crane/hook.rs", "src/quay/berth.rs", False, "mod"),
    ("src/quay/berth.rs", "src/sea/tide.rs", False, "use"), ("src/sea/tide.rs", "src/sea/moon.rs", False, "pub_use"), ("src/quay/berth.rs", "rope", True, "use"), ("src/crane/arm.rs", "steel", True, "extern_crate"),
]


@pytest.fixture(scope="module")
def harbour(spark):
    files = sorted({x for a, b, external, _ in HARBOUR for x in (a, *([] if external else [b]))}) + ["src/attic/box.rs"]
    return E.graph(refs(spark, HARBOUR), spark.createDataFrame([(f,) for f in files], "identifier string")).cache()


def counted(edges, select=None, fold=lambda x: x, external=False, own=False):
    """(nodes, edges, raw edges, external edges) of a snapshot, by plain Python."""
    rows = {(r.source, r.target, r.external) for r in edges.collect() if external or not r.external}
    names = {x for r in rows for x in r[:2]}
    chosen = names if select is None else select({r[:2] for r in rows if r[0] != r[1]}, names)
    raw = [r for r in rows if r[0] in chosen and r[1] in chosen and (own or r[0] != r[1])]
    shown = {(fold(a), fold(b)) for a, b, _ in raw if own or fold(a) != fold(b)}
    return len({fold(x) for x in chosen}), len(shown), len(raw), sum(r[2] for r in raw)


def closure(links, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        at = todo.pop()
        fresh = {b for a, b in links if a == at} - seen
        seen |= fresh
        todo += fresh
    return seen


def two_folders(path):
    parts = path.split("/")
    return "/".join(parts[: min(2, len(parts) - 1)]) if len(parts) > 1 else path


def flat(df):
    return sorted((r.source, r.target, r.external, tuple(k.kind for k in r.kinds)) for r in df.collect())


def summary(edges, **query):
    r = report.snapshot(edges, report.Query(**query)).summary.first()
    return r.node_count, r.edge_count, r.raw_edge_count, r.external_edge_count


def test_merge(spark):
    got = E.merge_edges(refs(spark, [("p", "q", True, "macro_reference"), ("p", "q", False, "extern_crate"), ("q", "q", True, "mod"), ("p", None, False, "use"), ("p", "r", True, "pub_use"), ("p", "r", True, "pub_use")]))
    assert flat(got) == [("p", "q", False, ("extern_crate", "macro_reference")), ("p", "r", True, ("pub_use",)), ("q", "q", False, ())]


def test_kinds_as_bits(spark):
    rows = [(i, [k for b, k in enumerate(E.KINDS) if i >> b & 1]) for i in range(64)]
    df = spark.createDataFrame(rows, "i int, names array<string>").withColumn("kinds", F.transform("names", E.kind_struct))
    assert df.filter((E.kind_mask("kinds") != F.col("i")) | (E.kind_names(E.kinds_of(E.kind_mask("kinds"))) != F.col("names"))).collect() == []


def test_projected_edges_and_their_evidence(bakery):
    top = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(2))
    rows = {(r.source_label, r.target_label): (r.n_edges, [k.kind for k in r.kinds]) for r in E.project_edges(E.per_edge(bakery), top("source"), top("target")).collect()}
    want = {}
    for a, b, kind in BAKERY:
        part = lambda x: x.split("/")[0] if "/" in x else f"{x}.rs"
        n, kinds = want.get((part(a), part(b)), (0, set()))
        want[part(a), part(b)] = (n + 1, kinds | {kind})
    assert {k: (n, set(kinds)) for k, (n, kinds) in rows.items()} == want
    assert E.labelled(E.per_edge(bakery), top("source"), top("target")).count() == len(BAKERY)
    ends = {r.label: (r.n_in, r.n_out) for r in E.project_to_nodes(bakery).collect()}
    assert ends == {f"src/{x}.rs": (sum(b == x for _, b, _ in BAKERY), sum(a == x for a, _, _ in BAKERY)) for x in {y for r in BAKERY for y in r[:2]}}
    assert E.node_edges(bakery).count() == 2 * len(BAKERY)


def test_aggregate_is_external_if_any_is(spark):
    g = E.merge_edges(refs(spark, [("lib/x/one", "lib/y/one", True, "mod"), ("lib/x/two", "lib/y/two", False, "use"), ("lib/x/two", "lib/y/one", False, "use")]))
    r = report.aggregate(g, collapse.folder_depth(2)).collect()
    assert [(x.source, x.target, x["count"], x.external, [k.kind for k in x.kinds]) for x in r] == [("lib/x", "lib/y", 3, True, ["use", "mod"])]


def test_snapshots_equal_brute_force(bakery, harbour):
    for edges in (bakery, harbour):
        assert summary(edges) == counted(edges)
        assert summary(edges, include_external=True, include_self=True) == counted(edges, external=True, own=True)
        assert summary(edges, collapse=collapse.folder_depth(2)) == counted(edges, fold=two_folders)
        for glob, prefix in (("src/oven/**", "src/oven/"), ("src/quay/**", "src/quay/"), ("src/store/sugar.rs", "src/store/sugar.rs")):
            seeds = lambda names, prefix=prefix: {n for n in names if n.startswith(prefix)}
            out = lambda links, names: closure(links, seeds(names))
            back = lambda links, names: closure({(b, a) for a, b in links}, seeds(names))
            near = lambda links, names: seeds(names) | {x for p in links for x in p if set(p) & seeds(names)}
            assert summary(edges, reachable_from=[in_path(glob)]) == counted(edges, out)
            assert summary(edges, dependents_of=[in_path(glob)]) == counted(edges, back)
            assert summary(edges, focus=[(in_path(glob), 1)]) == counted(edges, near)
            assert summary(edges, focus=[(in_path(glob), 0)]) == counted(edges, lambda _, names: seeds(names))
            both = lambda links, names: out(links, names) | {n for n in names if "attic" in n or "books" in n}
            assert summary(edges, reachable_from=[in_path(glob)], focus=[(in_path("src/attic/**"), 0), (in_path("src/books/**"), 0)]) == counted(edges, both)


def test_numbers_of_nodes_follow_their_labels(harbour):
    shot = report.snapshot(harbour, report.Query(collapse=collapse.by_pattern("src/([^/]+)/.*")))
    labels = sorted({f.split("/")[1] for f in [*(x for r in HARBOUR if not r[2] for x in r[:2]), "src/attic/box.rs"]})
    assert {r.label: r.id for r in shot.nodes.collect()} == {x: f"n{i}" for i, x in enumerate(labels)}
    with pytest.raises(UserError):
        collapse.by_pattern("(.*)", "")


def test_file_dependency_moods(spark):
    names = ["till", "oven", "flour_sack", "sugar_sack"]
    rows = [(f"kitchen/{a}.rs", f"{'store' if 'sack' in b else 'kitchen'}/{b}.rs") for a in names[:2] for b in names if a != b]
    g = E.merge_edges(refs(spark, [(*r, False, "use") for r in rows]))
    subjects = [with_name("till.rs")]
    for objects, hit in (([in_folder("store")], lambda t: t.startswith("store/")), ([in_folder("store"), with_name("f*.rs")], lambda t: t == "store/flour_sack.rs"), ([], lambda t: False)):
        for negated in (False, True):
            want = sorted(b for a, b in rows if a == "kitchen/till.rs" and hit(b) == negated)
            assert sorted(r.target for r in rules.file_dependencies(g, subjects, objects, negated).collect()) == want


def test_layers(bakery):
    base = lambda: rules.Layers().layer("counter", in_folder("src/counter")).layer("oven", in_path("src/oven/**")).layer("store", in_folder("src/store"))
    of = lambda found: sorted((r.source_layer, r.target_layer, r.rule.split("-")[1]) for r in found.collect())
    free = base().may_only_depend_on("counter", "oven", "store").may_only_depend_on("oven", "store").may_only_depend_on("store")
    assert of(free.violations(bakery)) == []
    assert of(base().may_only_depend_on("counter", "oven").violations(bakery)) == [("counter", "store", "only")]
    assert of(base().may_only_depend_on("oven").violations(bakery)) == [("oven", "store", "only")] * 2
    assert of(base().may_only_depend_on("counter", "oven", "store").may_not_depend_on("counter", "store").violations(bakery)) == [("counter", "store", "not")]
    absent = base().layer("cellar", in_folder("src/cellar")).may_only_depend_on("cellar")
    assert [r.subject for r in absent.empty_layers(bakery).collect()] == ["layer 'cellar'"]
    assert absent.empty_layers(bakery, allow_empty=True).count() == 0
    for wrong in (lambda: base().may_only_depend_on("counter", "roof").violations(bakery), lambda: base().may_not_depend_on("counter")):
        with pytest.raises(UserError):
            wrong()
    all_in_one = rules.Layers().layer("house", in_path("src/**")).layer("store", in_folder("src/store")).may_only_depend_on("house")
    assert all_in_one.violations(bakery).count() == 0  # the first layer that matches wins


def test_layer_patterns_run_on_merged_edges(bakery, spark):
    """No pattern may move below the merge of raw references."""
    raw = refs(spark, [(f"src/{a}.rs", f"src/{b}.rs", False, k) for a, b, k in BAKERY])
    layers = rules.Layers().layer("counter", in_folder("src/counter")).layer("store", in_folder("src/store")).may_only_depend_on("counter")
    plan = layers.violations(E.merge_edges(raw))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RLIKE") <= 8


def test_slices(spark, bakery):
    by = slices.by_pattern("src/(**)/")
    assert rules.forbidden_slice(bakery, by, "counter", "store").count() == 1
    assert rules.forbidden_slice(bakery, slices.by_regex(r"\Asrc/([^/]+)/"), "store", "counter").count() == 0
    names, arrows = plantuml.parse("component [counter]\n[counter] --> [oven]\n[oven] --> [store]\n[store] --> [books]\n")
    left = lambda **how: sorted((r.source_label, r.target_label) for r in rules.diagram_adherence(bakery, by, names, arrows, **how).collect())
    assert left() == left(ignore_orphans=True) == [("counter", "store")]
    paths = spark.createDataFrame([(r"lib\group\bread\src\rye.rs", "src/rye_recipe.rs"), ("lib/bread/docs/rye.rs", "src/rye.rs")], "a string, b string")
    suffix = slices.by_file_suffix({"recipe": "plain", "_recipe": "recipes", "_order": "orders"})
    got = paths.select(slices.by_pattern("lib/**/(**)/src/").label(F.col("a")), suffix.label(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("bread", "recipes"), (None, None)]
    for bad_spec in (lambda: slices.by_pattern("lib/**"), lambda: slices.by_pattern("(**)/(**)"), lambda: slices.by_regex("lib"), lambda: slices.by_regex(r"\(lib\)"), lambda: slices.by_file_suffix({})):
        with pytest.raises(UserError):
            bad_spec()


def brute_cycles(n, links):
    found = set()
    for size in range(2, n + 1):
        for path in itertools.permutations(range(n), size):
            if path[0] == min(path) and all((a, b) in links for a, b in zip(path, (*path[1:], path[0]), strict=True)):
                found.add(path)
    return found


def test_all_digraphs_on_four_nodes_in_one_plan(spark):
    pairs = [(a, b) for a in range(4) for b in range(4) if a != b]
    masks = [*range(0, 4096, 37), 4095]
    rows = [(f"{m:04d}/{a}", f"{m:04d}/{b}", False, "use") for m in masks for i, (a, b) in enumerate(pairs) if m >> i & 1]
    got = {}
    for r in cycles.elementary_cycles(E.merge_edges(refs(spark, rows))).collect():
        got.setdefault(int(r.cycle[0][:4]), set()).add(tuple(int(x[-1]) for x in r.cycle))
    for m in masks:
        assert got.get(m, set()) == brute_cycles(4, {p for i, p in enumerate(pairs) if m >> i & 1}), m
    assert len(got[4095]) == 20


def test_cycles_are_bounded_and_kinds_excluded(spark):
    rows = [(str(a), str(b), False, "use") for a in range(5) for b in range(5) if a != b]
    g = E.merge_edges(refs(spark, [*rows, ("x", "x", False, "use")]))
    with pytest.raises(TechnicalError):
        cycles.elementary_cycles(g, max_cycles=83)
    assert cycles.elementary_cycles(g, max_cycles=84).count() == cycles.elementary_cycles(g).count() == 84
    assert rules.no_cycles(g, [], ("use",)).count() == 0


def links_of(spark, pairs):
    return E.merge_edges(refs(spark, [(str(a), str(b), False, "use") for a, b in pairs]))


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    after = {n: {b for a, b in pairs if a == n} for n in nodes}

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    to = {n: reach(n) for n in nodes}
    return {str(n): min(str(m) for m in to[n] if n in to[m]) for n in nodes}


@pytest.mark.parametrize("in_one_task", [3, 100_000])
def test_strong_components_in_tasks_and_by_pivots(spark, in_one_task):
    rng = random.Random(8)
    pairs = [(rng.randrange(16), rng.randrange(16)) for _ in range(24)] + [(100 + i, 101 + i) for i in range(7)] + [(200, 201), (201, 202), (202, 200), (202, 203), (7, 7), (300, 300)]
    got = {r.label: r.component for r in cycles.strong_components(links_of(spark, pairs), in_one_task).collect()}
    assert got == brute_components(pairs)


def test_a_long_chain_and_a_long_ring(spark):
    chain = [(i, i + 1) for i in range(1000)]
    alone = cycles.strong_components(links_of(spark, chain))
    assert alone.filter("label = component").count() == 1001
    ring = cycles.strong_components(links_of(spark, [*chain, (1000, 0), (5000, 0)]))
    assert {r.component: r["count"] for r in ring.groupBy("component").count().collect()} == {"0": 1001, "5000": 1}
    assert cycles.strong_components(links_of(spark, chain).limit(0)).count() == 0


def test_a_large_component_costs_no_square_of_its_nodes(spark):
    """60,000 nodes in one task: naming each node by a search of all took minutes."""
    ring = spark.range(60_000).select(F.col("id").cast("string").alias("source"), ((F.col("id") + 1) % 60_000).cast("string").alias("target"))
    began = time.perf_counter()
    assert [tuple(r) for r in cycles.strong_components(ring).groupBy("component").count().collect()] == [("0", 60_000)]
    assert time.perf_counter() - began < 40


def test_both_searches_of_a_pivot_are_one_walk_and_only_large_parts_have_one(spark, monkeypatch):
    walks, spread = [], cycles.spread
    monkeypatch.setattr(cycles, "spread", lambda *a: walks.append(a) or spread(*a))
    ring = [(i, (i + 1) % 9) for i in range(9)]
    found = cycles.strong_components(links_of(spark, [*ring, (3, 20), (21, 5)]), 4)
    assert {r.label: r.component for r in found.collect()} == brute_components([*ring, (3, 20), (21, 5)])
    assert len(walks) == 1
    walks.clear()
    pairs = [(i * 10 + a, i * 10 + (a + 1) % 3) for i in range(4) for a in range(3)]
    assert {r.label: r.component for r in cycles.strong_components(links_of(spark, pairs), 4).collect()} == brute_components(pairs)
    assert not walks


def test_parts_that_lead_nowhere_add_no_paths(spark):
    """A dense acyclic graph behind and before a cycle has millions of paths, of which none closes."""
    tail = [(f"y{i:02d}", f"y{j:02d}") for i in range(24) for j in range(i + 1, 24)]
    head = [(f"a{i:02d}", f"a{j:02d}") for i in range(24) for j in range(i + 1, 24)]
    ring = [("m", "n"), ("n", "o"), ("o", "m"), ("o", "y00"), ("a23", "m")]
    assert [r.cycle for r in cycles.elementary_cycles(links_of(spark, tail + head + ring)).collect()] == [["m", "n", "o"]]
    inside = [("x", "y00"), ("y23", "w"), ("w", "x"), ("y01", "z"), ("z", "zz")]  # inside a component, but not back to a larger start
    thin = [(a, b) for a, b in tail if int(b[1:]) == int(a[1:]) + 1]
    got = {tuple(r.cycle) for r in cycles.elementary_cycles(links_of(spark, thin + inside)).collect()}
    assert got == {("w", "x", *(f"y{i:02d}" for i in range(24)))}


def test_evidence_of_cycles_is_ordered_and_distinct(spark):
    rows = [("a/1", "b/1", False, "use"), ("a/2", "b/1", False, "mod"), ("a/1", "b/2", False, "use"), ("b/1", "a/1", False, "use"), ("b/3", "c/1", False, "use")]
    edges = E.merge_edges(refs(spark, rows))
    folder = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    seen = E.labelled(edges, folder("source"), folder("target"))
    loops = cycles.elementary_cycles(seen.select(F.col("source_label").alias("source"), F.col("target_label").alias("target")))
    got = cycles.cycle_evidence(loops, seen.unionByName(seen)).orderBy("position", "rank").collect()
    assert [(r.cycle, r.position, r["rank"], r.source, r.target) for r in got] == [
        (["a", "b"], 0, 1, "a/1", "b/1"), (["a", "b"], 0, 2, "a/1", "b/2"), (["a", "b"], 0, 3, "a/2", "b/1"), (["a", "b"], 1, 1, "b/1", "a/1"),
    ]


def test_components_and_walks(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (1, 1), (2, 10), (10, 11), (11, 2)], "a int, b int")
    assert {r.node: r.component for r in components(links).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7, 2: 2, 10: 2, 11: 2}
    g = E.merge_edges(refs(spark, [("a", "b", False, "use"), ("b", "c", False, "use"), ("c", "a", False, "use"), ("d", "a", False, "use")]))
    seed = spark.createDataFrame([("a",)], "label string")
    reach = lambda df: sorted(r.label for r in df.collect())
    assert reach(traversal.reachable_from(g, seed)) == ["a", "b", "c"]
    assert reach(traversal.dependents_of(g, seed)) == ["a", "b", "c", "d"]
    assert reach(traversal.focus(g, seed, 0)) == ["a"]
    assert reach(traversal.reachable_from(g, seed.limit(0))) == []


def test_renderers(spark):
    kinds = lambda *names: [(E.KINDS.index(n), n) for n in names]
    odd, plain = 'cake "x", a\\b', "<tea & milk>"
    rows = [(odd, plain, 3, False, kinds("use", "mod")), (plain, "sugar", 1, True, []), (plain, odd, 1, False, kinds("extern_crate"))]
    edges = spark.createDataFrame(rows, "source string, target string, count bigint, external boolean, kinds array<struct<ord:int,kind:string>>")
    nodes = spark.createDataFrame([("n0", plain), ("n1", odd), ("n2", "sugar")], "id string, label string")
    shot = report.Snapshot(nodes, edges, spark.createDataFrame([(3, 3, 5, 1)], "node_count int, edge_count int, raw_edge_count int, external_edge_count int"), "Menu <& more>")
    lines = list(csv.reader(io.StringIO(render.to_csv(shot))))
    assert lines == [["source", "target", "count", "external", "import_kinds"], *sorted([[a, b, str(n), str(e).lower(), "|".join(k for _, k in ks)] for a, b, n, e, ks in rows])]
    data = json.loads(render.to_json(shot))
    assert {(e["source"], e["target"], e["count"]) for e in data["edges"]} == {r[:3] for r in rows} and [n["id"] for n in data["nodes"]] == ["n0", "n1", "n2"]
    quote = lambda t: '"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"'
    dot, d2, mermaid = render.to_dot(shot), render.to_d2(shot), render.to_mermaid(shot)
    assert f'{quote(odd)} -> {quote(plain)} [label="3", tooltip="use, mod"]' in dot and f'{quote(plain)} -> "sugar" [style=dashed]' in dot
    assert f'{quote(odd)} -> {quote(plain)}: "3"' in d2 and f'{quote(plain)} -> "sugar" {{ style.stroke-dash: 4 }}' in d2
    assert "n1 -->|3| n0" in mermaid and "n0 -.-> n2" in mermaid and "n0 --> n1" in mermaid and 'n0["&lt;tea &amp; milk&gt;"]' in mermaid
    page = render.to_html(shot)
    assert "Menu &lt;&amp; more&gt;" in page and "<tea" not in page and "<script" not in page
    again = render.render(shot, "html")
    assert again == page
    render.MAX_DRAWN, most = 5, render.MAX_DRAWN
    with pytest.raises(UserError):
        render.render(shot, "csv")
    render.MAX_DRAWN = most
    empty = spark.createDataFrame([], "source_label string, target_label string")
    assert render.to_plantuml(empty) == "@startuml\n@enduml\n"
    with pytest.raises(UserError):
        render.render(shot, "png")
    with pytest.raises(UserError):
        render.export("x", " ")


def test_a_walk_of_more_rounds_than_layers(spark):
    links = spark.range(30).selectExpr("cast(id as string) as at", "cast(id + 1 as string) as next")
    seeds = spark.createDataFrame([("3",)], "label string")
    assert sorted(int(r.label) for r in traversal.spread(links, seeds).collect()) == list(range(3, 31))
    assert sorted(int(r.label) for r in traversal.spread(links, seeds, depth=11).collect()) == list(range(3, 15))
