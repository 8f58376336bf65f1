import pytest
from pyspark.sql import functions as F

from edgeloom import api
from edgeloom.errors import UserError
from edgeloom.plans import slices
from edgeloom.sources import rust
from edgeloom.streaming.incremental import merged

SOURCES = {
    "Cargo.toml": '[package]\nname = "demo"\n[dependencies]\nserde = "1"\n',
    "src/lib.rs": "// use crate::nothing::Here;\nmod api;\nmod domain;\npub use crate::api::Handler;\n",
    "src/api/mod.rs": "use crate::domain::{model::Model, service::{run, stop}};\nuse serde::Serialize;\nfn f() { let x = std::mem::take(&mut y); super::domain::model::go(); log::info!(\"a // b\"); }\n",
    "src/domain/mod.rs": "mod model;\nmod service;\n",
    "src/domain/model.rs": "extern crate serde;\n",
    "src/domain/service.rs": "use super::model::Model;\n",
    "target/debug/x.rs": "mod nope;\n",
    "tests/it.rs": "use demo::api;\n",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("project")
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    edges, unknown = rust.extract_graph(spark, str(root))
    return root, edges.cache(), unknown


def test_source_scan(project):
    _, edges, unknown = project
    got = {(r.source, r.target, r.external): [k.kind for k in r.kinds] for r in edges.filter("source <> target").collect()}
    assert got == {
        ("src/lib.rs", "src/api/mod.rs", False): ["pub_use", "mod"],
        ("src/lib.rs", "src/domain/mod.rs", False): ["mod"],
        ("src/api/mod.rs", "src/domain/model.rs", False): ["use", "path_reference"],
        ("src/api/mod.rs", "src/domain/service.rs", False): ["use"],
        ("src/api/mod.rs", "serde", True): ["use"],
        ("src/api/mod.rs", "std", True): ["path_reference"],
        ("src/domain/mod.rs", "src/domain/model.rs", False): ["mod"],
        ("src/domain/mod.rs", "src/domain/service.rs", False): ["mod"],
        ("src/domain/model.rs", "serde", True): ["extern_crate"],
        ("src/domain/service.rs", "src/domain/model.rs", False): ["use"],
    }
    assert {(r.path, r.kind) for r in unknown.collect()} == {("log::info", "macro_reference")}


def test_fluent_rules(project, spark):
    root, edges, _ = project
    bad = api.Files(edges).in_path("src/api/**").should_not().depend_on_files().in_path("src/domain/**").check()
    assert not bad.passed and bad.message.startswith("1. src/api/mod.rs -> src/domain/model.rs [use, path_reference]")
    api.assert_passes(api.Files(edges).in_path("src/domain/**").should_not().depend_on_files().in_path("src/api/**"))
    api.assert_passes(api.Files(edges).should().have_no_cycles())
    assert "no subject" in api.Files(edges).in_path("nowhere/**").should().have_name("x").check().message
    assert api.Files(edges).in_path("nowhere/**").should().have_name("x").allow_empty_tests().check().passed
    assert not api.Files(edges).should_not().depend_on_external_modules().matching("serde").check().passed
    facts = rust.file_facts(rust.source_files(spark, str(root)))
    assert not api.Files(edges, facts).should().adhere_to(F.col("non_blank_line_count") < 4, "too long").check().passed
    layers = api.LayerRules(edges).layer("api", "src/api/**").layer("domain", "src/domain/**").may_only_depend_on_layers("domain")
    assert layers.check().passed
    by = api.SliceRule(edges, slices.by_pattern("src/(**)/"))
    assert not by.should_not_contain_dependency("api", "domain").check().passed
    assert by.should_adhere_to_diagram("[api] -> [domain]", ignoring_external=True).check().passed
    assert "[api] --> [domain]" in by.to_plantuml()
    with pytest.raises(UserError):
        api.Files(edges).in_path("src/[")
    with pytest.raises(AssertionError):
        api.assert_passes(api.Files(edges).should_not().be_in_path("src/**"))


def test_reports_and_metrics(project, spark, tmp_path):
    _, edges, _ = project
    shot = api.GraphReport(edges).collapse_to_folder_depth(2).titled("demo")
    shot.export("csv", str(tmp_path / "a/b.csv"))
    assert "src/api,src/domain,2,false,use|path_reference" in (tmp_path / "a/b.csv").read_text()
    measured = spark.createDataFrame([("a::Big", 9.0), ("Small", 1.0)], "type string, value double")
    assert not api.MetricRule(measured).should_be("below", 5).check().passed
    assert api.MetricRule(measured).for_types_matching("Sm*").should_be("below", 5).check().passed
    with pytest.raises(UserError):
        api.MetricRule(measured).should_be("below", float("nan"))


NAMES = {
    "Cargo.toml": '[package]\nname = "pond"\n[dependencies]\nfish = { package = "trout-kit", version = "1" }\n[dev-dependencies]\nmock = "1"\n[build-dependencies]\ncc = "1"\n',
    "src/lib.rs": "mod shore;\nmod deep;\n", "src/shore.rs": "use crate::deep::mud as floor;\nuse fish::Scale;\nfn f() { floor::dig(); Scale::weigh(); mock::go(); }\n",
    "src/deep/mod.rs": "mod mud;\nmod reed;\nmod twice;\n", "src/deep/mud.rs": "// soft\n", "src/deep/twice.rs": "// one\n", "src/deep/twice/mod.rs": "// two\n", "src/deep/reed.rs": "fn g() { super::super::shore::x(); super::twice::y(); cc::z(); }\n",
    "tests/t.rs": "fn h() { mock::go(); fish::x(); }\n", "build.rs": "fn main() { cc::z(); fish::x(); }\n",
}


def test_names_are_resolved_by_bindings_scopes_and_longest_prefix(spark, tmp_path):
    for name, text in NAMES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    project = rust.locate(str(tmp_path))
    files = rust.source_files(spark, project.root, include_dev=True)
    got = {(r.source, r.path): (r.target, r.outcome) for r in rust.resolve(rust.references(files), files, project).filter("kind = 'path_reference'").collect()}
    shore, reed = "src/shore.rs", "src/deep/reed.rs"
    assert got == {
        (shore, "floor::dig"): ("src/deep/mud.rs", "resolved"), (shore, "Scale::weigh"): ("trout_kit", "external"), (shore, "mock::go"): (None, "unknown"),
        (reed, "super::super::shore::x"): (shore, "resolved"), (reed, "super::twice::y"): (None, "ambiguous"), (reed, "cc::z"): (None, "unknown"),
        ("tests/t.rs", "mock::go"): ("mock", "external"), ("tests/t.rs", "fish::x"): ("trout_kit", "external"), ("build.rs", "cc::z"): ("cc", "external"), ("build.rs", "fish::x"): (None, "unknown"),
    }


def test_checks_say_that_there_is_more_and_builders_do_not_share(project):
    _, edges, _ = project
    message = api.Files(edges).should().be_in_path("nowhere").check(limit=2).message
    assert message.count("\n") == 2 and "more than 2 violations" in message
    base = api.LayerRules(edges).layer("api", "src/api/**").layer("domain", "src/domain/**")
    sealed, free = base.may_only_depend_on_layers("api"), base.may_only_depend_on_layers("api", "domain")
    assert not sealed.check().passed and free.check().passed and not base.layers.allowed


def test_incremental_merge(spark, project):
    _, edges, _ = project
    new = spark.createDataFrame([("src/lib.rs", "src/api/mod.rs", False, "use"), ("x", "y", True, "use")], "source string, target string, external boolean, kind string")
    got = {(r.source, r.target): [k.kind for k in r.kinds] for r in merged(edges, new).collect()}
    assert got["src/lib.rs", "src/api/mod.rs"] == ["use", "pub_use", "mod"] and got["x", "y"] == ["use"]
    assert merged(edges, new).count() == edges.count() + 1
