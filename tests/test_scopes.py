"""Ignore directives, scopes of slices, selectors of metrics, formats."""

import datetime
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from edgeloom import api
from edgeloom.errors import UserError
from edgeloom.functions.identifiers import utc_stamp
from edgeloom.plans import adapters as A
from edgeloom.plans import edges as E
from edgeloom.queries import QUERIES, SQL
from edgeloom.sinks import render
from edgeloom.sources import rust

LIB = """use tea::Leaf; // edgeloom: ignore
// edgeloom: ignore
use milk::Jug;
use set::{Cup, Pot}; // edgeloom: ignore set::Cup
use far::away; // edgeloom: ignore near
use lemon::Zest; // edgeloom: ignored
use sugar::Cube; // a word: ignore
extern crate spoon; // edgeloom: ignore
mod tray; // edgeloom: ignore tray
mod cloth;
// edgeloom: ignore

use kept::After;
pub use honey::{
    Comb, // edgeloom: ignore
    Drop,
};
use rum::Cask; use gin::Still; // edgeloom: ignore
// edgeloom: ignore
use ice::Cold; use fire::Hot;
    // edgeloom: ignore deep::er, other
    pub(crate) use deep::er::Yet;
use deep::erer;
fn f() { use twice::Same; // edgeloom: ignore
}
fn g() { use twice::Same; }
fn h() { use once::Gone; // edgeloom: ignore
}
"""


def test_ignore_directives(spark):
    files = spark.createDataFrame([("src/lib.rs", LIB), ("src/none.rs", ""), ("src/other.rs", "use tea::Leaf;")], "identifier string, content string")
    got = {(r.source, r.path, r.kind) for r in rust.references(files).collect()}
    lib = {(p, k) for s, p, k in got if s == "src/lib.rs" and k != "path_reference"}
    assert lib == {
        ("set::Pot", "use"), ("far::away", "use"), ("lemon::Zest", "use"), ("sugar::Cube", "use"), ("self::cloth", "mod"), ("kept::After", "use"), ("honey::Comb", "pub_use"), ("honey::Drop", "pub_use"),
        ("rum::Cask", "use"), ("fire::Hot", "use"), ("deep::erer", "use"), ("twice::Same", "use"),
    }
    assert ("src/other.rs", "tea::Leaf", "use") in got
    assert {r.path for r in rust.references(files, "absent").collect()} >= {"tea::Leaf", "milk::Jug", "spoon", "self::tray", "once::Gone"}


@pytest.fixture(scope="module")
def shop(spark):
    rows = [("src/till/a.rs", "src/oven/b.rs", False, "use"), ("src/oven/b.rs", "src/store/c.rs", False, "use"), ("src/till/a.rs", "src/store/c.rs", False, "mod")]
    return E.graph(spark.createDataFrame(rows, "source string, target string, external boolean, kind string")).cache()


def test_slice_scopes(shop, tmp_path):
    scope = api.SliceScope(shop)
    by = scope.defined_by("src/(**)/")
    assert not by.should_not().contain_dependency("till", "oven").check().passed
    assert by.should_not().contain_dependency("store", "till").check().passed
    assert not scope.defined_by_regex("src/([a-z]+)/").should_not().contain_dependency("till", "store").check().passed
    diagram = tmp_path / "d.puml"
    diagram.write_text("[till] -> [oven]\n[oven] -> [store]\n")
    assert "till" in by.should().adhere_to_diagram_in_file(str(diagram)).check().message
    by.export_as_plantuml(str(tmp_path / "out.puml"))
    assert by.should().adhere_to_diagram((tmp_path / "out.puml").read_text()).check().passed
    assert not scope.should_not().contain_dependency("src/till/a.rs", "src/oven/b.rs").check().passed
    for bad in (lambda: by.should().contain_dependency("a", "b"), lambda: by.should_not().adhere_to_diagram("[a]"), lambda: scope.defined_by("src/x")):
        with pytest.raises(UserError):
            bad()


@pytest.fixture(scope="module")
def metrics(spark, shop):
    types = spark.createDataFrame([("Till", "struct", "src/till/a.rs"), ("Coin", "trait", "src/till/a.rs"), ("Oven", "struct", "src/oven/b.rs")], "type string, kind string, file string")
    methods = spark.createDataFrame([("Till", "open"), ("Till", "close"), ("Oven", "heat")], "type string, method string")
    fields = spark.createDataFrame([("Till", "sum"), ("Till", "drawer")], "type string, field string")
    accesses = spark.createDataFrame([("Till", "open", "drawer"), ("Till", "close", "drawer")], "type string, method string, field string")
    files = spark.createDataFrame([("src/till/a.rs", 1, 1, 40, 7), ("src/oven/b.rs", 0, 1, 10, 3), ("src/store/c.rs", 0, 0, 5, 0)], "file string, traits bigint, concrete bigint, loc bigint, uses bigint")
    return api.Metrics(types, methods, fields, accesses, files, shop)


def values(rule, key):
    return {r[key]: r.value for r in rule.measured.collect()}


def test_metric_selectors(metrics, tmp_path):
    assert values(metrics.count("methods"), "type") == {"Till": 2, "Coin": 0, "Oven": 1}
    assert values(metrics.in_path("src/till/**").for_types_matching("T*").count("fields"), "type") == {"Till": 2}
    assert values(metrics.count("uses"), "file") == {"src/till/a.rs": 7, "src/oven/b.rs": 3, "src/store/c.rs": 0}
    # a type selector counts types anew, keeps other counts and drops files without any
    kept = metrics.for_types_matching("[CO]*")
    assert values(kept.count("uses"), "file") == {"src/till/a.rs": 7, "src/oven/b.rs": 3}
    assert values(kept.count("concrete_types"), "file") == {"src/till/a.rs": 0, "src/oven/b.rs": 1}
    assert values(metrics.lcom("lcom96a"), "type") == {"Till": 1.0, "Oven": 0.0}
    assert values(metrics.lcom("lcom4"), "type") == {"Till": 1.0, "Oven": 1.0}
    # coupling is that of the whole project, whatever is selected
    every, one = values(metrics.distance("instability"), "file"), values(metrics.for_types_matching("Coin").distance("instability"), "file")
    assert one == {"src/till/a.rs": every["src/till/a.rs"]} and every["src/oven/b.rs"] == 0.5
    assert not metrics.custom_metric("m", "methods", F.col("m")).should_be("below", 2).check().passed
    metrics.for_types_matching("Till").export_as_html(str(tmp_path / "m"), css="a{}</STYLE><b>", stamp=86_399)
    page = (tmp_path / "m.html").read_text()
    assert "<td>Till.fields</td><td>2.0</td>" in page and "1970-01-01T23:59:59Z" in page and "</STYLE" not in page
    for bad in (lambda: metrics.count("nothing"), lambda: metrics.lcom("lcom9"), lambda: metrics.distance("far"), lambda: metrics.measure(())):
        with pytest.raises(UserError):
            bad()
    message = metrics.distance().not_in_zone_of_pain().check().message
    assert message == "1. 'src/store/c.rs' is in the zone of pain (abstractness 0.000, instability 0.000)"


def test_formats(spark):
    seconds = [0, -1, 86_400, 951_782_399, 951_782_400, 1_709_251_199, 4_102_444_800]
    at = lambda s: (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")
    frame = spark.createDataFrame([(s,) for s in [*seconds, None]], "s bigint")
    assert {r.s: r.t for r in frame.select("s", utc_stamp("s").alias("t")).collect()} == {**{s: at(s) for s in seconds}, None: None}
    row = spark.createDataFrame([("a\r\nb\rc\nd<",)], "c string").select(render.mermaid_label(F.col("c")).alias("m"), render.single_line(F.col("c")).alias("s")).first()
    assert (row.m, row.s) == ("a<br/>b<br/>c<br/>d&lt;", "a  b c d<")


def test_stamps_of_years_that_have_not_four_digits(spark, tmp_path):
    frame = spark.createDataFrame([(253402300799,), (253402300800,), (775000000000,), (-62135596801,), (-62167219201,), (-69000000000,), (-90000000000,)], "s long")
    got = [r.t for r in frame.select(utc_stamp("s").alias("t")).collect()]
    assert got[:4] == ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "26528-10-09T09:46:40Z", "0000-12-31T23:59:59Z"]
    assert [t[: t.index("-", 1)] for t in got[4:]] == ["-1", "-217", "-882"]
    spark.range(0, 9_000_000, 99_993).union(spark.range(-1_200_000, -600_000, 99_991)).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    want = duckdb.connect().execute(SQL["c10_utc_stamp"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["c10_utc_stamp"](spark, str(tmp_path)).collect())) == sorted(want)


def test_tasks_of_the_joins_of_line_items_follow_their_number(spark, sf_dir, monkeypatch):
    """A fixed number of partitions lets the rows that one task sorts grow with the tables."""
    t = A.Tables(spark, sf_dir)
    counted = lambda make: {tuple(r) for r in make(t).groupBy("source", "target", "external", "kind").count().collect()}
    before = [counted(make) for make in (A.trade_refs, A.brand_refs)]
    monkeypatch.setattr(A, "ROWS_OF_A_TASK", 500, raising=False)
    monkeypatch.setattr(A, "ROWS_OF_A_BROADCAST", 5, raising=False)
    tasks = -(-t.lineitem.count() // 500)
    for make, want in zip((A.trade_refs, A.brand_refs), before):
        plan = make(t)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(rf"hashpartitioning\(l_orderkey#\d+L?, {tasks}\), REPARTITION_BY_NUM", plan)) >= 2
        assert "ShuffledHashJoin" in plan
        assert counted(make) == want
