"""Workspaces of several packages, the module tree with its diagnostics, and lines of code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from edgeloom.errors import UserError
from edgeloom.functions.tokens import lines_of_code
from edgeloom.operators.lookup import nearest_ancestor
from edgeloom.sources import crates, modules, rust, workspace

FILES = {
    "Cargo.toml": '[workspace]\nmembers = ["parts/*"]\nexclude = ["parts/old"]\n',
    "parts/kettle/Cargo.toml": '[package]\nname = "kettle"\nbuild = "make/gen.rs"\n[lib]\npath = "inner/top.rs"\n[[bin]]\nname = "serve"\npath = "run/serve.rs"\n[[test]]\nname = "checks"\npath = "proof/all.rs"\n[dependencies]\nleafy = { package = "tea-leaf", path = "../leaf" }\nserde = "1"\n[dev-dependencies]\nmock = "1"\n[target.\'cfg(unix)\'.dependencies]\nnix-thing = "1"\n',
    "parts/kettle/inner/top.rs": "mod lid;\nuse leafy::Green;\nuse crate::lid::Knob;\n",
    "parts/kettle/inner/lid.rs": "pub struct Knob;",
    "parts/kettle/run/serve.rs": "fn main() {}",
    "parts/kettle/make/gen.rs": "fn main() {}",
    "parts/kettle/proof/all.rs": "#[test] fn t() {}",
    "parts/kettle/tests/usual.rs": "#[test] fn t() {}",
    "parts/kettle/target/made.rs": "x",
    "parts/kettle/nested/Cargo.toml": '[package]\nname = "foreign"\n',
    "parts/kettle/nested/src/lib.rs": "pub fn foreign() {}",
    "parts/kettle/nested/src/deep/er.rs": "pub fn foreign() {}",
    "parts/leaf/Cargo.toml": '[package]\nname = "tea-leaf"\n[dependencies]\nroot-kit = { path = "../../extra/./kit" }\n',
    "parts/leaf/src/lib.rs": "pub struct Green;",
    "parts/leaf/src/bin/sort.rs": "fn main() {}",
    "parts/leaf/src/bin/dry/main.rs": "fn main() {}",
    "parts/old/Cargo.toml": '[package]\nname = "old"\n',
    "parts/old/src/lib.rs": "pub fn old() {}",
    "extra/kit/Cargo.toml": '[package]\nname = "root-kit"\n[lib]\nproc-macro = true\n',
    "extra/kit/src/lib.rs": "pub fn kit() {}",
    "loose.rs": "fn loose() {}",
    "broken/Cargo.toml": "[package\n",
    "broken/src/lib.rs": "fn b() {}",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop with blank")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert workspace.root_of(str(root / "parts/kettle/inner/lid.rs")) == str(root)
    found = workspace.manifests(spark, str(root)).cache()
    packages = workspace.members(found).cache()
    owned = workspace.owned_files(rust.whole_files(spark, str(root), "*.rs"), found, packages).cache()
    return found, packages, owned, workspace.targets(owned, packages).cache()


def names(df, column="identifier"):
    return sorted(r[column] for r in df.collect())


def test_members_are_named_reached_by_path_or_excluded(shop):
    found, packages, *_ = shop
    assert names(packages, "folder") == ["extra/kit", "parts/kettle", "parts/leaf"]  # kit by a path dependency of a member
    assert [r.folder for r in found.filter("error is not null").collect()] == ["broken"]
    with pytest.raises(UserError):
        workspace.root_of("/no/such/place")
    with pytest.raises(UserError):
        workspace.members(found.filter("folder <> ''"))


def test_files_belong_to_the_nearest_manifest(shop):
    _, _, owned, roots = shop
    got = {r.identifier: r.package for r in workspace.production_files(owned, roots).collect()}
    assert got == {
        "parts/kettle/inner/top.rs": "kettle", "parts/kettle/inner/lid.rs": "kettle", "parts/kettle/run/serve.rs": "kettle", "parts/kettle/make/gen.rs": "kettle",
        "parts/leaf/src/lib.rs": "tea_leaf", "parts/leaf/src/bin/sort.rs": "tea_leaf", "parts/leaf/src/bin/dry/main.rs": "tea_leaf", "extra/kit/src/lib.rs": "root_kit",
    }
    more = set(names(workspace.production_files(owned, roots, include_dev=True)))
    assert more - set(got) == {"parts/kettle/proof/all.rs", "parts/kettle/tests/usual.rs"}


def test_targets_named_and_usual(shop):
    roots = shop[3]
    assert sorted((r.package, r.kind, r.name, r.identifier.rsplit("/", 1)[1]) for r in roots.collect()) == [
        ("kettle", "bin", "serve", "serve.rs"), ("kettle", "custom-build", "build", "gen.rs"), ("kettle", "lib", "lib", "top.rs"), ("kettle", "test", "checks", "all.rs"), ("kettle", "test", "usual", "usual.rs"),
        ("root_kit", "proc-macro", "lib", "lib.rs"), ("tea_leaf", "bin", "dry", "main.rs"), ("tea_leaf", "bin", "sort", "sort.rs"), ("tea_leaf", "lib", "lib", "lib.rs"),
    ]


def test_visible_names_lead_to_members_or_out(shop):
    got = {(r.owner, r.name): (r.scope, r.crate, r.member) for r in workspace.visible(shop[1]).collect()}
    assert got == {
        ("parts/kettle", "leafy"): ("normal", "tea_leaf", "tea_leaf"), ("parts/kettle", "serde"): ("normal", "serde", None), ("parts/kettle", "mock"): ("development", "mock", None),
        ("parts/kettle", "nix_thing"): ("normal", "nix_thing", None), ("parts/leaf", "root_kit"): ("normal", "root_kit", "root_kit"),
    }


def test_graph_of_a_workspace(spark, tmp_path):
    files = FILES | {
        "parts/kettle/inner/top.rs": "mod lid;\nmod gone;\nuse leafy::Green;\nuse crate::lid::Knob;\nuse serde::Ser;\nuse std::fmt;\nuse mock::Fake;\nuse unheard::of;\n",
        "parts/kettle/run/serve.rs": "use kettle::lid::Knob;\nuse nix_thing::fork;\nfn main() { leafy::dry::up(); }\n",
        "parts/leaf/src/lib.rs": "pub struct Green;\npub mod dry { }\nuse root_kit::kit;\n",
        "parts/kettle/proof/all.rs": "use mock::Fake;\nuse kettle::lid;\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = crates.extract_workspace(spark, str(tmp_path / "parts"), include_dev=True)
    got = {(r.source.rsplit("/", 1)[1], r.target.split("parts/")[-1], r.external) for r in found.edges.filter("source <> target").collect()}
    assert got == {
        ("top.rs", "kettle/inner/lid.rs", False), ("top.rs", "leaf/src/lib.rs", False), ("top.rs", "serde", True), ("top.rs", "std", True),
        ("serve.rs", "kettle/inner/lid.rs", False), ("serve.rs", "nix_thing", True), ("serve.rs", "leaf/src/lib.rs", False),
        ("lib.rs", "extra/kit/src/lib.rs", False), ("all.rs", "mock", True), ("all.rs", "kettle/inner/lid.rs", False),
    }
    assert {"parts/leaf/src/bin/sort.rs", "extra/kit/src/lib.rs"} <= {r.source for r in found.edges.filter("source = target").collect()}
    notes = {(r.identifier.rsplit("/", 1)[-1], r.kind, r.subject, r.line) for r in found.diagnostics.collect()}
    assert notes == {("top.rs", "missing_module", "gone", 2), ("top.rs", "unknown", "mock::Fake", 7), ("top.rs", "unknown", "unheard::of", 8), ("broken", "unreadable_manifest", None, None)}


def test_inherited_dependencies_keep_the_package_and_path_of_the_root(spark, tmp_path):
    files = {
        "Cargo.toml": '[workspace]\nmembers = ["in/*"]\n[workspace.dependencies]\nshort-name = { package = "long-name", path = "in/far" }\nlog = "1"\nre = { package = "regex", version = "1" }\n',
        "in/near/Cargo.toml": '[package]\nname = "near"\n[dependencies]\nshort-name = { workspace = true }\nlog.workspace = true\nown = { package = "owned", version = "1" }\nlost.workspace = true\n[dev-dependencies]\nre = { workspace = true, features = ["x"] }\n',
        "in/near/src/lib.rs": "use short_name::Thing;\nuse log::info;\nuse own::It;\n",
        "in/far/Cargo.toml": '[package]\nname = "long-name"\n',
        "in/far/src/lib.rs": "pub struct Thing;",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    packages = workspace.members(workspace.manifests(spark, str(tmp_path)))
    assert {(r.name, r.scope, r.crate, r.member) for r in workspace.visible(packages).collect()} == {
        ("short_name", "normal", "long_name", "long_name"), ("log", "normal", "log", None), ("own", "normal", "owned", None), ("lost", "normal", "lost", None), ("re", "development", "regex", None),
    }
    edges = crates.extract_workspace(spark, str(tmp_path)).edges.filter("source <> target")
    assert {(r.source, r.target) for r in edges.collect()} == {("in/near/src/lib.rs", t) for t in ("in/far/src/lib.rs", "log", "owned")}
    (tmp_path / "Cargo.toml").unlink()
    assert workspace.manifests(spark, str(tmp_path)).count() == 2  # no root: nothing to inherit


ATTRIBUTED = """#![ours::inner]
#[derive(Clone, serde::Serialize, ::deep :: er::Derive,)]
#[serde(with = "not::this")]
#[cfg_attr(feature, derive(no::Such))]
#[tokio::main(flavor = [a::b])]
struct S { #[builder::field] x: kept::Field }
/* no::one /* nested::two */ still::three */
macro_rules! made { () => { use hidden::away; no::body!() } }
fn f() {
    seen::mac!(not::inside, [deep::er, ')']);
    let v = vec![not::either]; if !ok::yes(v) { }
    let c = '{'; let b = '\\''; after::all();
}
use last::one;
"""


def test_attributes_derives_and_macro_arguments(spark):
    files = spark.createDataFrame([("src/lib.rs", ATTRIBUTED), ("src/empty.rs", ""), ("src/open.rs", "#[never::closed(\nuse still::read;"), ("src/null.rs", None)], "identifier string, content string")
    got = {(r.path, r.kind) for r in rust.references(files).filter("source = 'src/lib.rs'").collect()}
    macros = {"ours::inner", "serde::Serialize", "deep::er::Derive", "tokio::main", "builder::field", "seen::mac"}
    assert got == {(p, "macro_reference") for p in macros} | {(p, "path_reference") for p in ("kept::Field", "ok::yes", "after::all")} | {("last::one", "use")}
    assert {r.path for r in rust.references(files).filter("source = 'src/open.rs' and kind = 'use'").collect()} == {"still::read"}
    assert {r.name for r in rust.bindings(files).collect()} == {"one", "read"}


def brute_groups(text):
    """A reading one character at a time."""
    out, i = [], 0
    opening = re.compile(r"#!?\s*\[|(?<=\w)!\s*(?:\w+\s*)?[(\[{]", re.ASCII)
    literal = re.compile(r"'(?:\\[^\n']+|[^\\'\n])'|\\?'")
    while i < len(text):
        if found := literal.match(text, i):
            i = found.end()
            continue
        begun = opening.match(text, i)
        if not begun:
            i += 1
            continue
        attribute, depth, j = text[i] == "#", 1, begun.end()
        while j < len(text) and depth:
            if found := literal.match(text, j):
                j = found.end()
                continue
            depth += (text[j] in "([{") - (text[j] in ")]}")
            j += 1
        if depth:
            break
        out.append((i, j, True) if attribute else (begun.end(), j - 1, False))
        i = j
    return out


def test_groups_equal_a_reading_by_characters(spark):
    rng = random.Random(8)
    marks = ["#[", "#![", "[", "]", "(", ")", "{", "}", "a!(", "b! [", "m! n {", "'", "'('", "\\", "\\'", "x", " ", "\n", "é", "𝒳", "!", "#", "::"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", "#[" + "(" * 40 + ")" * 40 + "]", "a!(" + "x" * 20000 + ")"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rust.groups("t").alias("g")).collect()
    wrong = [(texts[r.i], r.g, brute_groups(texts[r.i])) for r in got if [tuple(g) for g in r.g] != brute_groups(texts[r.i])]
    assert not wrong, wrong[:3]


def test_nested_and_long_comments(spark):
    long = "/*" + "* " * 20000 + "*" * 3000 + "*/"
    rows = [(0, "a/*x/*y*/z*/b"), (1, "a/*/*/*/*/*deep*/*/*/*/*/b"), (2, f"a{long}b"), (3, "a/**/b/***/c"), (4, "a/*/b*/c"), (5, "a/* open"), (6, "a//x /* y\nb")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, t string").select("i", F.regexp_replace("t", rust._BLANKED, " ").alias("t")).collect()}
    assert got == {0: "a b", 1: "a b", 2: "a b", 3: "a b c", 4: "a c", 5: "a/* open", 6: "a \nb"}


def test_nearest_ancestor_equals_brute_force(spark):
    rng = random.Random(2)
    paths = ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    folders = ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(15)]
    for known in (folders, [*folders, ""]):
        got = {r.identifier: r.folder for r in nearest_ancestor(spark.createDataFrame([(p,) for p in paths], "identifier string"), spark.createDataFrame([(f,) for f in known], "folder string")).collect()}
        want = {p: max((f for f in known if f == "" or p.startswith(f + "/")), key=len, default=None) for p in paths}
        assert got == {p: f for p, f in want.items() if f is not None}


TREE = {
    "a/top.rs": '''mod one;
/* mod no; /* mod never; */ mod neither; */
pub mod two; // mod not;
#[path = "../elsewhere/three.rs"]
mod three;
mod inner {
    let s = "mod text; }";
    mod nested;
    #[path = "moved"] pub(crate) mod shelf { mod jar; }
    mod deep { mod er; }
}
mod after;
#[cfg(x)]
mod missing;
mod both;
let r = r#"mod raw; " { "#; mod last;
''',
    "a/one.rs": "mod below;\n",
    "a/one/below.rs": "#[path = \"../one.rs\"]\nmod again;\n",
    "a/two/mod.rs": "mod side;",
    "a/two/side.rs": "",
    "elsewhere/three.rs": "mod own;",
    "elsewhere/three/own.rs": "",
    "a/inner/nested.rs": "",
    "a/moved/jar.rs": "",
    "a/inner/deep/er/mod.rs": "",
    "a/after.rs": "fn f() { }",
    "a/both.rs": "",
    "a/both/mod.rs": "",
    "a/last.rs": "",
    "a/text.rs": "",
    "a/raw.rs": "",
}


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame(list(TREE.items()), "identifier string, content string").repartition(3)
    roots = spark.createDataFrame([("top", "a/top.rs")], "module string, identifier string")
    found, notes = modules.module_tree(files, roots)
    return {r.module: (r.identifier, r.inline) for r in found.collect()}, notes.collect()


def test_module_tree_follows_paths_and_inline_modules(tree):
    assert tree[0] == {
        "top": ("a/top.rs", False), "top::one": ("a/one.rs", False), "top::one::below": ("a/one/below.rs", False), "top::two": ("a/two/mod.rs", False), "top::two::side": ("a/two/side.rs", False),
        "top::three": ("elsewhere/three.rs", False), "top::three::own": ("elsewhere/three/own.rs", False), "top::inner": ("a/top.rs", True), "top::inner::nested": ("a/inner/nested.rs", False),
        "top::inner::shelf": ("a/top.rs", True), "top::inner::shelf::jar": ("a/moved/jar.rs", False), "top::inner::deep": ("a/top.rs", True), "top::inner::deep::er": ("a/inner/deep/er/mod.rs", False),
        "top::after": ("a/after.rs", False), "top::last": ("a/last.rs", False),
    }


def test_missing_ambiguous_and_cyclic_modules_are_noted_with_their_lines(tree):
    assert sorted((r.identifier, r.line, r.kind, r.subject, list(r.candidates)) for r in tree[1]) == [
        ("a/one/below.rs", 2, "module_cycle", "again", ["a/one.rs"]),
        ("a/top.rs", 14, "missing_module", "missing", ["a/missing.rs", "a/missing/mod.rs"]),
        ("a/top.rs", 15, "ambiguous_module", "both", ["a/both.rs", "a/both/mod.rs"]),
    ]


def test_a_tree_without_files(spark):
    none = spark.createDataFrame([], "identifier string, content string")
    found, notes = modules.module_tree(none, none.select(F.col("content").alias("module"), "identifier"))
    assert found.count() == 0 and notes.count() == 0


def brute_lines(text):
    """A reading one character at a time."""
    n, kind, level, code, i = 0, "code", 0, False, 0
    text = "\n".join(line.rstrip("\r") for line in text.split("\n"))
    while i <= len(text):
        c = text[i : i + 1]
        if c in ("", "\n"):
            n += code
            kind = "code" if kind == "line" else kind
            code = kind in ("string", "raw")
            i += 1
        elif kind == "string":
            if c == "\\":
                i += 1
                while text[i : i + 1] == "\n":
                    n, i = n + 1, i + 1
                i += 1 if i < len(text) else 0
            else:
                kind, i = ("code" if c == '"' else kind), i + 1
        elif kind == "raw":
            done = text.startswith('"' + "#" * level, i)
            kind, i = ("code", i + 1 + level) if done else (kind, i + 1)
        elif kind == "block":
            step = {"/*": 1, "*/": -1}.get(text[i : i + 2], 0)
            level, i = level + step, i + (2 if step else 1)
            kind = kind if level else "code"
        elif kind == "line":
            i += 1
        elif text.startswith("//", i):
            kind = "line"
        elif text.startswith("/*", i):
            kind, level, i = "block", 1, i + 2
        else:
            code = code or not c.isspace()
            hashes = len(text) - i - 1 - len(text[i + 1 :].lstrip("#"))
            if c == "r" and text[i + 1 + hashes : i + 2 + hashes] == '"':
                kind, level, i = "raw", hashes, i + 1 + hashes
            elif c == '"':
                kind = "string"
            i += 1
    return n


def test_lines_of_code_equal_a_reading_by_characters(spark):
    rng = random.Random(6)
    marks = ["/", "*", "/*", "*/", "//", '"', "\\", "\n", "\n", "r", "#", 'r#"', '"#', " ", "x", "\t", "\r\n", "ab", "é"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", "a\n", "// c\n/* o\n/* i */\n*/\nlet u = \"//\";\n", 'r##"a\n\n"# still\n"##; x // y', "/*/ no */\n x", "a / b\n/\n", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lines_of_code("t").alias("n")).collect()
    wrong = [(texts[r.i], r.n, brute_lines(texts[r.i] or "")) for r in got if r.n != brute_lines(texts[r.i] or "")]
    assert not wrong, wrong[:3]
