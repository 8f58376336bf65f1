"""Rust source trees as file facts, references and a graph, by DataFrame functions.

Files are read whole and in parallel; comments and strings are blanked; declarations
(``mod``, ``use``, ``extern crate``), qualified paths and macro paths are taken by
patterns, and references are resolved by joins: a first segment that a ``use`` of the same
file binds stands for what it names, modules are found by their longest known prefix,
other first segments among the manifest's dependencies that the file may use.  A reference
with several candidates is ambiguous and draws no edge.  A fold over the brackets of a
file takes attributes and the arguments of macros out of its code, at any depth: paths in
``derive`` and paths of attributes are macro references, all else in them is none.  This is
a scan, not a compiler's parser: ``#[path]`` is followed by :mod:`edgeloom.sources.modules` only.

A comment ``// edgeloom: ignore`` (the word is an argument) after a declaration, or alone
on the line before it, drops that declaration's references; paths behind ``ignore`` limit
it to these and to what lies below them.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import TechnicalError, UserError
from edgeloom.functions import identifiers as ids
from edgeloom.operators.lookup import longest_prefix
from edgeloom.plans import edges as E

#: Folders that are never searched, and folders of development targets (fixed values).
PRUNED = [".cache", ".git", ".hg", ".svn", "node_modules", "target", "vendor"]
DEV = ["benches", "examples", "tests"]
SYSROOT = ["std", "core", "alloc", "proc_macro"]


def _comment(depth: int) -> str:
    """A block comment with comments inside it, ``depth`` levels deep; possessive, so that long ones need no stack."""
    inner = f"|{_comment(depth - 1)}" if depth else ""
    return rf"/\*[^*/]*+(?:(?:\*++(?!/)|/(?!\*){inner})[^*/]*+)*+\*++/"


_BLANKED = rf"(?s){_comment(4)}|//[^\n]*|\"(?:\\.|[^\"\\])*\"|r#*\".*?\"#*"
_MOD = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"
_USE = r"(?:^|[\s;{}])((?:pub(?:\([^)]*\))?\s+)?)use\s+([^;]+);"
_EXTERN = r"extern\s+crate\s+(\w+)"
_PATH = r"(?<![\w:])((?:\w+::)+\w+)(?![\w:!])"
_MACRO = r"(?<![\w:])((?:\w+::)+\w+)!"
#: What opens an attribute and the arguments of a macro (a name may stand before them, as in a definition).
_ATTRIBUTE, _ARGUMENTS = r"#!?\s*\[", r"(?<=\w)!\s*(?:\w+\s*)?[(\[{]"
#: Every character of a code, a bracket or an opening at a time; a bracket in a character literal is none.
_BRACKETS = rf"'(?:\\[^\n']+|[^\\'\n])'|\\?'|{_ATTRIBUTE}|{_ARGUMENTS}|[()\[\]{{}}]|[^'#!()\[\]{{}}\\]+|[#!\\]"
_GROUPS = "struct<at:int,depth:int,start:int,attribute:boolean,found:array<struct<start:int,end:int,attribute:boolean>>>"
_NAME = r"\w+(?:\s*::\s*\w+)*"
#: The word that opens an ignore directive.
MARKER = "edgeloom"
#: Directives are written as these before comments are blanked: alone on a line, after code, and their end.
_ALONE, _AFTER, _END = "\u0001", "\u0002", "\u0003"
_NO_DECLARATION = r"(?:(?!\b(?:use|mod|extern)\b)[^\n\u0002])*"
_DECLARATION = rf"((?:\bpub(?:\([^)]*\))?\s+)?)\b(use\s[^;\u0001\u0002]+|mod\s+\w+\s*|extern\s+crate\s+\w[^;\u0001\u0002]*);"
_DIRECTED = rf"(?:(\u0001[^\u0003]*\u0003)[ \t]*\n{_NO_DECLARATION}?)?{_DECLARATION}(?:{_NO_DECLARATION}(\u0002[^\u0003]*\u0003))?"


@dataclass(frozen=True)
class Project:
    root: str
    name: str
    dependencies: tuple[str, ...] = field(default=())
    #: (visible name, package, scope: normal, development or build)
    scoped: tuple[tuple[str, str, str], ...] = field(default=())


def locate(path: str | None = None) -> Project:
    """The nearest manifest at or above a folder or file, and the names it makes visible."""
    start = Path(path or ".").resolve()
    if not start.exists():
        raise UserError(f"{path} does not exist")
    for folder in (start if start.is_dir() else start.parent, *start.parents):
        manifest = folder / "Cargo.toml"
        if manifest.is_file():
            try:
                data = tomllib.loads(manifest.read_text(encoding="utf-8"))
            except (OSError, tomllib.TOMLDecodeError) as e:
                raise TechnicalError(f"{manifest}: {e}") from e
            flat = lambda name: name.replace("-", "_")
            tables = {"dependencies": "normal", "dev-dependencies": "development", "build-dependencies": "build"}
            scoped = [(flat(n), flat(spec.get("package", n) if isinstance(spec, dict) else n), scope) for table, scope in tables.items() for n, spec in data.get(table, {}).items()]
            return Project(str(folder), flat(data.get("package", {}).get("name", folder.name)), tuple(sorted({n for n, *_ in scoped})), tuple(scoped))
    raise UserError(f"no manifest at or above {start}")


def whole_files(spark: SparkSession, root: str, names: str) -> DataFrame:
    """(identifier, content) of all files below ``root`` whose name matches the glob ``names``."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    path = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/").removeprefix("file://")
    return raw.select(F.regexp_replace(path, f"^(?:file:)?/*{_literal(base.lstrip('/'))}/+", "").alias("identifier"), F.col("value").alias("content"))


def source_files(spark: SparkSession, root: str, include_dev: bool = False) -> DataFrame:
    """(identifier, content) of all ``*.rs`` files below ``root``, without pruned folders."""
    out = whole_files(spark, root, "*.rs")
    parts = F.transform(F.split("identifier", "/"), F.lower)
    keep = ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, PRUNED)))
    return out.filter(keep if include_dev else keep & ~F.get(parts, F.lit(0)).isin(*DEV))


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in r".+*?()[]{}^$|\\" else c for c in text)


def file_facts(files: DataFrame) -> DataFrame:
    """(path, name, extension, directory, content, non_blank_line_count)."""
    return files.select(
        F.col("identifier").alias("path"), ids.stem("identifier").alias("name"), ids.extension("identifier").alias("extension"), ids.folder("identifier").alias("directory"),
        "content", ids.non_blank_lines("content").alias("non_blank_line_count"),
    )


def modules(files: DataFrame) -> DataFrame:
    """(identifier, module): ``crate``, ``crate::a``, .. by the usual places of modules."""
    inner = F.regexp_replace(F.regexp_replace("identifier", r"^(?:.*/)?src/", ""), r"\.rs$", "")
    flat = F.regexp_replace(inner, r"(^|/)(mod|lib|main)$", "")
    return files.select("identifier", F.concat(F.lit("crate"), F.when(flat != "", F.concat(F.lit("::"), F.replace(flat, F.lit("/"), F.lit("::")))).otherwise(F.lit(""))).alias("module"))


def _leaves(path: Column) -> Column:
    """The leaves of ``a::{b, c::{d}}``: innermost groups are spelled out, one for each brace."""
    group = r"([\w:]*)\{([^{}]*)\}"

    def open_one(text: Column, _: Column) -> Column:
        lead, items = F.regexp_extract(text, group, 1), F.split(F.regexp_extract(text, group, 2), ",")
        spelled = F.array_join(F.transform(F.filter(items, lambda i: i != ""), lambda i: F.concat(lead, i)), ",")
        return F.replace(text, F.regexp_extract(text, group, 0), spelled)

    braces = F.filter(F.split(path, ""), lambda c: c == "{")
    return F.filter(F.split(F.aggregate(braces, path, open_one), ","), lambda p: p != "")


def _one_line(use: str | Column) -> Column:
    """A use tree without blanks; ``as`` becomes ``=``."""
    return F.regexp_replace(F.regexp_replace(use, r"\s+as\s+", "="), r"\s+", "")


def bindings(files: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(source, name, bound): what the names mean that the ``use`` declarations of a file bind; ``named`` as for :func:`references`."""
    base = scanned(files, modules(files) if named is None else named)
    leaves = base.select("source", "module", F.explode(F.regexp_extract_all("code", F.lit(_USE), F.lit(2))).alias("u")).select("source", "module", F.explode(_leaves(_one_line("u"))).alias("leaf"))
    path = F.regexp_replace(F.split_part("leaf", F.lit("="), F.lit(1)), "::self$", "")
    name = F.when(F.col("leaf").contains("="), F.split_part("leaf", F.lit("="), F.lit(2))).otherwise(F.regexp_extract(path, r"(\w+)$", 1))
    out = leaves.filter(~F.col("leaf").endswith("*")).select("source", name.alias("name"), _absolute(path, F.col("module")).alias("bound"))
    return out.filter("name <> '' and name <> '_' and name <> bound").distinct()


def ignored(files: DataFrame, marker: str = MARKER, named: DataFrame | None = None) -> DataFrame:
    """(source, path, kind, n): references of declarations that a directive covers, and in how many places.

    A directive after code belongs to the nearest declaration before it on its line, one
    alone on a line to the first declaration of the next.
    """
    word = rf"//[ \t]*{_literal(marker)}:[ \t]*ignore((?:[ \t\r][^\n]*)?)$"
    code = F.regexp_replace("content", rf"(?m)^([ \t]*+){word}", f"$1{_ALONE}$2{_END}")
    code = F.regexp_replace(code, rf"(?m)^([ \t]*+(?=\S)(?:(?!//)[^\n])+){word}", f"$1{_AFTER}$2{_END}")
    base = files.filter(F.col("content").contains(marker)).join(modules(files) if named is None else named, "identifier").select(F.col("identifier").alias("source"), "module", F.regexp_replace(code, _BLANKED, " ").alias("code"))
    part = lambda k, name: F.regexp_extract_all("code", F.lit(_DIRECTED), F.lit(k)).alias(name)
    found = base.select("source", "module", F.explode(F.arrays_zip(part(1, "a"), part(2, "v"), part(3, "d"), part(4, "b"))).alias("e")).select("source", "module", "e.*").filter("a <> '' or b <> ''")
    scopes = lambda c: F.when(F.col(c) != "", F.filter(F.split(F.translate(c, _ALONE + _AFTER + _END, ""), r"[\s,]+"), lambda x: x != ""))
    word_of = F.regexp_extract("d", r"^(use|mod|extern)", 1)
    named = F.regexp_extract("d", r"^(?:mod|extern\s+crate)\s+(\w+)", 1)
    path = F.when(word_of == "mod", F.array(F.concat(F.lit("self::"), named))).when(word_of == "extern", F.array(named)).otherwise(_leaves(_one_line(F.regexp_replace("d", r"^use\s+", ""))))
    kind = F.when(word_of == "mod", F.lit("mod")).when(word_of == "extern", F.lit("extern_crate")).when(F.col("v") != "", F.lit("pub_use")).otherwise(F.lit("use"))
    out = found.select("source", "module", kind.alias("kind"), scopes("a").alias("a"), scopes("b").alias("b"), F.explode(path).alias("path")).withColumn("path", _plain("path"))
    said = _bare(F.when(F.col("kind") == "mod", _absolute(F.col("path"), F.col("module"))).otherwise(F.col("path")))
    covers = lambda c: F.coalesce((F.size(c) == 0) | F.exists(c, lambda s: (said == _bare(s)) | said.startswith(F.concat(_bare(s), F.lit("::")))), F.lit(False))
    return out.filter(covers(F.col("a")) | covers(F.col("b"))).groupBy("source", "path", "kind").agg(F.count(F.lit(1)).alias("n"))


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, "^(?:::)?(?:(?:crate|self|super)::)*", "")


def groups(code: Column | str) -> Column:
    """(start, end, attribute) of every attribute, and of what stands in the brackets of every macro; positions from 0.

    Groups inside a group belong to it; one that is never closed is none.
    """
    start = F.expr(f"cast(named_struct('at', 0, 'depth', 0, 'start', 0, 'attribute', false, 'found', array()) as {_GROUPS})")

    def step(s: Column, token: Column) -> Column:
        end = s["at"] + F.char_length(token)
        literal, outside = token.startswith("'"), s["depth"] == 0
        attribute, arguments = token.rlike(f"^{_ATTRIBUTE}$"), token.rlike(r"^!\s*(?:\w+\s*)?[(\[{]$")
        opens, closes = ~literal & token.rlike(r"[(\[{]$"), ~literal & token.rlike(r"^[)\]}]$")
        depth = F.when(outside, (attribute | arguments).cast("int")).otherwise(s["depth"] + opens.cast("int") - closes.cast("int"))
        whole = F.struct(s["start"].alias("start"), F.when(s["attribute"], end).otherwise(s["at"]).alias("end"), s["attribute"].alias("attribute"))
        found = F.when(~outside & (depth == 0), F.concat(s["found"], F.array(whole))).otherwise(s["found"])
        begun = F.when(outside, F.when(attribute, s["at"]).otherwise(end)).otherwise(s["start"])
        return F.struct(end.alias("at"), depth.alias("depth"), begun.alias("start"), F.when(outside, attribute).otherwise(s["attribute"]).alias("attribute"), found.alias("found")).cast(_GROUPS)

    return F.aggregate(F.regexp_extract_all(code, F.lit(_BRACKETS), F.lit(0)), start, step, lambda s: s["found"])


def scanned(files: DataFrame, named: DataFrame) -> DataFrame:
    """(source, module, code, attributes): code without comments, literals, attributes and arguments of macros; attributes apart."""
    base = files.join(named, "identifier").select(F.col("identifier").alias("source"), "module", F.regexp_replace("content", _BLANKED, " ").alias("whole"))
    base = base.select("source", "module", F.explode(F.array(F.struct("whole", groups("whole").alias("cuts")))).alias("once")).select("source", "module", "once.*")  # generated, so that the fold runs once
    ends = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["end"]))
    starts = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.char_length("whole")))
    part = lambda begin, end: F.substr("whole", begin + 1, end - begin)
    code = F.array_join(F.zip_with(ends, starts, part), " ")
    return base.select("source", "module", code.alias("code"), F.transform(F.filter("cuts", lambda c: c["attribute"]), lambda c: part(c["start"], c["end"])).alias("attributes"))


def _named_by(attribute: Column) -> Column:
    """The paths of two segments or more that an attribute names: its own, or those that it derives."""
    own = F.regexp_extract(attribute, rf"^{_ATTRIBUTE}\s*(?:::\s*)?({_NAME})", 1)
    derived = F.split(F.regexp_extract(attribute, r"(?s)^[^(]*\((.*)\)\s*\]$", 1), ",")
    paths = F.transform(F.when(own == "derive", derived).otherwise(F.array(own)), lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", ""), "^::", ""))
    return F.filter(paths, lambda p: p.rlike(r"^(?:\w+::)+\w+$"))


def _plain(path: str) -> Column:
    """A leaf without its new name, and without a final ``*`` or ``self``."""
    return F.regexp_replace(F.regexp_replace(path, r"=\w+$", ""), r"::(\*|self)$", "")


def references(files: DataFrame, marker: str = MARKER, named: DataFrame | None = None) -> DataFrame:
    """(source, module, path, kind): every reference as it is written, made absolute to ``crate``.

    A reference goes if directives cover all the places that make it.  ``named``
    (identifier, module) says which module a file is; without it, its usual place does.
    """
    base = scanned(files, modules(files) if named is None else named)
    every = lambda pattern, group=1: F.explode(F.regexp_extract_all("code", F.lit(pattern), F.lit(group)))
    mods = base.select("source", "module", every(_MOD).alias("name")).select("source", "module", F.concat(F.lit("self::"), "name").alias("path"), F.lit("mod").alias("kind"))
    uses = base.select("source", "module", F.explode(F.arrays_zip(F.regexp_extract_all("code", F.lit(_USE), F.lit(2)).alias("p"), F.regexp_extract_all("code", F.lit(_USE), F.lit(1)).alias("v"))).alias("u"))
    uses = uses.select("source", "module", F.explode(_leaves(_one_line("u.p"))).alias("path"), F.when(F.col("u.v") != "", F.lit("pub_use")).otherwise(F.lit("use")).alias("kind"))
    extern = base.select("source", "module", every(_EXTERN).alias("path"), F.lit("extern_crate").alias("kind"))
    rest = base.withColumn("code", F.regexp_replace("code", r"(?<![\w])use\s+[^;]+;", ";"))
    paths = rest.select("source", "module", every(_PATH).alias("path"), F.lit("path_reference").alias("kind"))
    macros = rest.select("source", "module", every(_MACRO).alias("path"), F.lit("macro_reference").alias("kind"))
    named_by = base.select("source", "module", F.explode("attributes").alias("a")).select("source", "module", F.explode(_named_by(F.col("a"))).alias("path"), F.lit("macro_reference").alias("kind"))
    out = mods.unionByName(uses).unionByName(extern).unionByName(paths).unionByName(macros).unionByName(named_by).withColumn("path", _plain("path"))
    out = out.groupBy("source", "module", "path", "kind").agg(F.count(F.lit(1)).alias("places"))
    kept = out.join(ignored(files, marker, named), ["source", "path", "kind"], "left").filter("n is null or n < places")
    return kept.select("source", "module", "path", "kind", _absolute(F.col("path"), F.col("module")).alias("absolute"))


def _absolute(path: Column, module: Column) -> Column:
    """``self::`` is the module, every ``super::`` one level up from it."""
    lead = F.regexp_extract(path, "^(self::)?(super::)*", 0)
    parts = F.split(module, "::")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.regexp_count(lead, F.lit("super")), F.lit(1))), "::")
    return F.when(lead == "", path).otherwise(F.concat(up, F.lit("::"), F.substr(path, F.char_length(lead) + 1)))


def resolve(refs: DataFrame, files: DataFrame, project: Project) -> DataFrame:
    """(source, target, external, kind, path, outcome); target is null where the outcome is ``unknown`` or ``ambiguous``."""
    keys = ["source", "path", "kind"]
    first = F.split_part("path", F.lit("::"), F.lit(1))
    names = refs.withColumn("name", F.when(F.col("kind").isin("path_reference", "macro_reference"), first))
    named = names.join(bindings(files), ["source", "name"], "left")  # what a use binds goes before anything else
    absolute = F.when(F.col("bound").isNotNull(), F.concat("bound", F.substr(F.col("path"), F.char_length("name") + 1))).otherwise(F.col("absolute"))
    named = named.select(*keys, "module", absolute.alias("absolute"), "bound")
    local = F.concat("module", F.lit("::"), "absolute")  # a name of the own module, if it has such a child
    tried = named.withColumn("full", F.explode(F.when(F.col("bound").isNotNull(), F.array("absolute")).otherwise(F.array("absolute", local))))
    index = modules(files).select(F.col("module").alias("prefix"), F.col("identifier").alias("target"))
    inner = (F.col("full") == F.col("absolute")) | (F.char_length("prefix") > F.char_length("module"))
    found = longest_prefix(tried, index, keys, "full", where=inner).select(*keys, F.col("target").alias("inner"), "candidates")
    crates = named.groupBy(*keys).agg(F.min("absolute").alias("absolute")).withColumn("crate", _crate(project))
    out = refs.select(*keys).distinct().join(found, keys, "left").join(crates, keys, "left")
    external = F.col("candidates").isNull()
    outcome = F.when(F.col("candidates") > 1, F.lit("ambiguous")).when(F.col("inner").isNotNull(), F.lit("resolved")).when(F.col("crate").isNotNull(), F.lit("external")).otherwise(F.lit("unknown"))
    return out.select("source", F.when(external, F.col("crate")).otherwise(F.col("inner")).alias("target"), external.alias("external"), "kind", "path", outcome.alias("outcome"))


def _crate(project: Project) -> Column:
    """The package that the first segment names, among those that the scope of the source file sees."""
    first = F.split_part("absolute", F.lit("::"), F.lit(1))
    scope = F.when(F.col("source") == "build.rs", F.lit("build")).when(F.split_part("source", F.lit("/"), F.lit(1)).isin(*DEV), F.lit("development")).otherwise(F.lit("normal"))
    sees = {"normal": ["normal"], "development": ["normal", "development"], "build": ["build"]}
    out = F.when(first.isin(*SYSROOT), first)
    for name, package, own in project.scoped or tuple((n, n, "normal") for n in project.dependencies):
        out = out.when((first == name) & scope.isin(*(s for s, seen in sees.items() if own in seen)), F.lit(package))
    return out


def extract_graph(spark: SparkSession, path: str, include_dev: bool = False, marker: str = MARKER) -> tuple[DataFrame, DataFrame]:
    """(graph, references without a target) of the project at ``path``."""
    project = locate(path)
    files = source_files(spark, project.root, include_dev)
    found = resolve(references(files, marker), files, project)
    return E.graph(found, files.select("identifier")), found.filter("target is null and kind <> 'mod'").select("source", "path", "kind", "outcome")
