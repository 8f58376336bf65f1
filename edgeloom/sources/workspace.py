"""Workspaces: manifests as a relation, files joined to their nearest manifest, targets, dependencies.

All paths are relative to the workspace's folder; the root's own folder is the empty
text.  A file belongs to the package whose manifest is nearest above it, so files of nested
packages that are no members go by that join, however deep they lie.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import TechnicalError, UserError
from edgeloom.operators.lookup import nearest_ancestor
from edgeloom.sources import rust

_TARGET = "struct<kind:string,name:string,path:string>"
_DEPENDENCY = "struct<name:string,package:string,scope:string,path:string>"
MANIFEST = f"folder string, package string, members array<string>, excluded array<string>, targets array<{_TARGET}>, dependencies array<{_DEPENDENCY}>, error string"
_SHARED = "map<string,struct<package:string,path:string>>"
DEV_KINDS = ["test", "example", "bench"]


def root_of(path: str | None = None) -> str:
    """The folder of the workspace: the outermost manifest with a workspace table above, else the nearest manifest."""
    start = Path(path or ".").resolve()
    if not start.exists():
        raise UserError(f"{path} does not exist")
    nearest = outer = None
    for folder in (start if start.is_dir() else start.parent, *start.parents):
        manifest = folder / "Cargo.toml"
        if manifest.is_file():
            nearest = nearest or folder
            try:
                outer = folder if "workspace" in tomllib.loads(manifest.read_text(encoding="utf-8")) else outer
            except (OSError, tomllib.TOMLDecodeError) as e:
                raise TechnicalError(f"{manifest}: {e}") from e
    if nearest is None:
        raise UserError(f"no manifest at or above {start}")
    return str(outer or nearest)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row for each manifest below ``root`` (``MANIFEST``); one that can't be read has only its folder and the error.

    A dependency with ``workspace = true`` has the package and path that the root's manifest gives its name.
    """
    raw = rust.whole_files(spark, root, "Cargo.toml").select(F.regexp_replace("identifier", "/?Cargo[.]toml$", "").alias("folder"), "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = lambda name: name.replace("-", "_")
        tables = {"dependencies": "normal", "dev-dependencies": "development", "build-dependencies": "build"}

        def row(folder: str, content: str) -> tuple:
            try:
                data = tomllib.loads(content)
            except tomllib.TOMLDecodeError as e:
                return folder, None, [], [], [], [], str(e), {}
            package, space = data.get("package", {}), data.get("workspace", {})
            name = flat(package["name"]) if "name" in package else None
            lib = data.get("lib")
            targets = [] if lib is None else [{"kind": "proc-macro" if lib.get("proc-macro") else "lib", "name": "lib", "path": lib.get("path", "src/lib.rs")}]
            targets += [{"kind": kind, "name": t.get("name"), "path": t.get("path")} for kind in ("bin", "test", "example", "bench") for t in data.get(kind, []) if t.get("path")]
            if isinstance(package.get("build"), str):
                targets.append({"kind": "custom-build", "name": "build", "path": package["build"]})
            found = []
            for holder in (data, *data.get("target", {}).values()):
                for table, scope in tables.items():
                    for visible, spec in holder.get(table, {}).items():
                        spec = spec if isinstance(spec, dict) else {}
                        package = None if spec.get("workspace") is True else flat(spec.get("package", visible))  # null: inherited
                        found.append({"name": flat(visible), "package": package, "scope": scope, "path": spec.get("path")})
            shared = {flat(n): {"package": flat(d.get("package", n)), "path": d.get("path")} for n, d in ((n, d if isinstance(d, dict) else {}) for n, d in space.get("dependencies", {}).items())}
            return folder, name, space.get("members", []), space.get("exclude", []), targets, found, None, shared

        for frame in frames:
            columns = ["folder", "package", "members", "excluded", "targets", "dependencies", "error", "shared"]
            yield pd.DataFrame([row(f, c) for f, c in zip(frame["folder"], frame["content"], strict=True)], columns=columns)

    read_in = raw.mapInPandas(read, f"{MANIFEST}, shared {_SHARED}")
    at_root = read_in.filter("folder = ''").select(F.col("shared").alias("given"))  # one row
    up = F.repeat(F.lit("../"), F.when(F.col("folder") == "", 0).otherwise(F.regexp_count("folder", F.lit("/")) + 1))

    def inherited(d: Column) -> Column:
        own = F.try_element_at("given", d["name"])
        of = lambda value, mine: F.when(d["package"].isNull(), value).otherwise(mine)
        return F.struct(d["name"].alias("name"), of(F.coalesce(own["package"], d["name"]), d["package"]).alias("package"), d["scope"].alias("scope"), of(F.concat(up, own["path"]), d["path"]).alias("path"))

    names = [c for c in read_in.columns if c not in {"shared", "dependencies"}]
    joined = read_in.join(at_root, F.lit(True), "left")
    return joined.select(*names, F.transform("dependencies", inherited).alias("dependencies"))


def plain_path(path: Column) -> Column:
    """Without ``.`` and with every ``..`` taken up."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def below(folder: Column | str, path: Column | str) -> Column:
    return plain_path(F.concat(folder, F.lit("/"), path))


def members(found: DataFrame) -> DataFrame:
    """The manifests of the workspace: the root's own, those its patterns name, and what these depend on by path."""
    root = found.filter("folder = ''").select("members", "excluded").first()  # one row
    if root is None:
        raise UserError("the workspace's folder holds no manifest")
    star = lambda glob: "^" + "[^/]*".join(rust._literal(p).replace("\\?", "[^/]") for p in glob.strip("/").split("*")) + "$"
    named = F.col("folder") == ""
    for glob in root.members:
        named = named | F.col("folder").rlike(star(glob))
    out = F.lit(False)
    for folder in root.excluded:
        out = out | (F.col("folder") == folder.strip("/")) | F.col("folder").startswith(folder.strip("/") + "/")
    packages = found.filter("package is not null").filter(~out)
    known = new = packages.filter(named)
    while not new.isEmpty():  # a round for each step of a chain of path dependencies
        paths = new.select("folder", F.explode("dependencies").alias("d")).filter("d.path is not null").select(below("folder", "d.path").alias("folder")).distinct()
        new = packages.join(paths, "folder", "left_semi").join(known.select("folder"), "folder", "left_anti")
        known = known.unionByName(new)
    return known


def owned_files(files: DataFrame, found: DataFrame, packages: DataFrame) -> DataFrame:
    """(identifier, content, owner, package, inner): files of members with the path inside their package."""
    near = nearest_ancestor(files.select("identifier"), found.select("folder"))
    own = near.join(packages.select("folder", "package"), "folder")
    inner = F.when(F.col("folder") == "", F.col("identifier")).otherwise(F.substr("identifier", F.char_length("folder") + 2))
    return files.join(own, "identifier").select("identifier", "content", F.col("folder").alias("owner"), "package", inner.alias("inner"))


#: Where targets lie that a manifest does not name: (kind, pattern of the path inside the package, name; fixed values).
USUAL = [
    ("lib", r"^src/lib\.rs$", "lib"), ("bin", r"^src/main\.rs$", "main"), ("bin", r"^src/bin/([^/]+?)(?:\.rs|/main\.rs)$", None), ("custom-build", r"^build\.rs$", "build"),
    ("test", r"^tests/([^/]+?)(?:\.rs|/main\.rs)$", None), ("example", r"^examples/([^/]+?)(?:\.rs|/main\.rs)$", None), ("bench", r"^benches/([^/]+?)(?:\.rs|/main\.rs)$", None),
]


def targets(owned: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, owner, kind, name, identifier): root files of all targets; a named one goes before the usual place of its kind."""
    said = packages.select("package", F.col("folder").alias("owner"), F.explode("targets").alias("t")).select("package", "owner", "t.kind", "t.name", below("owner", "t.path").alias("identifier"))
    usual = None
    for kind, pattern, name in USUAL:
        rows = owned.filter(F.col("inner").rlike(pattern)).select("package", "owner", F.lit(kind).alias("kind"), (F.lit(name) if name else F.regexp_extract("inner", pattern, 1)).alias("name"), "identifier")
        usual = rows if usual is None else usual.unionByName(rows)
    lib_said = said.filter(F.col("kind").isin("lib", "proc-macro")).select("package", "owner", F.lit("lib").alias("kind"))
    usual = usual.join(lib_said, ["package", "owner", "kind"], "left_anti")
    named = said.join(owned.select("identifier"), "identifier", "left_semi").unionByName(usual)
    return named.groupBy("package", "owner", "identifier").agg(F.min_by(F.struct("kind", "name"), F.struct((F.col("kind") == "bin").alias("bin"), "kind", "name")).alias("t")).select("package", "owner", "t.kind", "t.name", "identifier")


def production_files(owned: DataFrame, roots: DataFrame, include_dev: bool = False) -> DataFrame:
    """Files without pruned folders and, unless asked for, without development targets and their usual folders."""
    folders = F.transform(F.split("inner", "/"), F.lower)
    kept = owned.filter(~F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*map(F.lit, rust.PRUNED))))
    if include_dev:
        return kept
    kept = kept.filter(~((F.size(folders) > 1) & F.get(folders, F.lit(0)).isin(*rust.DEV)))
    return kept.join(roots.filter(F.col("kind").isin(*DEV_KINDS)).select("identifier"), "identifier", "left_anti")


def visible(packages: DataFrame) -> DataFrame:
    """(owner, name, scope, member): what a package may name; ``member`` is set for a package of the workspace, ``crate`` is what others are called."""
    rows = packages.select(F.col("folder").alias("owner"), F.explode("dependencies").alias("d")).select("owner", "d.name", F.col("d.package").alias("crate"), "d.scope", F.when(F.col("d.path").isNotNull(), below("owner", "d.path")).alias("at"))
    inside = packages.select(F.col("folder").alias("at"), F.col("package").alias("member"))
    return rows.join(inside, "at", "left").select("owner", "name", "scope", "crate", "member").distinct()
