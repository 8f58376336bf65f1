"""The graph of a whole workspace: owned files, the module tree of every target, references resolved by joins.

A target's modules are named ``package#target::..``, so ``crate`` means the target
that a file belongs to; a visible name of a member leads to that member's library.  A file that several
targets hold counts as the library's, if it is one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.lookup import longest_prefix
from edgeloom.plans import edges as E
from edgeloom.plans.lineage import cut
from edgeloom.sources import modules, rust, workspace


@dataclass(frozen=True)
class Extraction:
    #: (source, target, external, kinds)
    edges: DataFrame
    #: (identifier, line, kind, subject, candidates), distinct: unknown, ambiguous, missing_module, ambiguous_module, module_cycle, unreadable_manifest
    diagnostics: DataFrame


def _first(path: Column | str) -> Column:
    return F.split_part(path, F.lit("::"), F.lit(1))


def _rest(path: str) -> Column:
    return F.substr(path, F.char_length(_first(path)) + 1)


def resolve(refs: DataFrame, bound: DataFrame, tree: DataFrame, homes: DataFrame, names: DataFrame) -> DataFrame:
    """(source, path, kind, target, external, outcome) of references.

    ``refs`` and ``bound`` as :mod:`edgeloom.sources.rust` gives them; ``tree``: module,
    identifier; ``homes``: home (a target's root module), owner, scope; ``names``: owner, name, scope, crate, member.
    """
    keys = ["source", "path", "kind"]
    said = refs.withColumn("name", F.when(F.col("kind").isin("path_reference", "macro_reference"), _first("path"))).join(bound, ["source", "name"], "left")
    full = F.when(F.col("bound").isNotNull(), F.concat("bound", F.substr(F.col("path"), F.char_length("name") + 1))).otherwise(F.col("absolute"))
    said = said.select(*keys, "module", full.alias("said"), "bound").withColumn("home", _first("module")).join(homes, "home")
    sees = (F.col("seen") == F.col("scope")) | ((F.col("seen") == "normal") & (F.col("scope") == "development"))
    table = names.select(F.col("owner").alias("by"), F.col("name").alias("visible"), F.col("scope").alias("seen"), "crate", "member")
    met = said.withColumn("first", _first("said")).join(table, (F.col("owner") == F.col("by")) & (F.col("first") == F.col("visible")) & sees, "left")
    met = met.groupBy(*keys, "module", "said", "bound", "home", "first").agg(F.max("member").alias("member"), F.min("crate").alias("crate"))  # seen in several scopes
    absolute = F.when(F.col("first") == "crate", F.concat("home", _rest("said"))).when(F.col("member").isNotNull(), F.concat("member", F.lit("#lib"), _rest("said"))).otherwise(F.col("said"))
    met = met.withColumn("absolute", absolute)
    tried = met.withColumn("full", F.explode(F.when(F.col("bound").isNotNull(), F.array("absolute")).otherwise(F.array("absolute", F.concat("module", F.lit("::"), "absolute")))))
    inner = (F.col("full") == F.col("absolute")) | (F.char_length("prefix") > F.char_length("module"))
    hit = longest_prefix(tried, tree.select(F.col("module").alias("prefix"), F.col("identifier").alias("target")), keys, "full", where=inner)
    outer = F.when(F.col("first").isin(*rust.SYSROOT), F.col("first")).when(F.col("member").isNull(), F.col("crate"))
    crates = met.groupBy(*keys).agg(F.min(outer).alias("crate"))
    out = refs.select(*keys).distinct().join(hit, keys, "left").join(crates, keys, "left")
    external = F.col("candidates").isNull()
    outcome = F.when(F.col("candidates") > 1, "ambiguous").when(F.col("target").isNotNull(), "resolved").when(external & F.col("crate").isNotNull(), "external").otherwise("unknown")
    return out.select(*keys, F.when(external, F.col("crate")).otherwise(F.col("target")).alias("target"), external.alias("external"), outcome.alias("outcome"))


def _first_lines(files: DataFrame, refs: DataFrame) -> DataFrame:
    """``refs`` (source, path) with the first line that holds the last name of the path."""
    lines = files.join(refs.select(F.col("source").alias("identifier")).distinct(), "identifier", "left_semi").select(F.col("identifier").alias("source"), F.posexplode(F.split("content", "\n")).alias("at", "text"))
    named = refs.withColumn("last", F.element_at(F.split("path", "::"), -1))
    words = lines.select("source", (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("last"))
    return named.join(words, ["source", "last"], "left").groupBy("source", "path", "kind", "outcome").agg(F.min("line").alias("line"))


def extract_workspace(spark: SparkSession, path: str | None = None, include_dev: bool = False, marker: str = rust.MARKER) -> Extraction:
    """The graph of all members of the workspace at or above ``path``, and what could not be resolved."""
    root = workspace.root_of(path)
    found = cut(workspace.manifests(spark, root))
    packages = cut(workspace.members(found))
    owned = workspace.owned_files(rust.whole_files(spark, root, "*.rs"), found, packages)
    roots = workspace.targets(owned, packages)
    files = cut(workspace.production_files(owned, roots, include_dev).select("identifier", "content"))
    library = F.col("kind").isin("lib", "proc-macro")
    home = F.concat("package", F.lit("#"), F.when(library, F.lit("lib")).otherwise(F.concat("kind", F.lit("-"), "name")))
    roots = cut(roots.join(files.select("identifier"), "identifier", "left_semi").withColumn("home", home))
    scope = F.when(F.col("kind") == "custom-build", "build").when(F.col("kind").isin(*workspace.DEV_KINDS), "development").otherwise("normal")
    tree, notes = modules.module_tree(files, roots.select(F.col("home").alias("module"), "identifier"))
    tree = cut(tree)
    order = F.struct((~_first("module").endswith("#lib")).alias("late"), F.length("module").alias("n"), "module")
    named = cut(tree.filter("not inline").groupBy("identifier").agg(F.min_by("module", order).alias("module")))
    own = packages.select(F.col("folder").alias("owner"), F.col("package").alias("name"), F.lit("normal").alias("scope"), F.col("package").alias("crate"), F.col("package").alias("member"))
    names = workspace.visible(packages).unionByName(own)
    refs = cut(rust.references(files, marker, named))
    solved = cut(resolve(refs, rust.bindings(files, named), tree, roots.select("home", "owner", scope.alias("scope")), names))
    left = solved.filter("outcome in ('unknown', 'ambiguous') and kind <> 'mod'")
    lost = _first_lines(files, left).select(F.col("source").alias("identifier"), "line", F.col("outcome").alias("kind"), F.col("path").alias("subject"), F.array().cast("array<string>").alias("candidates"))
    unread = found.filter("error is not null").select(F.col("folder").alias("identifier"), F.lit(None).cast("int").alias("line"), F.lit("unreadable_manifest").alias("kind"), F.lit(None).cast("string").alias("subject"), F.array().cast("array<string>").alias("candidates"))
    return Extraction(E.graph(solved, files.select("identifier")), notes.unionByName(lost).unionByName(unread).distinct())
