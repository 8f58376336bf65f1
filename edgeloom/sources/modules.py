"""The module tree of a workspace: ``mod`` declarations walked from the targets' root files.

Declarations are found by a fold over the tokens of a file (braces, line ends, ``mod``
with its ``#[path]``), which knows the inline modules around each of them.  The walk is a loop
of joins: a round takes the files reached last, composes the places where their outlined
modules may lie, and joins these with the files there are; a package's depth is its
number of rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import tokens
from edgeloom.plans.lineage import cut
from edgeloom.sources.workspace import below, plain_path

#: A path attribute with the declaration it belongs to, a declaration without one, braces.
_DECLARED = r"#\s*\[\s*path\s*=\s*\"[^\"\n]*\"\s*\](?:[^;{}\"/]*?)\bmod\s+\w+\s*[;{]|\bmod\s+\w+\s*[;{]|[{}]"
_NAME = r"\bmod\s+(\w+)\s*[;{]$"
_LITERAL = r"^#\s*\[\s*path\s*=\s*\"([^\"\n]*)\""
_STATE = "struct<kind:int,level:int,prev:string,depth:int,line:int,open:array<struct<depth:int,name:string,folder:string,own:boolean>>,found:array<struct<name:string,path:string,line:int,inside:string,folder:string,own:boolean,inline:boolean>>>"


def declarations(files: DataFrame) -> DataFrame:
    """(identifier, name, path, line, inside, folder, own, inline): every ``mod`` in code, with the inline modules around it.

    ``folder`` is where those lead, ``own`` says that it starts at the file's own folder
    because one of them has a path; ``path`` is the literal of ``#[path]`` or null.
    """
    start = F.expr(f"cast(named_struct('kind', 0, 'level', 0, 'prev', '', 'depth', 0, 'line', 1, 'open', array(), 'found', array()) as {_STATE})")

    def step(state: Column, token: Column) -> Column:
        code = state["kind"] == tokens.CODE
        said = F.when(code, F.regexp_extract(token, _NAME, 1)).otherwise("")
        opens, closes = code & token.endswith("{"), code & (token == "}")
        line = state["line"] + F.regexp_count(token, F.lit("\n"))
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        path = F.when(token.rlike(_LITERAL), F.regexp_extract(token, _LITERAL, 1))
        inside = F.array_join(F.transform(state["open"], lambda o: o["name"]), "::")
        last = F.get(state["open"], F.size(state["open"]) - 1)
        folder, own = F.coalesce(last["folder"], F.lit("")), F.coalesce(last["own"], F.lit(False))
        item = F.struct(said.alias("name"), path.alias("path"), line.alias("line"), inside.alias("inside"), folder.alias("folder"), own.alias("own"), opens.alias("inline"))
        entry = F.struct(depth.alias("depth"), said.alias("name"), F.coalesce(path, plain_path(F.concat(folder, F.lit("/"), said))).alias("folder"), (own | path.isNotNull()).alias("own"))
        still = F.when(closes, F.filter(state["open"], lambda o: o["depth"] <= depth)).otherwise(state["open"])
        now = F.when((said != "") & opens, F.concat(still, F.array(entry))).otherwise(still)
        found = F.when(said != "", F.concat(state["found"], F.array(item))).otherwise(state["found"])
        kind, level, prev = tokens.after(state["kind"], state["level"], state["prev"], token)
        return F.struct(kind.alias("kind"), level.alias("level"), prev.alias("prev"), depth.alias("depth"), line.alias("line"), now.alias("open"), found.alias("found")).cast(_STATE)

    found = F.aggregate(tokens.tokens("content", _DECLARED), start, step, lambda state: state["found"])
    return files.select("identifier", F.explode(found).alias("d")).select("identifier", "d.*")


def _folder(path: str) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def _own_folder(path: str) -> Column:
    """Where the modules lie that a file declares: its own folder for ``mod.rs``, else one of its name."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.when(F.regexp_extract(path, r"([^/]*)$", 1) == "mod.rs", _folder(path)).otherwise(below(_folder(path), stem))


def module_tree(files: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((module, identifier, inline), diagnostics (identifier, line, kind, subject, candidates)).

    ``files``: identifier, content; ``roots``: module (the name of a target's root) and
    identifier.  An outlined module without a file is *missing_module*, one with two
    *ambiguous_module*, one whose file is being walked already *module_cycle*; none is followed.
    """
    said = cut(declarations(files))
    there = files.select(F.col("identifier").alias("candidate"))
    frontier = cut(roots.select("module", "identifier", _folder("identifier").alias("folder_of"), F.array("identifier").alias("walked")))
    reached, notes = [frontier.select("module", "identifier", F.lit(False).alias("inline"))], []
    while not frontier.isEmpty():
        at = frontier.join(said, "identifier").withColumn("child", F.concat_ws("::", "module", F.when(F.col("inside") != "", F.col("inside")), "name"))
        reached.append(at.filter("inline").select(F.col("child").alias("module"), "identifier", F.lit(True).alias("inline")))
        here = below(F.when(F.col("own"), _folder("identifier")).otherwise(F.col("folder_of")), F.col("folder"))
        beside = F.when(F.col("inside") != "", here).otherwise(_folder("identifier"))
        usual = F.array(below(here, F.concat("name", F.lit(".rs"))), below(here, F.concat("name", F.lit("/mod.rs"))))
        out = cut(at.filter("not inline").withColumn("candidates", F.when(F.col("path").isNotNull(), F.array(below(beside, F.col("path")))).otherwise(usual)))
        keys = ["child", "identifier", "line", "name"]
        hits = out.select(*keys, "walked", F.explode("candidates").alias("candidate")).join(there, "candidate")
        found = cut(hits.groupBy(*keys).agg(F.array_sort(F.collect_set("candidate")).alias("candidates"), F.min("walked").alias("walked")))  # two at most
        file = F.get("candidates", F.lit(0))
        one = found.filter(F.size("candidates") == 1)
        note = lambda rows, kind: rows.select("identifier", "line", F.lit(kind).alias("kind"), F.col("name").alias("subject"), "candidates")
        notes.append(note(out.join(found, keys, "left_anti"), "missing_module"))
        notes.append(note(found.filter(F.size("candidates") > 1), "ambiguous_module"))
        notes.append(note(one.filter(F.array_contains("walked", file)), "module_cycle"))
        after = one.filter(~F.array_contains("walked", file)).select(F.col("child").alias("module"), file.alias("identifier"), "walked")
        frontier = cut(after.select("module", "identifier", _own_folder("identifier").alias("folder_of"), F.concat("walked", F.array("identifier")).alias("walked")))
        reached.append(frontier.select("module", "identifier", F.lit(False).alias("inline")))
    tree = reduce(DataFrame.unionByName, reached).distinct()
    if not notes:
        return tree, said.limit(0).select("identifier", "line", F.lit("").alias("kind"), F.col("name").alias("subject"), F.array("name").alias("candidates"))
    return tree, reduce(DataFrame.unionByName, notes).distinct()
