"""Component diagrams in PlantUML text as two relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import UserError

_ARROW = r"^\[([^\]]+)\]\s*--?>\s*\[([^\]]+)\]$"
_COMPONENT = r"^component\s+\[([^\]]+)\]$"


def lines(text: DataFrame, column: str = "value") -> DataFrame:
    """(line, value): trimmed lines of a diagram without comments, directives and blanks."""
    rows = text.select(F.posexplode(F.split(column, "\n", -1)).alias("line", "value")).select((F.col("line") + 1).alias("line"), F.trim(F.regexp_replace("value", "\r$", "")).alias("value"))
    return rows.filter(~F.col("value").rlike(r"^($|'|//|@)"))


def dependencies(text: DataFrame, column: str = "value") -> DataFrame:
    """(line, source, target) of the arrows."""
    return lines(text, column).filter(F.col("value").rlike(_ARROW)).select("line", F.trim(F.regexp_extract("value", _ARROW, 1)).alias("source"), F.trim(F.regexp_extract("value", _ARROW, 2)).alias("target"))


def components(text: DataFrame, column: str = "value") -> DataFrame:
    """(component, line) of all components, declared or drawn, with the line of first sight."""
    declared = lines(text, column).filter(F.col("value").rlike(_COMPONENT)).select("line", F.trim(F.regexp_extract("value", _COMPONENT, 1)).alias("component"))
    drawn = dependencies(text, column)
    rows = declared.unionByName(drawn.select("line", F.col("source").alias("component"))).unionByName(drawn.select("line", F.col("target").alias("component")))
    return rows.groupBy("component").agg(F.min("line").alias("line"))


def parse(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Components and arrows of a diagram that is part of a rule, in order of appearance."""
    names: dict[str, None] = {}
    arrows: dict[tuple[str, str], None] = {}
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith(("'", "//", "@")):
            continue
        if m := re.match(_ARROW, line):
            pair = (m[1].strip(), m[2].strip())
            names |= dict.fromkeys(pair)
            arrows[pair] = None
        elif m := re.match(_COMPONENT, line):
            names[m[1].strip()] = None
        elif line.startswith(("component", "[")):
            raise UserError(f"line {number}: {line!r} is neither a component nor a dependency")
    return [*names], [*arrows]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)
