"""Names resolved by the longest prefix that an index knows, with the number of candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_prefix(refs: DataFrame, index: DataFrame, keys: list[str], path: str = "path", separator: str = "::", where: Column | None = None) -> DataFrame:
    """(*keys, prefix, candidates, target) of the rows of ``refs`` that have a prefix in ``index`` (prefix, target).

    ``prefix`` is the longest one known; ``candidates`` counts its distinct targets, and
    ``target`` is set if there is exactly one.  ``where`` may refuse hits, by the columns
    of ``refs`` and ``prefix``.  Several rows of ``refs`` with equal keys are ways to try one reference.
    """
    parts = F.split(path, re.escape(separator), -1)
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), separator).alias("prefix")))
    tried = refs.withColumn("tried", F.explode(every)).select("*", "tried.n", "tried.prefix").drop("tried")
    hits = tried.join(index.select("prefix", "target"), "prefix")
    hits = hits if where is None else hits.filter(where)
    found = hits.groupBy(*keys, "n").agg(F.count_distinct("target").alias("candidates"), F.min("target").alias("target"), F.min("prefix").alias("prefix"))
    best = found.groupBy(*keys).agg(F.max_by(F.struct("prefix", "candidates", "target"), "n").alias("best"))  # one row for each n
    return best.select(*keys, "best.prefix", "best.candidates", F.when(F.col("best.candidates") == 1, F.col("best.target")).alias("target"))


def nearest_ancestor(paths: DataFrame, folders: DataFrame, path: str = "identifier", folder: str = "folder") -> DataFrame:
    """(path, folder): the longest of ``folders`` that a path lies in; the empty text is the folder of all.

    A path is spelled out into its ancestors, one row for each level, and meets the
    folders by an equi-join; paths outside all folders have no row.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias(folder)))
    tried = paths.select(path).distinct().select(path, F.explode(above).alias("up")).select(path, "up.*")
    hits = tried.join(folders.select(folder).distinct(), folder)
    return hits.groupBy(path).agg(F.max_by(folder, "n").alias(folder))
