"""Operator 10: line dedup on levelled sorted runs (DataFrame functions only).

A *run* is a bucketed and sorted table of line keys: 128 hashed bits, the number of
documents of its batches that hold the line, and ``last_doc``, the document that keeps it.
Batches come in descending ranges of ``doc_id``.  A new batch is aggregated to such rows
and merge-anti-joined with the runs that exist (bucketed alike, so only the batch is
shuffled): keys that no run holds are fresh, and the largest ``doc_id`` of the batch keeps
their line, which no later batch can change; of keys that a run holds, only the count is
added.  The batch then becomes a run of level 0.  As soon as a level holds ``fanout`` runs
they are merged into one run of the next level, as in a log-structured merge tree, so a
key is looked up in a logarithmic number of runs.  Which lines go is read from the merged
runs: a key with enough documents loses all lines but those of the document that the
anti-join let keep it.  Runs are dropped once that is known.

Lines that many documents share are the hot keys here.  Before every shuffle on
a line's key the rows are pre-aggregated, and where single lines must meet their
verdict, keys that hold at least 1/4096 of all lines (hence at most 4096 keys)
are broadcast while all others are joined by a shuffle.

Defined cases: null or empty text is one empty line; a null ``doc_id`` is never
a line's last holder and its document keeps all its lines; rows that share a
``doc_id`` are one document when holders are counted, whether their texts are equal or
not, each row loses its own lines, and all rows with the largest ``doc_id`` keep the line
(rows of one ``doc_id`` are in one batch); an empty table gives an empty table; further
columns are left alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.runtime import SPACE, cut, lower_ascii, shared_dir, stored, table

MIN_KEY_CHARS = 20
MIN_DOCUMENTS = 3
#: At most this many keys can hold 1/HOT_KEYS of all lines each.
HOT_KEYS = 4096


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.regexp_replace(line, rf"\A{SPACE}+|{SPACE}+\z", ""))  # $ would also stand before a last U+2028


def keyed_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """One row per line whose key is long enough: (doc_id, body, h1, h2, pos, first).

    ``body`` hashes the whole text, so rows that share a ``doc_id`` do not mix;
    ``first`` marks a key's first line within its document.  The lines of a
    document are sorted by key inside the row, which finds repeats without a
    shuffle and in n log n steps.
    """
    keys = F.transform(split_lines(F.col("text")), lambda line, i: F.struct(line_key(line).alias("k"), i.alias("pos")))
    hashed = F.transform(
        F.filter(keys, lambda e: F.char_length(e["k"]) >= min_chars),
        lambda e: F.struct(F.xxhash64(e["k"]).alias("h1"), F.xxhash64(F.lit("second"), e["k"]).alias("h2"), e["pos"].alias("pos")),
    )
    per_doc = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("body"), F.array_sort(hashed).alias("ls"))
    per_doc = per_doc.filter(F.size("ls") > 0)
    marked = F.transform(
        "ls",
        lambda e, i: F.struct(
            e["h1"].alias("h1"), e["h2"].alias("h2"), e["pos"].alias("pos"),
            ((i == 0) | (F.get("ls", i - 1)["h1"] != e["h1"]) | (F.get("ls", i - 1)["h2"] != e["h2"])).alias("first"),
        ),
    )
    return per_doc.select("doc_id", "body", F.explode(marked).alias("l")).select("doc_id", "body", "l.*")


def _merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


@dataclass
class LineRuns:
    """The levelled runs. ``levels[k]`` lists the tables of level k, oldest first."""

    spark: SparkSession
    buckets: int
    fanout: int = 3
    levels: list[list[str]] = field(default_factory=list)

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"  # rows come dealt by (h1, h2), so a bucket is one file
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def read(self, names: list[str]) -> DataFrame:
        """All entries of these runs; a key can stand in several.

        Their folders are read as one plain scan: a union of bucketed tables would
        be taken for a bucketed table, and keys would not meet.
        """
        return self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*(f"{shared_dir(self.spark)}/{n}" for n in names))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The merge-anti-join: rows of ``lines`` whose key is in no run yet."""
        for name in self.names():
            lines = lines.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, lines: DataFrame, shared_ids: DataFrame | None = None) -> None:
        """Add a batch of keyed lines as a run, then compact full levels.

        A key that a run holds already keeps the ``last_doc`` it has there: the anti-join
        is a left join that marks what is held, so that the counts of held keys are kept too.
        ``shared_ids`` (doc_id) lists ids of several rows; those rows count as one document.
        """
        first = lines.filter("first").select("doc_id", "h1", "h2")
        if shared_ids is not None:
            again = first.join(shared_ids, "doc_id", "left_semi").distinct()
            first = first.join(shared_ids, "doc_id", "left_anti").unionByName(again)
        rows = first.select("h1", "h2", F.lit(1).cast("bigint").alias("n_docs"), F.col("doc_id").alias("last_doc"))
        batch = _merge(rows)
        for i, name in enumerate(self.names()):
            batch = batch.join(self.spark.table(name).select("h1", "h2", F.lit(True).alias(f"held{i}")), ["h1", "h2"], "left")
        held = F.coalesce(*(F.col(f"held{i}") for i in range(len(self.names()))), F.lit(False))
        self._write(batch.select("h1", "h2", "n_docs", F.when(~held, F.col("last_doc")).alias("last_doc")), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._write(_merge(self.read(old)), level + 1)
        for name in old:
            self.drop(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def distinct(self) -> int:
        """The number of distinct keys: the entries that were fresh, without merging the runs."""
        return self.read(self.names()).filter("last_doc is not null").count()

    def close(self) -> None:
        """Drop all runs."""
        for name in self.names():
            self.drop(name)
        self.levels = []

    def counts(self) -> DataFrame:
        """One row per key over all runs (h1, h2, n_docs, last_doc)."""
        return _merge(self.read(self.names()))


def repeated_lines(lines: DataFrame, runs: LineRuns, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The lines to drop, as (doc_id, body, pos); the runs are closed."""
    frequent = cut(runs.counts().filter(F.col("n_docs") >= min_documents))
    runs.close()
    total = frequent.agg(F.sum("n_docs")).first()[0] or 0
    is_hot = F.col("n_docs") * HOT_KEYS >= total  # at most HOT_KEYS rows
    hot = F.broadcast(frequent.filter(is_hot).select("h1", "h2", "last_doc"))
    rare = frequent.filter(~is_hot).select("h1", "h2", "last_doc")
    late = F.col("doc_id") != F.col("last_doc")
    slim = lines.select("doc_id", "body", "h1", "h2", "pos")
    of_hot = slim.join(hot, ["h1", "h2"]).filter(late)
    of_rare = slim.join(hot, ["h1", "h2"], "left_anti").join(rare, ["h1", "h2"]).filter(late)
    return of_hot.unionByName(of_rare).select("doc_id", "body", "pos")


def dedup_lines(docs: DataFrame, batches: int = 4, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with two more columns: ``kept_lines`` (array) and ``n_dropped``.

    ``batches`` is the number of parts in which the documents reach the runs, by
    descending ``doc_id``; a crawl that comes in deliveries, the newest first, would
    call :meth:`LineRuns.add` for each.
    """
    spark = docs.sparkSession
    share = [1 - b / batches for b in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), 1000)).first()[0] if share else []
    batch = sum((F.when(F.col("doc_id") < b, 1).otherwise(0) for b in bounds or []), F.lit(0))
    lines = stored(keyed_lines(docs, min_chars).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared_ids = cut(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    shared_ids = None if shared_ids.isEmpty() else shared_ids
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b), shared_ids)
    drops = repeated_lines(lines, runs, min_documents).groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    kept_columns = [c for c in docs.columns if c not in {"kept_lines", "n_dropped"}]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept_columns)).alias("row"))  # so no name can clash
    drops = drops.withColumnsRenamed({"doc_id": "of_doc", "body": "of_body"})
    joined = rows.join(drops, (F.col("row.doc_id") == F.col("of_doc")) & (F.xxhash64("row.text") == F.col("of_body")), "left")
    joined = joined.select("row", "pos", split_lines(F.col("row.text")).alias("ls"), F.when(F.col("pos").isNull(), 0).otherwise(F.size("pos")).alias("n"))

    def stretch(_, i: Column) -> Column:
        """The lines between the dropped lines i-1 and i."""
        start = F.when(i == 0, 0).otherwise(F.get("pos", i - 1) + 1)
        stop = F.when(i == F.col("n"), F.size("ls")).otherwise(F.get("pos", i))
        return F.slice("ls", start + 1, stop - start)

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n")), stretch))
    kept = F.when(F.col("n") == 0, F.col("ls")).otherwise(pieces)
    return joined.select("row.*", kept.alias("kept_lines"), F.col("n").cast("bigint").alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size(split_lines(F.col("text"))).cast("bigint").alias("n_lines"),
        "n_dropped",
        F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line AS line, u.pos AS pos,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) AS u
), often AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.pos, (o.k IS NOT NULL AND l.doc_id <> o.last_doc) AS gone
  FROM lines l LEFT JOIN often o ON l.k = o.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
