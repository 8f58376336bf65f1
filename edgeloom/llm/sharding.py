"""Operator 1: sharding by extendible hashing.

The directory is indexed by prefixes of a record's 60-bit hash; a bucket beyond
the byte limit is split on one more bit, and only such a bucket.  Its end state
does not depend on the order of insertion: a bucket is a prefix whose bytes fit
while those of the prefix one bit shorter do not.  So the directory is built from
byte sums of short prefixes (about ``FINE`` to a shard), summed upwards by one
aggregation; prefixes that do not fit even at that depth are looked at on more
bits, alone.  The directory stays a DataFrame and rows find their bucket by a join
on the short prefix, which is spread evenly by the hash.

Records with equal keys have equal bits.  Where such records exceed the limit, the
60 bits of a second hash that includes the row's place continue the first, so a
key that holds a third of all rows is split as well.

Defined cases: null text has 0 bytes; a null key is hashed as a key of its own; a
record larger than the limit is a shard by itself and stays out of the directory
(depth 120); an empty table gives an empty table; further columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.runtime import cut, stored, table

SHARD_BYTES = 1 << 20
BITS = 60
#: Prefixes summed for each shard's worth of bytes.
FINE = 8
STEP = 8


def prefix_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null key")).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(h: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int, total: int) -> tuple[DataFrame, DataFrame | None]:
    """Buckets (cell_depth, cell, depth, prefix, shard_bytes) by cell, and hashes that cannot be split.

    ``rows`` holds h and bytes.  A cell is a prefix of ``cell_depth`` bits inside the bucket.
    """
    fine = min(BITS, max(0, math.ceil(math.log2(max(1.0, FINE * total / limit)))))
    base, found = 0, None
    while True:
        cells = cut(rows.groupBy(_prefix(F.col("h"), fine).alias("cell")).agg(F.sum("bytes").alias("n")))
        up = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(fine))))
        up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(fine) - F.col("depth")))
        sums = up.groupBy("depth", "prefix").agg(F.sum("n").alias("shard_bytes"))
        # depth 0 has no parent; the prefixes at ``base`` > 0 are known not to fit
        over = sums.filter(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = sums.filter(F.col("shard_bytes") <= limit).withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        split = fits.join(over, ["depth", "parent"], "left_semi")
        whole = fits.filter("depth = 0")
        buckets = split.unionByName(whole).select("depth", "prefix", "shard_bytes")
        hit = up.select("cell", "depth", "prefix").join(buckets, ["depth", "prefix"])
        hit = cut(hit.select(F.lit(fine).alias("cell_depth"), "cell", "depth", "prefix", "shard_bytes"))
        found = hit if found is None else found.unionByName(hit)
        left = cells.filter(F.col("n") > limit).select("cell")
        if left.isEmpty():
            return found, None
        rows = cut(rows.withColumn("cell", _prefix(F.col("h"), fine)).join(left, "cell", "left_semi").drop("cell"))
        if fine == BITS:
            return found, left
        base, fine = fine, min(BITS, fine + STEP)


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """``df`` with shard_depth, shard_prefix, shard_tail and shard_bytes.

    ``shard_tail`` tells shards of one key apart: bits of the second hash, the place of a
    record beyond the limit whose key has several such records, else 0.
    """
    outputs = {"bytes", "shard_depth", "shard_prefix", "shard_bytes", "shard_tail"}
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in outputs)).alias("row")  # so no name can clash
    all_rows = df.select(whole, F.monotonically_increasing_id().alias("place"), prefix_hash(F.col(key)).alias("h"), F.coalesce(size, F.lit(0)).cast("bigint").alias("bytes"))
    rows = stored(all_rows, "records")
    single, small = rows.filter(F.col("bytes") > limit), rows.filter(F.col("bytes") <= limit)
    total = small.agg(F.sum("bytes")).first()[0] or 0
    found, stuck = directory(small.select("h", "bytes"), limit, total)
    out = _place(small, found).withColumn("shard_tail", F.lit(0).cast("bigint"))
    if stuck is not None:
        # one key beyond the limit: go on with the bits of a hash of the row's place
        more = small.join(stuck.withColumnRenamed("cell", "h"), "h", "left_semi").withColumnRenamed("h", "h1")
        more = cut(more.withColumn("h", F.pmod(F.xxhash64("h1", "place"), F.lit(1 << BITS))))
        parts, _ = directory(more.select("h", "bytes"), limit, more.agg(F.sum("bytes")).first()[0])
        tail = _place(more, parts).withColumnsRenamed({"shard_prefix": "shard_tail", "h": "h2"})
        tail = tail.withColumn("shard_depth", F.col("shard_depth") + BITS).withColumn("shard_prefix", F.col("h1")).drop("h2").withColumnRenamed("h1", "h")
        # the tail's buckets hold rows of all stuck keys: a shard is a bucket and a key
        each = tail.groupBy("h", "shard_depth", "shard_tail").agg(F.sum("bytes").alias("shard_bytes"))
        out = out.unionByName(tail.drop("shard_bytes").join(each, ["h", "shard_depth", "shard_tail"]))
    twins = single.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", F.lit(True).alias("twin"))
    tail = F.when(F.col("twin"), F.col("place")).otherwise(F.lit(0).cast("bigint"))
    alone = single.join(twins, "h", "left").withColumns({"shard_depth": F.lit(2 * BITS), "shard_prefix": F.col("h"), "shard_bytes": F.col("bytes"), "shard_tail": tail}).drop("twin")
    return out.unionByName(alone).select("row.*", "bytes", "shard_depth", "shard_prefix", "shard_tail", "shard_bytes")


def _place(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows joined to their bucket on their cell; each refinement of the directory has its own cell depth."""
    depths = sorted(r[0] for r in buckets.select("cell_depth").distinct().collect())  # at most 60
    out = None
    for d in depths:
        mine = buckets.filter(F.col("cell_depth") == d).select("cell", F.col("depth").cast("int").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), "shard_bytes")
        part = rows.withColumn("cell", _prefix(F.col("h"), d)).join(mine, "cell").drop("cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = {"shard_depth": F.lit(0), "shard_prefix": F.lit(0).cast("bigint"), "shard_bytes": F.lit(0).cast("bigint")}
        return rows.limit(0).withColumns(empty)
    return out


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard below ``path``; every shard is written by one task, as it fits the limit."""
    name = F.concat_ws("-", "shard_depth", "shard_prefix", "shard_tail")
    dealt = sharded.withColumn("shard", name).repartition(int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    dealt.sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    out = extendible_shards(docs, "doc_id", F.col("size"))
    return out.select("doc_id", "bytes", F.col("shard_depth").cast("bigint").alias("shard_depth"), "shard_prefix", "shard_tail", "shard_bytes")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), p AS (
  SELECT doc_id, bytes, u.depth AS depth, h >> (60 - u.depth)::BIGINT AS prefix
  FROM d, (SELECT unnest(range(0, 41)) AS depth) AS u WHERE bytes <= 1048576
), s AS (
  SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes FROM p GROUP BY ALL
)
SELECT p.doc_id, p.bytes, p.depth::BIGINT AS shard_depth, p.prefix AS shard_prefix, 0::BIGINT AS shard_tail, s.shard_bytes
FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix
LEFT JOIN s AS up ON up.depth = s.depth - 1 AND up.prefix = s.prefix >> 1
WHERE s.shard_bytes <= 1048576 AND (s.depth = 0 OR up.shard_bytes > 1048576)
UNION ALL
SELECT doc_id, bytes, 120, h, 0, bytes FROM d WHERE bytes > 1048576
"""
