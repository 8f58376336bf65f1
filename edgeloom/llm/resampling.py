"""Operator 11: importance resampling towards a target distribution.

*Weights.*  A text's features are its runs of one to three words; each falls into one
of ``BUCKETS`` buckets by CRC-32.  One pass counts the buckets of both tables: a task
hands on at most one row per bucket, so what is summed over the cluster and what reaches
the driver has a fixed size.  A bucket's gain is the scaled logarithm of the two smoothed
shares; a second pass looks gains up in an array (``BUCKETS`` longs, sent with the task)
and sums them over a text.  A text's features come in chunks of ``CHUNK`` words, so
beside the text itself a bounded number of them is held.

*Draw.*  A Gumbel number seeded by ``doc_id`` is added to the weight; the highest scores
are drawn.  The exact k-th key is found by radix selection: the composite key (score
descending, ``doc_id`` ascending) is read as 16-bit digits from the most significant on;
each round counts one digit's values among the rows that share the digits fixed so far
(at most 65,536 counts reach the driver) and fixes the digit of the k-th row.  No sort of
all rows takes place: only drawn rows are range-partitioned, sorted and ranked, their
ranks being the places within a range plus the sizes of the ranges before.

Defined cases: null or empty text, or one without a word, has no features and weight 0; a
null ``doc_id`` gets a weight, but neither score nor rank, and does not count among
the eligible; rows of one ``doc_id`` are documents of their own, and rows that are equal
in score and ``doc_id`` take consecutive ranks, as many of them as the draw has room for;
empty tables give empty tables, an empty target a constant share for all buckets.
Further columns are not read; the result has the columns of ``SCORED`` and ``rank``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.runtime import ship, stored, table

BUCKETS = 10_000
SHARE, MIN_WORDS, SEED = 5, 20, 42  # per cent of the eligible; words that make a row eligible
#: Words of a text whose features are held at a time.
CHUNK = 20_000
DIGIT_BITS = 16
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them), chunk by chunk."""
    words = _WORDS.finditer(text.lower())
    one = two = None  # sums of the last word and of the last two
    while chunk := list(islice(words, CHUNK)):
        sums = []
        for word in chunk:
            word = word[0]
            after = b" " + word
            if two is not None:
                sums.append(crc32(after, two))
            if one is not None:
                two = crc32(after, one)
                sums.append(two)
            one = crc32(word)
            sums.append(one)
        yield len(chunk), np.array(sums, np.int64) % buckets


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.large_binary()):
        yield text.as_py() or b""


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; empty buckets have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                for _, found in feature_buckets(text, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratios of the smoothed shares, rounded down."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = ((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _counted(docs: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for row in bucket_counts(docs, buckets).collect():  # at most one row per bucket
        out[row.bucket] = row.n
    return out


def luck(doc_id: int, seed: int = SEED) -> int:
    """The scaled Gumbel number of a document, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """The columns of ``SCORED`` for each row of ``docs`` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                n_words = n_features = weight = 0
                for n, found in feature_buckets(text, len(gain)):
                    n_words, n_features, weight = n_words + n, n_features + len(found), weight + int(gain[found].sum())
                rows.append((doc_id, n_words, n_features, weight, None if doc_id is None else weight + luck(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, SCORED)


def kth_key(rows: DataFrame, k: int) -> tuple[int, int] | None:
    """(score, doc_id) of the k-th row by score descending and doc_id ascending, by radix selection.

    None if there are fewer than ``k`` rows.  ``rows`` is read once a digit, so it
    should be stored.
    """
    # flipping the sign bit makes longs unsigned; flipping all others of the score makes it descend
    high = {"score": (1 << 63) - 1, "doc_id": -(1 << 63)}
    key = rows.select(*(F.col(c).bitwiseXOR(F.lit(mask)).alias(c) for c, mask in high.items()))
    fixed = {"score": 0, "doc_id": 0}
    for column in fixed:
        for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
            digit = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            counts = sorted(key.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect())
            for value, n in counts:
                if k <= n:
                    break
                k -= n
            else:
                return None
            fixed[column] |= value << shift
            key = key.filter(digit == value)
    signed = {c: ((fixed[c] ^ (high[c] & ((1 << 64) - 1))) + (1 << 63)) % (1 << 64) - (1 << 63) for c in fixed}
    return signed["score"], signed["doc_id"]


def ranked(rows: DataFrame, first: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ..) by score descending, then doc_id; null beyond ``first``.

    Rows that are equal in both keys differ in a drawn number, so they spread over ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("at")]
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # stored, so that the number of a range and the place in it are those of one evaluation
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per range
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row.part, before))
        before += row.n
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rank = rank if first is None else F.when(rank <= first, rank)
    return placed.withColumn("part", part).join(starts, "part").select(*rows.columns, rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``SCORED`` and ``rank`` for each row of ``docs`` (doc_id, text); ``share`` per cent of the eligible rows have a rank.

    ``target`` (text) is the table whose distribution is aimed at.
    """
    gain = gains(_counted(docs, buckets), _counted(target, buckets))
    rows = stored(scored(docs, gain, seed), "scored")
    eligible = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    k = share * rows.filter(eligible).count() // 100
    undrawn = F.lit(None).cast("bigint")
    if not k:
        return rows.withColumn("rank", undrawn)
    score, doc_id = kth_key(rows.filter(eligible).select("score", "doc_id"), k)
    reach = eligible & ((F.col("score") > score) | ((F.col("score") == score) & (F.col("doc_id") <= doc_id)))
    rest = rows.filter(~F.coalesce(reach, F.lit(False))).withColumn("rank", undrawn)
    return ranked(rows.filter(reach), k).unionByName(rest)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
