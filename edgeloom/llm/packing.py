"""Operator 2: packing documents into windows by minimum bin slack.

Texts are tokenised on the executors and cut at every ``window`` tokens; a last
piece that is shorter keeps its length.  Which lengths share a window is decided
on the counts of the lengths alone (at most ``window`` numbers, however many
documents there are): the longest length left opens a window, a bitset subset-sum
dynamic programme over the remaining multiset finds the reachable sum closest to
the capacity, backtracking yields how often each length is taken, and the pattern
is used as often as the counts allow.

A piece finds its place by its rank among the pieces of its length.  Ranks come
from counts by (length, salt) and a row number within such a cell, so a length
that many documents share is spread over cells of a few thousand rows; counts are
summed up over stretches of ``CELLS`` cells, then over the stretches.  The plan
is a table of rank ranges, bounded by the window and not by the input, and is
broadcast.

Token ids are those of the byte-level vocabulary file; it is read in its rank
form, which gives the same ids at several times the speed (a test compares both).

Defined cases: null or empty text is the single id 0; repeated rows are documents
of their own; a text of any length is cut, never shortened; an empty table gives
an empty table; other columns play no part.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from edgeloom.llm.runtime import cut, ship, stored, table

WINDOW = 1024
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Mean number of pieces in a cell of (length, salt) if all had one length.
CELL_ROWS = 2000
#: Cells of a length whose counts are summed in one task.
CELLS = 4096
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


@lru_cache(maxsize=2)
def encoding(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(coder: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """The ids of a text and the end id, as little-endian 32-bit numbers."""
    ids = coder.encode(text, allowed_special="all", disallowed_special=()) if text else []
    ids.append(END_ID)
    return np.array(ids, "<u4")


def _coder(ranks_path: str | None) -> tiktoken.Encoding:
    """Of the file at a path; without one, of the tokenizer package where the task runs."""
    return encoding(ranks_path or public_tokenizers.path(RANKS_FILE))


def _cut_texts(ranks_path: str | None, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(coder, text.as_py())
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _PIECE]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)

    return run


def cut_pieces(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of all pieces."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _cut_texts(ranks_path, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


# ---- the plan --------------------------------------------------------------------


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum of at most ``room``.

    Bit s of ``reach`` says that sum s can be made; ``steps`` keeps the bitset
    before each bundle (a length taken 1, 2, 4 .. times), for backtracking.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            steps.append((reach, length, take))
            reach |= (reach << (take * length)) & mask
            left, bundle = left - take, bundle * 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, Counter()
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            out[length] += take
            total -= take * length
    return dict(out)


def bin_slack_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (how often each length stands in a window) and how many windows use each."""
    left = {x: n for x, n in counts.items() if n > 0}
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = Counter({longest: 1})
        pattern.update(fill(left, window - longest))
        left[longest] += 1
        times = min(left[x] // c for x, c in pattern.items())
        for x, c in pattern.items():
            left[x] -= c * times
            if not left[x]:
                del left[x]
        plan.append((dict(pattern), times))
    return plan


def rank_ranges(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces a window, first sequence, first offset)."""
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            per = pattern[length]
            out.append((length, used[length], used[length] + per * times, per, sequence, offset))
            used[length] += per * times
            offset += per * length
        sequence += times
    return out


_RANGES = T.StructType([T.StructField(n, T.LongType(), False) for n in ("of", "lo", "hi", "per", "sequence", "at")])


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read more than once."""
    spark = pieces.sparkSession
    total = pieces.count()
    salts = max(1, -(-total // CELL_ROWS))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    cells = cut(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    ranges = spark.createDataFrame(rank_ranges(bin_slack_plan(counts, window)), _RANGES)
    cells = cells.withColumn("stretch", F.floor(F.col("salt") / CELLS))
    ahead = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = cut(cells.groupBy("length", "stretch").agg(F.sum("n").alias("n"))).select("length", "stretch", ahead(["length"], "stretch").alias("base"))
    inner = cells.select("length", "stretch", "salt", ahead(["length", "stretch"], "salt").alias("inner"))
    cells = inner.join(upto, ["length", "stretch"]).select("length", "salt", (F.col("base") + F.col("inner")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("row", F.row_number().over(order)).join(cells, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("row") - 1)
    hit = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(ranges), hit)
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """Where every piece of every document lies: one row per piece."""
    return place(stored(cut_pieces(docs, window, ranks_path), "pieces"), window)


def packed_sequences(docs: DataFrame, placed: DataFrame, window: int = WINDOW, ranks_path: str | None = None, pad_id: int = END_ID) -> DataFrame:
    """The sequences themselves: (sequence_id, ids, n_tokens).

    The texts are tokenised once more, next to their places, rather than kept as
    ids all along.  Sequences are padded to ``window`` unless their length is a
    power of two.  Needs unique ``doc_id``.
    """
    ship(docs.sparkSession)
    places = placed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))
    joined = docs.select("doc_id", "text").join(places, "doc_id").select("text", "places")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path)
        for batch in batches:
            sequence, offset, parts = [], [], []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(coder, text)
                for p in places:
                    sequence.append(p["sequence_id"])
                    offset.append(p["offset"])
                    parts.append(ids[p["start"] : p["start"] + p["length"]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], ["sequence_id", "offset", "part"])

    parts = joined.mapInArrow(encode, "sequence_id long, offset long, part array<int>")
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["part"]))
    out = whole.select("sequence_id", ids.alias("ids")).withColumn("n_tokens", F.size("ids"))
    full = (F.bit_count("n_tokens") == 1) | (F.col("n_tokens") >= window)
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.col("n_tokens")))
    return out.withColumn("ids", F.when(full, F.col("ids")).otherwise(padded))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
