"""Operator 12: passages that an earlier document holds already, found with an FM-index per shard.

A window is ``WINDOW`` consecutive words.  All words of a window go whose word sequence
also starts in a document of a smaller id.

1. *Segments.*  The least hash of the runs of ``GRAM`` words inside a window is its anchor.
   Equal windows have equal anchors, so consecutive windows of one anchor form a segment
   that is routed by that anchor; all that a window can equal is routed alike, and
   no document has to be streamed past all shards.  Segments are listed as hashes and
   places (some five for 100 words), not as texts.
2. *Candidates.*  Copies of a segment collapse to their least document by pre-aggregation;
   anchors that only one document holds are dropped, as nothing can match there.
3. *Index.*  The words of the segments left are fetched from the document that holds them
   first.  A shard is a range of anchors in a sorted partition, of ``SHARD_WORDS`` words
   or a little more; its FM-index is built, and every segment is streamed through it by
   backward search, which gives, for each window, the least document that holds it.
4. *Removal.*  Occurrences of a segment look up its windows; those whose least document
   is smaller go.

An anchor of more than ``CROWDED`` different segments (a passage that stands in very many
contexts) would make one shard as large as the table.  Its windows are settled exactly
without an index: equal 128-bit hashes of the whole window, aggregated by key.

Words, anchors and segments are compared by 64-bit hashes in steps 1 and 2 (a segment by
128 bits, its anchor included); inside a shard the words themselves are compared.

Defined cases: null or empty text has no words; a document without ``doc_id`` keeps
all its words and takes none from others; rows of one ``doc_id`` do not remove each
other's words; texts shorter than a window stay; an empty table gives an empty
table; further columns are handed on, but for those named as the new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from edgeloom.llm import shingles
from edgeloom.llm.fm_index import FMIndex
from edgeloom.llm.runtime import ship, stored, table

WINDOW = 50
GRAM = 12
#: Words of a shard's index; a task holds one shard at a time.
SHARD_WORDS = 400_000
#: Different segments of an anchor beyond which its windows are settled by their hashes.
CROWDED = 2_000
#: Windows of a segment at most; longer ones (a repeated word has one anchor) are cut.
RUN = 256

_U = np.uint64
_CASED = shingles.mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first bytes, ends of all words; index of each text's first word, and the number of words)."""
    hashes, begins, ends = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, stop in shingles.stretches(data):
        piece = data[at:stop]
        inside = shingles._IS_WORD[piece]
        edge = np.zeros(len(piece) + 1, bool)
        edge[shingles.inside_offsets(offsets, at, stop)] = True
        begin = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
        end = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
        up, down = shingles._power(len(piece) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, _U), np.cumsum(_CASED[piece] * up[: len(piece)], dtype=_U)))
            hashes.append(shingles.mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U)))
        begins.append(begin + at)
        ends.append(end + at)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets)


class RunHash:
    """Hashes of runs of words from sums of prefixes."""

    def __init__(self, words: np.ndarray) -> None:
        up, self.down = shingles._power(len(words) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, _U), np.cumsum(words * up[: len(words)], dtype=_U)))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return shingles.mix((self.total[start + length] - self.total[start]) * self.down[start] + np.asarray(length).astype(_U))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first word within it, windows, anchor, hash) of all segments of these texts."""
    lengths = np.diff(first)
    n_windows = np.maximum(lengths - window + 1, 0)
    if not n_windows.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U), none.astype(_U)
    gram = min(gram, window)
    runs = RunHash(words)
    anchors = _least(runs.of(np.arange(len(words) - gram + 1), gram), window - gram + 1)
    text = np.repeat(np.arange(len(lengths)), n_windows)
    of_text = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)  # number of a window within its text
    at = first[text] + of_text
    anchor = anchors[at]
    new = (of_text == 0) | np.concatenate(([True], anchor[1:] != anchor[:-1]))
    start = np.flatnonzero(new)
    since = np.arange(len(text)) - start[np.cumsum(new) - 1]
    start = np.flatnonzero(since % RUN == 0)
    count = np.diff(start, append=len(text))
    return text[start], of_text[start], count, anchor[start], runs.of(at[start], count + window - 1)


def _binary(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).cast(pa.large_binary())


def occurrences(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, body, start, windows, anchor, segment) of all segments of all texts."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("body").to_numpy(zero_copy_only=False)
            for at, data, offsets in shingles.text_slices(_binary(batch, "text")):
                words, _, _, first = words_of(data, offsets)
                text, start, count, anchor, segment = segments(words, first, window)
                columns = [ids[at + text], bodies[at + text], start, count, anchor.view(np.int64), segment.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "body", "start", "windows", "anchor", "segment"])

    ship(docs.sparkSession)
    return _bodies(docs).mapInArrow(listed, "doc_id long, body long, start long, windows long, anchor long, segment long")


def _bodies(docs: DataFrame) -> DataFrame:
    """Rows with an id; ``body`` tells rows of one id and different texts apart."""
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("body"), "text")


def shared_segments(found: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Each segment whose anchor several documents hold, once: where it stands first, and whether its anchor is crowded."""
    place = F.min(F.struct("doc_id", "body", "start", "windows")).alias("place")
    once = found.groupBy("anchor", "segment").agg(place, F.max("doc_id").alias("last"))
    held = once.groupBy("anchor").agg(F.min("place.doc_id").alias("least"), F.max("last").alias("most"), F.count(F.lit(1)).alias("n"))
    held = held.filter("least < most").select("anchor", (F.col("n") > crowded).alias("crowded"))
    return once.join(held, "anchor").select("anchor", "segment", "place.*", "crowded")


_FETCHED = "anchor long, segment long, doc_id long, words binary, at long, h1 long, h2 long"


def fetched(docs: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """The words of segments, read where they stand first; of crowded anchors the hashes of all windows instead."""
    schema = pa.schema([(n, pa.binary() if n == "words" else pa.int64()) for n in _FETCHED.replace(",", "").split()[::2]])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, ids = batch.column("wanted"), batch.column("doc_id").to_pylist()
            for at, data, offsets in shingles.text_slices(_binary(batch, "text")):
                hashes, begin, end, first = words_of(data, offsets)
                one, two = RunHash(hashes), RunHash(shingles.mix(hashes ^ _U(0x9E6C63D0876A9A35)))
                rows: list[tuple] = []
                for i in range(len(offsets) - 1):
                    for w in wanted[at + i].as_py():
                        a, n, key = int(first[i]) + w["start"], w["windows"], (w["anchor"], w["segment"], ids[at + i])
                        if w["crowded"]:
                            starts = np.arange(a, a + n)
                            pairs = zip(one.of(starts, window).view(np.int64).tolist(), two.of(starts, window).view(np.int64).tolist(), strict=True)
                            rows += [(*key, None, k, h1, h2) for k, (h1, h2) in enumerate(pairs)]
                        else:
                            rows.append((*key, _SPACE.sub(b" ", data[begin[a] : end[a + n + window - 2]].tobytes()), None, None, None))
                columns = zip(*rows, strict=True) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    wanted = places.groupBy("doc_id", "body").agg(F.collect_list(F.struct("anchor", "segment", "start", "windows", "crowded")).alias("wanted"))
    return _bodies(docs).join(wanted, ["doc_id", "body"]).select("doc_id", "text", "wanted").mapInArrow(fetch, _FETCHED)


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.Table]:
    """Consecutive rows of whole anchors, of some ``shard_words`` words; a segment that comes again is left out."""
    held: list[pa.RecordBatch] = []
    words, last = 0, None
    for batch in batches:
        anchor, segment = batch.column("anchor").to_numpy(), batch.column("segment").to_numpy()
        fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])))
        if len(batch) and last == (anchor[0], segment[0]):
            fresh[0] = False
        if len(batch):
            last = (anchor[-1], segment[-1])
        batch, anchor = batch.filter(pa.array(fresh[: len(batch)])), anchor[fresh[: len(batch)]]
        size = np.cumsum(pc.count_substring(batch.column("words"), b" ").to_numpy() + 1) if len(batch) else np.zeros(0, np.int64)
        at = done = 0
        edges = np.flatnonzero(np.concatenate(([bool(held) and len(batch) and held[-1].column("anchor")[-1].as_py() != anchor[0]], anchor[1:] != anchor[:-1])))
        for edge in edges.tolist():
            if words + (size[edge - 1] if edge else 0) - done >= shard_words:
                held.append(batch.slice(at, edge - at))
                yield pa.Table.from_batches(held)
                held, words, at, done = [], 0, edge, int(size[edge - 1]) if edge else 0
        if len(batch) > at:
            held.append(batch.slice(at))
            words += int(size[-1]) - done
    if held:
        yield pa.Table.from_batches(held)


def least_documents(words: pa.Array, doc_ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of these segments the least document of the shard that holds it; and the segments' bounds among them."""
    split = pc.split_pattern(words, " ")
    ends = split.offsets.to_numpy()[1:].astype(np.int64)
    ids = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    index = FMIndex(ids, ends, doc_ids, window)
    rows = index.matches(ids, ends)
    starts = np.concatenate(([0], ends[:-1]))
    count = ends - starts - window + 1
    bounds = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], count)
    return index.least[rows[at]], bounds


_LEAST = "anchor long, segment long, least array<long>"


def indexed(rows: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(anchor, segment, least): for each window of a segment the least document that holds it, by the shard's FM-index."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_words):
            shard = shard.combine_chunks()
            words = shard.column("words").chunk(0).cast(pa.large_binary())
            least, bounds = least_documents(words, shard.column("doc_id").to_numpy(), window)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(least))
            yield pa.RecordBatch.from_arrays([shard.column("anchor").chunk(0), shard.column("segment").chunk(0), lists], ["anchor", "segment", "least"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(parts, total // (32 * shard_words))  # some five shards of six bytes a word for each task
    dealt = rows.select("anchor", "segment", "doc_id", "words").repartition(parts, "anchor").sortWithinPartitions("anchor", "segment")
    return dealt.mapInArrow(match, _LEAST)


def by_hash(rows: DataFrame) -> DataFrame:
    """(anchor, segment, least) of crowded anchors: equal windows by their hashes."""
    least = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    joined = rows.join(least, ["h1", "h2"]).groupBy("anchor", "segment").agg(F.array_sort(F.collect_set(F.struct("at", "least"))).alias("ls"))
    return joined.select("anchor", "segment", F.col("ls.least").alias("least"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, body, starts): the first words of all windows that an earlier document holds."""
    found = stored(occurrences(docs, window), "segments")
    texts = stored(fetched(docs, shared_segments(found, crowded), window), "segment-words")
    least = indexed(texts.filter("words is not null"), window, shard_words).unionByName(by_hash(texts.filter("words is null")))
    least = least.withColumn("bottom", F.array_min("least"))
    late = found.join(least, ["anchor", "segment"]).filter("bottom < doc_id")
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    return late.select("doc_id", "body", starts.alias("starts")).groupBy("doc_id", "body").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _kept(data: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, window: int) -> tuple[bytes, int]:
    """(the words left, joined by one blank; how many went) of one text."""
    n = len(begin)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    stays = np.cumsum(change)[:n] == 0
    edge = np.diff(stays.astype(np.int8), prepend=0, append=0)
    runs = zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True)
    return b" ".join(_SPACE.sub(b" ", data[begin[a] : end[b]].tobytes()) for a, b in runs), n - int(stays.sum())


NEW = ["kept_text", "n_words", "n_removed"]


def without_repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, crowded: int = CROWDED) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``kept_text``, ``n_words`` and ``n_removed``."""
    gone = repeated_windows(docs.select("doc_id", "text"), window, shard_words, crowded)
    return apply_removals(docs, gone, window)


def apply_removals(docs: DataFrame, gone: DataFrame, window: int = WINDOW) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = _binary(batch, "text"), batch.column("starts")
            kept, counts = [], []
            for at, data, offsets in shingles.text_slices(texts):
                _, begin, end, first = words_of(data, offsets)
                for i in range(len(offsets) - 1):
                    a, b = int(first[i]), int(first[i + 1])
                    starts = np.array(lists[at + i].as_py() or [], np.int64)
                    text, n = _kept(data, begin[a:b], end[a:b], starts, window)
                    kept.append(text)
                    counts.append((b - a, n))
            n_words, n_removed = zip(*counts, strict=True) if counts else ((), ())
            new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *new], ["row", *NEW])

    rest = [c for c in docs.columns if c not in NEW]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.xxhash64("text").alias("of_body"), F.col("text").alias("whole"))
    gone = gone.select(F.col("doc_id").alias("of_doc"), F.col("body").alias("of"), "starts")
    joined = rows.join(gone, (F.col("row.doc_id") == F.col("of_doc")) & (F.col("of_body") == F.col("of")), "left")
    schema = StructType([rows.schema["row"], StructField("kept_text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return joined.select("row", F.col("whole").alias("text"), "starts").mapInArrow(apply, schema).select("row.*", *NEW)


def digest(kept: Column) -> Column:
    return F.sha2(kept, 256)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", digest(F.col("kept_text")).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
), least AS (
  SELECT h, min(doc_id) AS low FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT w.doc_id, w.i + k.k AS place FROM win w JOIN least USING (h), (SELECT unnest(range(0, 50)) AS k) k WHERE low < w.doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS place FROM d
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY place) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
