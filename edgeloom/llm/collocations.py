"""Operator 13: phrases whose words stand together more often than apart, mined with suffix arrays.

1. *Counts.*  A shard is some ``SHARD_WORDS`` consecutive words of a partition.  Its
   words become ids, a suffix array over them is built by prefix doubling (only as deep as
   the longest phrase), and runs of rows whose longest common prefix has at least n words
   are the n-grams of the shard with their counts.  A suffix ends with its piece.  Shards
   hand on one row for each n-gram; these are merged by key, each shard having summed its own.
   Words and pairs come first.  A second pass hands on longer phrases, but none with a pair
   below the least count, as it can't reach that count itself: the pairs that do are
   a bitmap of ``PAIR_BITS`` bits by hash, whatever the corpus (where two pairs share
   a bit a phrase is merely counted in vain).
   A shard begins with the last words of the one before it, as context only, so neither
   a long text nor a piece without an end needs a shard of its own.
2. *Scores.*  Candidates look up the counts of the two parts of each cut by joins on the
   part; the lowest score counts.  All of that is exact: products are decimals of 38 digits.
3. *Containment.*  Candidates hand their count to the shorter ones inside them.
4. *Report.*  The best of each language are first taken within ``SALTS`` parts of it, so
   no task sorts all candidates of a language.

Defined cases: null text is empty, a null ``lang`` counts as ``UNKNOWN``; repeated rows
count each time; a table without a word gives no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm import shingles
from edgeloom.llm.runtime import ship, stored, table

UNKNOWN = "und"
MAX_WORDS, MIN_COUNT, INSIDE_PERCENT, TOP = 3, 10, 50, 2000
#: Words of a shard; a task holds one shard at a time, at some 100 bytes a word.
SHARD_WORDS = 1_000_000
PAIR_BITS = 1 << 26
SALTS = 64
#: Rows of a batch that a shard hands on.
ROWS = 50_000

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True
_IS_WORD = ~_IS_BREAK
_IS_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def suffix_order(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` words at least; ``left`` counts the words up to the piece's end.

    Prefix doubling: the rank of 2h words comes from the rank of the first h and that of the next h, 0 where the piece ends.
    """
    rank, reach = words.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while reach < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-reach] = rank[reach:]
        after[left <= reach] = 0
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
        reach *= 2
    return order


def common_prefixes(words: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words each row of the suffix array shares with the row before it, ``depth`` at most."""
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    last = len(words) - 1
    for k in range(depth):
        same = same & (left[a] > k) & (left[b] > k) & (words[np.minimum(a + k, last)] == words[np.minimum(b + k, last)])
        lcp[1:] += same
    return lcp


def pair_bits(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bit of each pair of words, all given by their CRC-32."""
    with np.errstate(over="ignore"):
        h = (lang.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + first) * np.uint64(0xC2B2AE3D27D4EB4F) + second
        return (shingles.mix(h) % np.uint64(PAIR_BITS)).astype(np.int64)


def _sums(words: pa.Array) -> np.ndarray:
    return np.array([crc32(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


class Shard:
    """Words of consecutive texts: their bytes, pieces and languages.

    It counts phrases of ``sizes`` words; with ``pairs`` (64 bits of a bitmap each) only those whose pairs are in it.
    """

    def __init__(self, sizes: range, pairs: np.ndarray | None = None) -> None:
        self.sizes, self.max_words, self.pairs = sizes, sizes[-1], pairs
        self.bytes, self.lengths, self.pieces, self.langs = [], [], [], []
        self.names: dict[str, int] = {}
        self.size = self.context = self.n_pieces = 0

    def add(self, data: np.ndarray, bounds: np.ndarray, langs: list[str], goes_on: bool) -> None:
        """Words of ``data``, whose texts begin and end at ``bounds``; ``goes_on`` says that its first text began in the data before."""
        data = _LOWER[data]
        inside = _IS_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        begin = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
        end = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
        edge[0] = not goes_on
        breaks = _IS_BREAK[data] | edge[:-1]
        passed = np.cumsum(breaks)
        codes = np.array([self.names.setdefault(lang, len(self.names)) for lang in langs], np.int64)
        self.bytes.append(data[inside])
        self.lengths.append(end - begin)
        self.pieces.append(passed[begin] + self.n_pieces)
        self.langs.append(codes[np.searchsorted(bounds, begin, "right") - 1])
        self.n_pieces += int(passed[-1]) if len(passed) else 0
        self.size += len(begin)

    def _flat(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        lengths = np.concatenate(self.lengths)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(self.bytes))])
        return words, np.concatenate(self.pieces), np.concatenate(self.langs)

    def counts(self) -> Iterator[pa.RecordBatch]:
        """(lang, size, phrase, n) of the shard; size 0 counts all words of a language. The context is then what is left."""
        if self.size <= self.context:
            return
        words, pieces, langs = self._flat()
        encoded = words.dictionary_encode()
        ids = encoded.indices.to_numpy().astype(np.int64) * len(self.names) + langs + 1
        if ids.max() > 1 << 31:
            ids = np.unique(ids, return_inverse=True)[1] + 1
        closes = np.flatnonzero(np.concatenate((pieces[1:] != pieces[:-1], [True]))) + 1
        left = closes[np.searchsorted(closes, np.arange(len(ids)), "right")] - np.arange(len(ids))
        order = suffix_order(ids, left, self.max_words)
        lcp = common_prefixes(ids, left, order, self.max_words)
        names = pa.array(self.names, pa.string())
        if 1 in self.sizes:
            total = np.bincount(langs[self.context :], minlength=len(names))
            yield _rows(names, 0, pa.array([""] * len(names), pa.string()), total)
        often = np.ones(len(ids), bool)
        if self.pairs is not None:
            sums = _sums(encoded.dictionary)[encoded.indices.to_numpy()]
            bit = pair_bits(_sums(names)[langs[:-1]], sums[:-1], sums[1:])
            often[:-1] = (self.pairs[bit >> 6] >> (bit & 63)) & 1
        for n in self.sizes:
            starts = np.flatnonzero(lcp < n)
            counted = (left[order] >= n) & (order + n > self.context)
            for k in range(n - 1):
                counted &= often[np.minimum(order + k, len(ids) - 1)]
            count = np.add.reduceat(counted.astype(np.int64), starts)
            held = np.flatnonzero(count)
            for at in range(0, len(held), ROWS):
                some = held[at : at + ROWS]
                here = order[starts[some]]
                parts = [encoded.dictionary.take(encoded.indices.take(pa.array(here + k))) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
                yield _rows(names.take(pa.array(langs[here])), n, phrase.cast(pa.large_string()).cast(pa.string()), count[some])
        self._keep(words, pieces, langs)

    def _keep(self, words: pa.Array, pieces: np.ndarray, langs: np.ndarray) -> None:
        """Only the last words stay, as context of what follows."""
        tail = min(self.max_words - 1, len(words))
        kept = words.slice(len(words) - tail).to_pylist()
        names = list(self.names)
        self.bytes, self.lengths = [np.frombuffer(b"".join(kept), np.uint8)], [np.array([len(w) for w in kept], np.int64)]
        self.pieces = [pieces[len(pieces) - tail :]]
        codes = langs[len(langs) - tail :].tolist()
        self.names = {}
        self.langs = [np.array([self.names.setdefault(names[c], len(self.names)) for c in codes], np.int64)]
        self.size = self.context = tail


def _rows(lang: pa.Array, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), size, np.int32)), phrase, pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "n"])


def shard_counts(batches: Iterator[pa.RecordBatch], shard: Shard, shard_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for at, data, offsets in shingles.text_slices(batch.column("text").cast(pa.large_binary())):
            for begin, stop in shingles.stretches(data):
                bounds = shingles.inside_offsets(offsets, begin, stop)
                first = int(np.searchsorted(offsets, begin, "right")) - 1
                shard.add(data[begin:stop], bounds[:-1], langs[at + first : at + first + len(bounds) - 1], offsets[first] < begin)
                if shard.size >= shard_words:
                    yield from shard.counts()
    yield from shard.counts()


def frequent_pairs(counts: DataFrame) -> np.ndarray:
    """The bitmap of all pairs of ``counts``; at most ``PAIR_BITS`` / 64 rows reach the driver."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (pc.list_element(pc.split_pattern(batch.column("phrase"), " "), k) for k in (0, 1))
            bit = pair_bits(_sums(batch.column("lang")), _sums(first), _sums(second)) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.int64(1) << (bit & 63))], ["place", "bits"])

    places = counts.filter("size = 2").select("lang", "phrase").mapInArrow(listed, "place long, bits long")
    found = places.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(PAIR_BITS // 64, np.int64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return out


def _merged(texts: DataFrame, sizes: range, min_count: int, shard_words: int, pairs: np.ndarray | None = None) -> DataFrame:
    sent = None if pairs is None else texts.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shard_counts(batches, Shard(sizes, sent and sent.value), shard_words)

    # dealt by key first: shards have summed their own rows, so another sum ahead of the shuffle finds little
    dealt = texts.mapInArrow(count, "lang string, size int, phrase string, n long").repartition("lang", "size", "phrase")
    merged = dealt.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return stored(merged.filter((F.col("n") >= min_count) | (F.col("size") == 0)), "phrases")


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, size, phrase, n) of all runs of up to ``max_words`` words with at least ``min_count`` occurrences; size 0 counts all words of the language."""
    ship(docs.sparkSession)
    texts = docs.filter("text is not null").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    short = _merged(texts, range(1, min(max_words, 2) + 1), min_count, shard_words)
    if max_words < 3:
        return short
    return short.unionByName(_merged(texts, range(3, max_words + 1), min_count, shard_words, frequent_pairs(short)))


def _part(words: str, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of all phrases of two words and more, at their lowest-scoring cut."""
    phrases = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part("ws", 1, F.col("k")).alias("head"), _part("ws", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    of = counts.filter("size > 0")
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    wide = lambda c: f"cast({c} as decimal(16,0))"
    score = F.expr(f"cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def inside_longer(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, longer): the largest count among longer phrases that hold a phrase of two words and more."""
    longer = counts.filter("size > 2").select("lang", "size", "n", F.split("phrase", " ").alias("ws"))
    inner = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    return inner.select("lang", _part("ws", F.col("at"), F.col("m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def best_of_each(rows: DataFrame, top: int, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``rank``: the first ``top`` of each language, through the first ``top`` of its salted parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.abs(F.xxhash64("phrase") % salts))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top).drop("place", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, top: int = TOP, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (lang, text)."""
    counts = phrase_counts(docs, max_words, min_count, shard_words)
    rows = scored(counts).join(inside_longer(counts, max_words), ["lang", "phrase"], "left")
    rows = rows.filter(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    words = counts.filter("size = 0").select("lang", "n")
    return best_of_each(rows, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM d)
), grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM pieces WHERE len(ws) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM pieces WHERE len(ws) > 2
), f AS (
  SELECT lang, size, phrase, count(*)::HUGEINT AS n FROM grams GROUP BY ALL
), total AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), cand AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k.k, l.n AS l, r.n AS r, 1000000 * c.a * c.a // (l.n * r.n) AS score
  FROM cand c JOIN (SELECT unnest([1, 2]) AS k) k ON k.k < c.size
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k.k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_of AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM cand WHERE size = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_of i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n AS n, score::BIGINT AS score
FROM ranked JOIN total t USING (lang) WHERE rank <= 2000
"""
