"""Operator 7: SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut before every blank that follows another character; no
piece reaches over such a place, so the chunks are independent and each distinct
chunk is encoded once.  The distinct chunks are concatenated and indexed by a
suffix array (suffixes sorted on as many characters as the longest piece has).
Every piece of the vocabulary is found by binary search, which gives the range of
its occurrences; the occurrences are the edges, sorted by position.  Relaxing them
follows the byte-pair rule of the model: in each chunk the best-scored edge that
joins exactly two neighbouring symbols (the leftmost of equals) replaces them,
until no edge fits.  All chunks are relaxed side by side; chunks longer than
``LONG`` use a heap over the same edges, so they take n log n steps.

Characters outside the vocabulary become byte pieces.  The ids equal those of the
reference library, which the tests compare; decoding inverts them.

Defined cases: null text has null ids; empty text has none; repeated rows get equal
ids; an empty table gives an empty table; further columns are kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.llm.runtime import ship, table

MODEL_FILE = "piece_bpe_32k.model"
BLANK = "▁"
#: Characters of distinct chunks that are indexed at once, and of texts in a slice.
INDEX_CHARS = 200_000
SLICE_CHARS = 1_500_000
LONG = 128
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    raw: list[bytes]  # by id: a piece's bytes, or the one that a byte piece stands for
    text: list[str]  # matchable pieces
    ids: np.ndarray  # their ids
    rank: np.ndarray  # by id: place in the order of scores, equal for equal scores
    byte: np.ndarray  # id of each byte piece
    longest: int
    single: dict[str, int]


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if any(BLANK in pieces[i].lstrip(BLANK) for i in plain):
        raise ValueError("a piece reaches over a word's start; this model can't be cut into chunks")
    scores = np.array([model.get_score(i) for i in range(n)])
    rank = np.searchsorted(np.unique(-scores), -scores)
    byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    raw = [p.encode() for p in pieces]
    for b, i in enumerate(byte.tolist()):
        raw[i] = bytes((b,))
    return Vocabulary(raw, [pieces[i] for i in plain], np.array(plain), rank, byte, max(len(pieces[i]) for i in plain), {pieces[i]: i for i in plain if len(pieces[i]) == 1})


# ---- suffix array and edges ---------------------------------------------------


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class SuffixArray:
    """Suffixes sorted on their first characters; ``keys`` hold ``per`` dense characters each."""

    order: np.ndarray
    keys: list[np.ndarray]
    alphabet: np.ndarray
    bits: int
    per: int

    @classmethod
    def build(cls, codes: np.ndarray, depth: int) -> SuffixArray:
        alphabet = np.unique(codes)
        dense = (np.searchsorted(alphabet, codes) + 1).astype(np.uint64)  # 0 stands behind the end
        bits = int(len(alphabet) + 1).bit_length()
        per = 63 // bits
        padded = np.concatenate((dense, np.zeros(depth + per, np.uint64)))
        keys = []
        for start in range(0, depth, per):
            key = np.zeros(len(codes), np.uint64)
            for k in range(per):
                key = key << np.uint64(bits) | (padded[start + k : start + k + len(codes)] if start + k < depth else np.uint64(0))
            keys.append(key)
        order = np.lexsort(keys[::-1])
        return cls(order, [k[order] for k in keys], alphabet, bits, per)

    def ranges(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the range of suffixes that begin with it, by binary search."""
        lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(self.order))
        size = np.array([len(p) for p in pieces])
        flat = codes_of("".join(pieces))
        at = np.searchsorted(self.alphabet, flat)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == flat
        first = np.concatenate(([0], np.cumsum(size)))[:-1]
        hi[np.logical_and.reduceat(known, first) == 0] = 0
        for level, key in enumerate(self.keys):
            low, high = np.zeros(len(pieces), np.uint64), np.zeros(len(pieces), np.uint64)
            for k in range(self.per):
                c = level * self.per + k
                inside = c < size
                value = np.where(inside, at[np.minimum(first + c, len(at) - 1)] + 1, 0).astype(np.uint64)
                low = low << np.uint64(self.bits) | value
                high = high << np.uint64(self.bits) | np.where(inside, value, np.uint64((1 << self.bits) - 1))
            todo = (size > level * self.per) & (lo < hi)
            lo[todo], hi[todo] = _within(key, low[todo], lo[todo], hi[todo], False), _within(key, high[todo], lo[todo], hi[todo], True)
        return lo, hi


def _within(key: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """Binary searches side by side, each in its own range."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        probe = key[np.minimum(mid, len(key) - 1)]
        right = (probe <= value if after else probe < value) & (lo < hi)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(right | (lo >= hi), hi, mid)
    return lo


def edges(codes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id) of all occurrences of pieces, sorted by position."""
    index = SuffixArray.build(codes, vocab.longest)
    lo, hi = index.ranges(vocab.text)
    n = hi - lo
    within = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    start = index.order[np.repeat(lo, n) + within]
    length = np.repeat([len(p) for p in vocab.text], n)
    by_position = np.argsort(start * (vocab.longest + 1) + length)
    return start[by_position], length[by_position], np.repeat(vocab.ids, n)[by_position]


# ---- relaxation ----------------------------------------------------------------


def relax(chunks: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all chunks, and how many each has."""
    text = "\0".join(chunks)
    codes = codes_of(text).copy()
    size = np.array([len(c) for c in chunks])
    first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    barrier = np.uint32(0x110000)  # not a character, so no piece crosses it
    codes[first[1:] - 1] = barrier
    start, length, piece = edges(codes, vocab)
    wide = vocab.longest + 1
    found = np.full((len(codes) + 1) * wide, -1, np.int32)
    found[start * wide + length] = piece
    rank = np.append(vocab.rank, _NONE)  # -1 is no edge

    stop = np.arange(1, len(codes) + 2)  # end of the symbol that starts here
    alive = np.ones(len(codes), bool)
    alive[first[1:] - 1] = False
    long = size > LONG
    for c in np.flatnonzero(long).tolist():
        _relax_long(first[c], first[c] + size[c], stop, alive, found, wide, rank)
    chunk = np.repeat(np.arange(len(chunks)), size + 1)[: len(codes)]
    at = np.flatnonzero(alive & ~long[chunk])
    while len(at):
        of = chunk[at]
        right = np.append(at[1:], len(codes))
        same = np.append(of[1:] == of[:-1], False)
        end = np.where(same, stop[np.minimum(right, len(codes))], at)
        span = end - at
        value = np.where(same & (span < wide), rank[found[at * wide + np.minimum(span, wide - 1)]], _NONE)
        head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        best = np.minimum.reduceat(value, head)
        counts = np.diff(np.append(head, len(at)))
        hit = (value == np.repeat(best, counts)) & (value != _NONE)
        places = np.flatnonzero(hit)
        places = places[np.concatenate(([True], of[places][1:] != of[places][:-1]))] if len(places) else places
        stop[at[places]] = end[places]
        alive[at[places + 1]] = False
        go = np.repeat(best != _NONE, counts)
        go[places + 1] = False
        at = at[go]

    begins = np.flatnonzero(alive)
    span = stop[begins] - begins
    ids = found[begins * wide + span]
    missing = ids < 0
    owner = chunk[begins]
    if missing.any():
        raw = [text[i].encode("utf-8", "surrogatepass") for i in begins[missing].tolist()]
        n = np.ones(len(ids), np.int64)
        n[missing] = [len(b) for b in raw]
        gap = np.repeat(missing, n)
        ids, owner = np.repeat(ids, n), np.repeat(owner, n)
        ids[gap] = vocab.byte[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.bincount(owner, minlength=len(chunks))


def _relax_long(a: int, b: int, stop: np.ndarray, alive: np.ndarray, found: np.ndarray, wide: int, rank: np.ndarray) -> None:
    """One chunk with a heap of the edges that join two neighbours."""
    after, before = list(range(1, b - a + 1)), list(range(-1, b - a - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < b - a and after[j] - i < wide:
            r = int(rank[found[(a + i) * wide + after[j] - i]])
            if r != _NONE:
                heapq.heappush(heap, (r, i, after[j]))

    for i in range(b - a):
        offer(i)
    gone = bytearray(b - a)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= end or after[after[i]] != end:
            continue
        gone[after[i]] = 1
        alive[a + after[i]] = False
        after[i] = end
        stop[a + i] = a + end
        if end < b - a:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])


# ---- texts ----------------------------------------------------------------------


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of the texts."""
    seen: dict[str, int] = {}
    order, counts = [], []
    for text in texts:
        found = _CHUNK.findall(BLANK + text.replace(" ", BLANK)) if text else []
        order += [seen.setdefault(c, len(seen)) for c in found]
        counts.append(len(found))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[str] = []
    chars = 0
    for chunk in seen:
        held.append(chunk)
        chars += len(chunk)
        if chars >= INDEX_CHARS:
            parts.append(relax(held, vocab))
            held, chars = [], 0
    if held:
        parts.append(relax(held, vocab))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    flat, size = (np.concatenate([p[k] for p in parts]) for k in range(2))
    first = np.concatenate(([0], np.cumsum(size)))
    pick = np.array(order)
    n = size[pick]
    total = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.repeat(first[pick] - total[:-1], n) + np.arange(total[-1])]
    return ids.astype(np.int32), total[np.concatenate(([0], np.cumsum(counts)))]


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    """Byte pieces stand for their byte; no other piece begins inside a character, so all bytes are decoded at once."""
    text = b"".join([vocab.raw[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text.startswith(" ") else text


# ---- Spark -----------------------------------------------------------------------


def encoded(docs: DataFrame, model_path: str | None = None, verify: bool = False) -> DataFrame:
    """``docs`` with ids (array of int); with ``verify`` also round_trip: whether they decode to the text."""
    ship(docs.sparkSession)
    kept = docs.drop("ids", "round_trip") if verify else docs.drop("ids")
    where = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path or public_tokenizers.path(MODEL_FILE))  # found where the task runs
        for batch in batches:
            for part in slices(batch, where):
                texts = part.column(where).to_pylist()
                ids, offsets = encode_texts([t or "" for t in texts], vocab)
                column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=part.column(where).is_null())
                columns, names = [*part.columns, column], [*part.schema.names, "ids"]
                if verify:
                    at = zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                    same = [None if t is None else decode_ids(ids[a:b].tolist(), vocab) == t for t, a, b in at]
                    columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("round_trip", T.BooleanType())] if verify else fields))


def decoded(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """``rows`` with decoded, the text of their ids."""
    ship(rows.sparkSession)
    kept = rows.drop("decoded")
    where = kept.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path or public_tokenizers.path(MODEL_FILE))  # found where the task runs
        for batch in batches:
            texts = [None if not x.is_valid else decode_ids(x.values.to_numpy(zero_copy_only=False).tolist(), vocab) for x in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def slices(batch: pa.RecordBatch, where: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_CHARS bytes of text; one text is never cut."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(where).cast(pa.large_binary())])
    total, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to the text."""
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return out.select("doc_id", "ids", F.size("ids").alias("n_ids"), "round_trip")
