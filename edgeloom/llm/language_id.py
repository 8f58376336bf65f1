"""Operator 5: language of code-switched text by a linear-chain CRF.

Each word of a text is a node of the chain, its label a language.  A word's score
for a language sums the weights of hashed features: byte n-grams of length 2 to 4
inside the word and over its edges, affixes of three bytes, and the word itself
where it is in the lexicon (words that several training windows hold).  The
weights and the transitions between languages are learned together by maximum
conditional likelihood with forward-backward; training sequences join pieces of
windows in different languages, so switches are seen.

Prediction runs forward-backward over the whole text.  All texts of a slice are
cut into blocks of ``BLOCK`` words; the transfer matrices of all blocks are built
side by side, blocks are chained per text, and then all blocks are finished side
by side.  This is the exact recursion, for texts of any length; features are made
stretch by stretch and blocks are finished ``CHUNK`` at a time, so a worker holds some
fifty bytes for each word of a text beside the text.  A text's language
is the one with the largest sum of word marginals, its score the share of it.

The training sample is bounded by ``TRAIN_DOCS`` documents a language, those with the
smallest hashes of their ids; their whole texts are used.  It is the only thing that
reaches the driver.

Defined cases: null text or text without a letter is ``und`` with score 0; without
any labelled document all are; rows with a null ``doc_id`` or ``lang`` are never
trained on; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from edgeloom.llm.runtime import ship, table
from edgeloom.llm.shingles import _IS_WORD, inside_offsets, stretches, text_slices, word_hashes, word_starts

#: Bound of the training sample: labelled documents of a language.
TRAIN_DOCS = 200
SEQUENCE = 48
EPOCHS = 6
BLOCK = 32
#: Blocks that are finished at once.
CHUNK = 512
#: Size of the table of hashed features.
FEATURES = 1 << 17
UNKNOWN = "und"
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[~_IS_WORD] = 32
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (FEATURES, languages)
    transitions: np.ndarray  # (languages, languages), logarithms
    lexicon: np.ndarray  # sorted hashes of words


@dataclass
class Words:
    """Feature slots of the words of a slice: ``slots`` by byte position, ``own`` by word."""

    slots: np.ndarray  # (positions, 3)
    head: np.ndarray  # first position of each word
    own: np.ndarray  # (words, 3): prefix, suffix, lexicon (or -1)
    first: np.ndarray  # first word of each text, one more at the end
    letters: np.ndarray  # words that may hold a letter

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.zeros((0, weights.shape[1]))
        total = weights[self.slots[:, 0]]
        total += weights[self.slots[:, 1]]
        total += weights[self.slots[:, 2]]
        out = np.add.reduceat(total, self.head, axis=0).astype(np.float64)
        out += weights[self.own[:, 0]] + weights[self.own[:, 1]]
        known = self.own[:, 2] >= 0
        out[known] += weights[self.own[known, 2]]
        return out


def _slot(value: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (value.astype(_U) * _U(8) + _U(kind)) * _U(0x9E3779B97F4A7C15)
    return (h >> _U(64 - FEATURES.bit_length() + 1)).astype(np.int32)


def featurize(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> Words:
    hashes, first = word_hashes(data, offsets)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = _IS_WORD[data] if n else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    starts = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))) if n else inside
    stops = inside & (edge[1:] | np.concatenate((~inside[1:], [True]))) if n else inside
    low = np.concatenate((_LOWER[data], np.full(3, 32, np.uint8))).astype(np.uint32)
    here = low[at]
    prior = np.where(starts[at], 32, low[at - 1])
    last = stops[at]
    after = np.where(last, 32, low[at + 1])
    last2 = last | np.concatenate((stops, [True] * 2))[at + 1]
    beyond = np.where(last2, 32, low[at + 2])
    two = prior << 8 | here
    three = two << 8 | after
    four = three.astype(_U) << _U(8) | beyond.astype(_U)
    slots = np.stack((_slot(two, 0), _slot(three, 1), _slot(four, 2)), axis=1) if len(at) else np.zeros((0, 3), np.int32)
    head = np.flatnonzero(starts[at])
    tail = np.concatenate((head[1:], [len(at)])) - 1 if len(head) else head
    prefix = _slot(three[np.minimum(head + 1, tail)], 3)
    suffix = _slot(three[np.maximum(tail - 1, head)], 4)
    where = np.searchsorted(lexicon, hashes)
    known = (where < len(lexicon)) & (lexicon[np.minimum(where, len(lexicon) - 1)] == hashes) if len(lexicon) else np.zeros(len(hashes), bool)
    own = np.stack((prefix, suffix, np.where(known, _slot(hashes, 5), -1)), axis=1) if len(head) else np.zeros((0, 3), np.int32)
    letters = np.logical_or.reduceat(_LETTER_BYTE[data[at]], head) if len(head) else np.zeros(0, bool)
    return Words(slots, head, own, first, letters)


# ---- forward-backward -----------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior label probabilities of every word; ``first`` bounds the texts."""
    n, k = scores.shape
    if not n:
        return scores
    a = np.exp(transitions)
    size = np.diff(first)
    blocks = -(-size // block)
    start = np.concatenate(([0], np.cumsum(blocks)))
    of = np.repeat(np.arange(len(size)), blocks)  # the text of each block
    begin = first[of] + (np.arange(start[-1]) - start[of]) * block
    end = np.minimum(begin + block, first[of + 1])

    def laid_out(c: int) -> tuple[np.ndarray, np.ndarray]:
        """Potentials and which of them are words, of CHUNK blocks from c on."""
        at = begin[c : c + CHUNK, None] + np.arange(block)
        valid = at < end[c : c + CHUNK, None]
        x = scores[np.minimum(at, n - 1)]
        p = np.exp(x - x.max(axis=2, keepdims=True))
        p[~valid] = 1
        return p, valid

    product = np.broadcast_to(np.eye(k), (start[-1], k, k)).copy()
    for c in range(0, start[-1], CHUNK):
        potential, valid = laid_out(c)
        x = product[c : c + CHUNK]
        for t in range(block):
            step = (x.reshape(-1, k) @ a).reshape(-1, k, k) * potential[:, t, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            x = np.where(valid[:, t, None, None], step, x)
        product[c : c + CHUNK] = x

    before = np.full((start[-1], k), 1.0 / k)
    behind = np.full((start[-1], k), 1.0 / k)
    for b in range(1, int(blocks.max(initial=0))):
        at = start[:-1][blocks > b] + b
        before[at] = _unit(np.einsum("ij,ijk->ik", before[at - 1], product[at - 1]))
        at = start[1:][blocks > b] - b
        behind[at - 1] = _unit(np.einsum("ijk,ik->ij", product[at], behind[at]))

    out = np.empty((n, k))
    for c in range(0, start[-1], CHUNK):
        potential, valid = laid_out(c)
        forward = np.empty_like(potential)
        x = before[c : c + CHUNK]
        for t in range(block):
            x = np.where(valid[:, t, None], _unit((x @ a) * potential[:, t]), x)
            forward[:, t] = x
        x = behind[c : c + CHUNK]
        for t in range(block - 1, -1, -1):
            forward[:, t] *= x
            x = np.where(valid[:, t, None], _unit((potential[:, t] * x) @ a.T), x)
        out[begin[c] : end[min(c + CHUNK, start[-1]) - 1]] = _unit(forward[valid])  # words of neighbouring blocks follow each other
    return out


# ---- training --------------------------------------------------------------------


def training_texts(docs: DataFrame, per_language: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """(language, text) of at most ``per_language`` documents of each language, the same ones on each call."""
    known = docs.filter("lang is not null and doc_id is not null and text is not null")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * per_language / n)))) if counts else None
    if share is None:
        return []
    picked = known.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30))).filter(F.col("h") < share[F.col("lang")] * (1 << 30))
    order = ["lang", "h", "doc_id", "text"]
    first = F.row_number().over(Window.partitionBy("lang").orderBy(*order[1:]))  # of the bounded share
    rows = picked.withColumn("r", first).filter(F.col("r") <= per_language).select("lang", "h", "doc_id", "text").collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: tuple(r[c] for c in order)) if r["text"].strip()]


def train(windows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    languages = sorted({lang for lang, _ in windows})
    rng = np.random.default_rng(seed)
    pieces = []  # (language, words) of 6 to 24 words
    seen: dict[bytes, int] = {}
    for lang, text in windows:
        ws = text.encode().split()
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
        at = 0
        while at < len(ws):
            n = int(rng.integers(6, 25))
            pieces.append((languages.index(lang), ws[at : at + n]))
            at += n
    common = [w for w, n in seen.items() if n >= 3]
    lexicon = _hash_words(common)
    k = len(languages)
    weights, transitions = np.zeros((FEATURES, k), np.float32), np.zeros((k, k))
    g_w, g_t = np.full(FEATURES, 1e-2, np.float32), np.full((k, k), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        sequences, words, labels = [], [], []
        for i in order:
            words += pieces[i][1]
            labels += [pieces[i][0]] * len(pieces[i][1])
            if len(words) >= SEQUENCE:
                sequences.append((words, labels))
                words, labels = [], []
        if words:
            sequences.append((words, labels))
        for s in range(0, len(sequences), 64):
            part = sequences[s : s + 64]
            texts = [b" ".join(w) for w, _ in part]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts])))
            f = featurize(data, offsets, lexicon)
            gold = np.concatenate([y for _, y in part])
            scores = f.scores(weights)
            gamma = marginals(scores, f.first, transitions)
            delta = gamma
            delta[np.arange(len(gold)), gold] -= 1
            # expected and observed transitions, with pair marginals from the scores
            pair = _pair_counts(scores, f.first, transitions)
            np.subtract.at(pair, (gold[:-1], gold[1:]), _same_text(f.first, len(gold)))
            word_of = np.repeat(np.arange(len(f.head)), np.diff(np.concatenate((f.head, [len(f.slots)]))))
            known = f.own[:, 2] >= 0
            slots = np.concatenate((*f.slots.T, f.own[:, 0], f.own[:, 1], f.own[known, 2]))
            source = np.concatenate((word_of, word_of, word_of, np.arange(len(gold)), np.arange(len(gold)), np.flatnonzero(known)))
            grad = np.stack([np.bincount(slots, delta[source, c], FEATURES) for c in range(k)], axis=1).astype(np.float32) / len(gold)
            g_w += (grad**2).sum(axis=1)
            weights -= 0.3 * grad / np.sqrt(g_w)[:, None] + 1e-6 * weights
            step = pair / len(gold)
            g_t += step**2
            transitions -= 0.5 * step / np.sqrt(g_t)
    return Model(languages, weights, transitions, lexicon)


def _hash_words(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, _U)
    data = np.frombuffer(b" ".join(words), np.uint8)
    return np.unique(word_hashes(data, np.array([0, len(data)]))[0])


def _same_text(first: np.ndarray, n: int) -> np.ndarray:
    """For words t and t+1: 1 if of one text."""
    out = np.ones(n - 1)
    cut = first[1:-1]
    out[cut[(cut > 0) & (cut < n)] - 1] = 0
    return out


def _pair_counts(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected numbers of transitions, from plain forward-backward side by side over short texts."""
    k, a = scores.shape[1], np.exp(transitions)
    size = np.diff(first)
    longest = int(size.max())
    p = np.ones((len(size), longest, k))
    text = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(scores)) - first[text]
    p[text, inner] = np.exp(scores - scores.max(axis=1, keepdims=True))
    alive = np.arange(longest)[None, :] < size[:, None]
    forward = np.empty_like(p)
    x = np.full((len(size), k), 1.0 / k)
    for t in range(longest):
        x = np.where(alive[:, t, None], _unit((x @ a) * p[:, t]), x)
        forward[:, t] = x
    out = np.zeros((k, k))
    x = np.ones((len(size), k))
    for t in range(longest - 1, 0, -1):
        right = p[:, t] * x
        joint = forward[:, t - 1, :, None] * a[None] * right[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        out += joint[alive[:, t]].sum(axis=0)
        x = np.where(alive[:, t, None], _unit(right @ a.T), x)
    return out


# ---- prediction -----------------------------------------------------------------


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text of a slice."""
    n = len(offsets) - 1
    if not model.languages:
        return [UNKNOWN] * n, [0.0] * n
    scores, letters = [], []
    for at, stop in stretches(data):  # a word's features do not reach over white space
        f = featurize(data[at:stop], inside_offsets(offsets, at, stop), model.lexicon)
        scores.append(f.scores(model.weights))
        letters.append(f.letters)
    first = word_starts(data, offsets)
    gamma = marginals(np.concatenate(scores or [np.zeros((0, len(model.languages)))]), first, model.transitions)
    gamma *= np.concatenate(letters or [np.zeros(0, bool)])[:, None]
    total = np.concatenate((np.zeros((1, len(model.languages))), np.cumsum(gamma, axis=0)))
    votes = total[first[1:]] - total[first[:-1]]
    best, mass = votes.argmax(axis=1), votes.sum(axis=1)
    ascii_letter = _LETTER_BYTE.copy()
    ascii_letter[128:] = False
    plain = [bool(ascii_letter[data[a:b]].any()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    names, shares = [], []
    for i in range(n):
        if mass[i] > 0 and (plain[i] or regex.search(r"\p{L}", data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))):
            names.append(model.languages[best[i]])
            shares.append(float(min(1.0, max(0.0, votes[i, best[i]] / mass[i]))))
        else:
            names.append(UNKNOWN)
            shares.append(0.0)
    return names, shares


def with_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    ship(docs.sparkSession)
    model = model or train(training_texts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by FEATURES
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    where = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for _, data, offsets in text_slices(batch.column(where)):
                a, b = predict(shared.value, data, offsets)
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_texts(docs))
    out = with_language(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
