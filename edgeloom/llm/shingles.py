"""Hashed word shingles of whole texts, computed on Arrow batches with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A text's shingles are its
distinct runs of ``size`` words, or the whole word sequence where it is shorter;
each is a 64-bit hash.  Texts are handled in slices of a batch of about
``SLICE_BYTES``, so memory does not follow the batch size; a text is never cut.  Words
of a longer text are hashed stretch by stretch (:func:`stretches`), as no word crosses
white space, so beside the text itself a few bytes for each word are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
SLICE_BYTES = 256_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if n <= SLICE_BYTES + 1 and _powers:
        return _powers["up"], _powers["down"]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(max(n, SLICE_BYTES + 1), base, _U)
        out[0] = 1
        with np.errstate(over="ignore"):
            made.append(np.multiply.accumulate(out))
    if n <= SLICE_BYTES + 1:  # longer tables, for a word beyond a stretch, are not kept
        _powers["up"], _powers["down"] = made
    return made[0], made[1]


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of consecutive slices; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive stretches of about ``SLICE_BYTES`` that end at white space or at the end."""
    at, n = 0, len(data)
    while at < n:
        stop = min(at + SLICE_BYTES, n)
        if stop < n:
            gaps = np.flatnonzero(~_IS_WORD[data[at:stop]])
            while not len(gaps) and stop < n:  # a word longer than a stretch stays whole
                more = np.flatnonzero(~_IS_WORD[data[stop : stop + SLICE_BYTES]])
                if len(more):
                    gaps = more[:1] + (stop - at)
                stop = min(stop + SLICE_BYTES, n)
            stop = at + int(gaps[-1]) + 1 if len(gaps) else n
        yield at, stop
        at = stop


def inside_offsets(offsets: np.ndarray, at: int, stop: int) -> np.ndarray:
    """Text bounds within a stretch, relative to it, with its own ends."""
    inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "left")]
    return np.concatenate(([0], inner - at, [stop - at]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    if len(data) <= SLICE_BYTES:
        return _word_hashes(data, offsets)
    hashes, begins = [], []
    for at, stop in stretches(data):
        h, first = _word_hashes(data[at:stop], inside_offsets(offsets, at, stop))
        inner = (offsets >= at) & (offsets < stop)
        where = np.searchsorted(inside_offsets(offsets, at, stop), offsets[inner] - at)
        begins.append(sum(map(len, hashes)) + first[where])
        hashes.append(h)
    total = sum(map(len, hashes))
    ends = np.full(len(offsets) - sum(map(len, begins)), total)
    return np.concatenate(hashes), np.concatenate((*begins, ends))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[data] * up[: len(data)], dtype=_U)))
        hashes = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(_U))
    return hashes, np.searchsorted(begins, offsets)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the index of its first word, and the number of words at the end."""
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= edge[1:-1] | ~inside[:-1]
    return np.searchsorted(np.flatnonzero(begins), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        h = words[: max(len(words) - size + 1, 0)].copy()
        for k in range(1, size):
            h = h * _U(0xC2B2AE3D27D4EB4F) + words[k : k + len(h)]
        h = mix(h)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                s = np.sort(h[a : b - size + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                x = _U(b - a)
                for w in words[a:b]:
                    x = x * _U(0x9FB21C651E98DF25) + w
                out.append(mix(np.array([x], _U)))
            else:
                out.append(np.zeros(0, _U))
    return out


def set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that identify each set, whatever its order."""
    with np.errstate(over="ignore"):
        a = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], _U)
        b = np.array([mix(s).sum(dtype=_U) if len(s) else 0 for s in sets], _U)
    return a.view(np.int64), b.view(np.int64)
