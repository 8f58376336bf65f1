"""Resampling, passage dedup and phrase mining against brute force, with odd rows in the tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from edgeloom.llm import collocations, fm_index, resampling, substring_dedup

from test_operators import docs, lower, nothing, odd_texts, prose, split_words, texts  # noqa: F401

# ---- 11 --------------------------------------------------------------------------


def features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return ws, [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def expected_draw(rows, target, share=5):
    """{(doc_id, n_features, weight, score, rank): count} of (doc_id, text) rows."""
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        ws, fs = features(x)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    eligible = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    drawn = eligible[: share * len(eligible) // 100]
    rank = {r[0]: k + 1 for k, r in enumerate(drawn)}
    return sorted((*r[:4], rank.get(r[0])) for r in out)


def plain(frame, columns):
    return sorted(tuple(None if v != v else int(v) for v in r) for r in frame[columns].astype(float).itertuples(index=False))


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_equals_brute_force(docs, texts, spark, monkeypatch):  # noqa: F811
    target = [odd_texts()[6], "alpha1 beta2 gamma3 Alpha1-beta2", None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for share in (5, 40):
        got = resampling.resampled(docs, goal, share=share).toPandas()
        assert plain(got, COLUMNS) == expected_draw(list(texts.items()), target, share)


def test_resampling_of_the_documents_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    assert plain(resampling.op11_importance_resampling(spark, sf_dir).toPandas(), COLUMNS) == expected_draw(rows, target)


def test_features_of_long_texts_come_in_chunks(monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 7)
    text = "Ab c. ünï 12 漢字 x-y " * 20
    got = list(resampling.feature_buckets(text.encode()))
    assert max(n for n, _ in got) == 7
    assert Counter(np.concatenate([b for _, b in got]).tolist()) == Counter(bucket(f) for f in features(text)[1])


def test_kth_key_and_ranks_of_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(d)) for s, d in zip(rng.integers(-(1 << 62), 1 << 62, 60), rng.integers(-(1 << 62), 1 << 62, 60), strict=True)]
    rows += [(5, int(d)) for d in rng.integers(-9, 9, 40)] + [(-1, 0), (-1, -1), ((1 << 63) - 1, 0), (-(1 << 63), 0)]
    df = spark.createDataFrame(rows, "score long, doc_id long").cache()
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 40, 71, len(rows)):
        assert resampling.kth_key(df, k) == ordered[k - 1]
    assert resampling.kth_key(df, len(rows) + 1) is None
    got = resampling.ranked(df, 50).toPandas()
    assert sorted(got["rank"].dropna()) == list(range(1, 51))
    assert [tuple(map(int, r)) for r in got.dropna().sort_values("rank")[["score", "doc_id"]].to_numpy().tolist()] == ordered[:50]


def test_resampling_of_repeated_null_and_no_rows(spark, nothing):  # noqa: F811
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text)] * 10 + [(None, text)] * 5 + [(2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([(text,)], "text string")
    got = resampling.resampled(df, goal, share=30).toPandas()
    assert len(got) == 16 and sorted(got["rank"].dropna()) == [1, 2, 3]  # of ten equal rows, three
    assert got[got.doc_id.isna()].score.isna().all() and (got[got.doc_id.isna()].weight == got[got.doc_id == 1].weight.iloc[0]).all()
    assert resampling.resampled(nothing, goal).count() == 0
    assert resampling.resampled(df, goal.limit(0)).count() == 16


# ---- 12 --------------------------------------------------------------------------


def encoded(parts):
    """Word ids from 1 on of lists of letters, and the ends of the lists."""
    return np.array([ord(c) - 96 for p in parts for c in p], np.int64), np.cumsum([len(p) for p in parts]).astype(np.int64)


@pytest.mark.parametrize("threshold", [1, 2, 3, 5, 8])
def test_matches_of_streamed_texts_equal_brute_force(threshold):
    rng = np.random.default_rng(threshold)
    for _ in range(25):
        parts = ["".join(rng.choice(list("abc"), int(n))) for n in rng.integers(1, 30, 6)]
        index = fm_index.FMIndex(*encoded(parts), np.array([7, 3, 9, 1, 8, 2]), threshold)
        streamed = [*parts[:2], *("".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(1, 40, 5)), parts[3] + parts[4]]
        ids, ends = encoded(streamed)
        rows = index.matches(np.where(ids < index.alphabet, ids, 0), ends)
        got = [None if r < 0 else int(index.least[r]) for r in rows]
        want = []
        for s in streamed:
            for i in range(len(s)):
                piece = s[i : i + threshold]
                holds = [d for p, d in zip(parts, [7, 3, 9, 1, 8, 2], strict=True) if len(piece) == threshold and piece in p]
                want.append(min(holds, default=None))
        assert got == want


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 11, 500)
    matrix = fm_index.WaveletMatrix(symbols, 11)
    every, at = np.repeat(np.arange(11), 501), np.tile(np.arange(501), 11)
    counts = matrix.place(every, at) - matrix.place(every, np.zeros_like(at))
    assert counts.tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(every, at, strict=True)]


def expected_removal(rows, window):
    """[(doc_id, n_words, n_removed, kept)] of (doc_id, text) rows."""
    least = {}
    for i, t in rows:
        ws = split_words(t)
        for k in range(len(ws) - window + 1) if i is not None else ():
            key = tuple(ws[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        ws = split_words(t)
        gone = set()
        for k in range(len(ws) - window + 1) if i is not None else ():
            if least[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def removal(df, **options):
    got = substring_dedup.without_repeats(df, **options).toPandas()
    return sorted(((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got.itertuples()), key=str)


@pytest.fixture(scope="module")
def passages(spark):
    """Texts of a small vocabulary with passages that stand in many contexts, once or twice."""
    rng = np.random.default_rng(9)
    shared = [prose(rng, int(n)) for n in rng.integers(8, 90, 6)]
    rows = []
    for i in range(120):
        parts = [prose(rng, int(rng.integers(0, 25))), shared[int(rng.integers(6))], prose(rng, 5), shared[0], prose(rng, int(rng.integers(0, 9)))]
        rows.append((i, ("  \n" if i % 3 else " ").join(parts)))
    rows += [(3, rows[3][1]), (3, rows[7][1]), (500, "word " * 400), (501, "word " * 390 + "end"), (502, ""), (503, None), (None, rows[5][1]), (None, None), (504, shared[1].upper())]
    return rows


@pytest.mark.parametrize("options", [{}, {"window": 6, "shard_words": 300}, {"window": 9, "shard_words": 200, "crowded": 3}, {"window": 50, "crowded": 0}])
def test_passage_dedup_equals_brute_force(spark, passages, options):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(3)
    assert removal(df, **options) == expected_removal(passages, options.get("window", substring_dedup.WINDOW))


def test_passages_of_odd_texts_and_clashing_columns(docs, texts, nothing, spark):  # noqa: F811
    assert removal(docs) == expected_removal(list(texts.items()), 50)
    assert substring_dedup.without_repeats(nothing).count() == 0
    named = spark.createDataFrame([(1, "a b", 5, "x", 3)], "doc_id long, text string, body long, starts string, n_words long")
    got = substring_dedup.without_repeats(named)
    assert got.columns == ["doc_id", "text", "body", "starts", "kept_text", "n_words", "n_removed"]
    assert got.first().asDict() == {"doc_id": 1, "text": "a b", "body": 5, "starts": "x", "kept_text": "a b", "n_words": 2, "n_removed": 0}


def test_a_shard_ends_between_anchors():
    rows = [(a, s, d, b" ".join([b"w"] * 5)) for a, s, d in [(1, 1, 4), (1, 2, 5), (1, 2, 5), (2, 1, 3), (2, 5, 9), (3, 1, 1), (3, 1, 1), (4, 0, 2)]]
    table = pa.table(dict(zip(["anchor", "segment", "doc_id", "words"], zip(*rows, strict=True), strict=True)))
    for size in (1, 2, 3, 8):
        got = [t.column("anchor").to_pylist() for t in substring_dedup._shards(iter(table.to_batches(max_chunksize=size)), 10)]
        assert got == [[1, 1], [2, 2], [3, 4]]


# ---- 13 --------------------------------------------------------------------------


def expected_phrases(rows, min_count, inside, top, longest=3):
    f, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(ws)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        scored = []
        for p, a in cand.items():
            if longer[p] and 100 * longer[p] >= inside * a:
                continue
            score, _, l, r = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, l, r, words[lang], -s))
    return sorted(out)


def phrases(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.fixture(scope="module")
def chatter():
    rng = np.random.default_rng(4)
    words = ["a", "B", "c", "d", "é", "漢字", "#e"]
    texts = ["".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b", " "], p=[0.5, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(int(n))) for n in rng.integers(0, 60, 90)]
    rows = [(["en", "de", None, "und"][i % 4], t) for i, t in enumerate(texts)]
    return rows + [("en", None), (None, ""), ("fr", " \t"), ("en", "x y z " * 300), ("de", "x y z " * 12), ("de", "x y z " * 12)]


@pytest.mark.parametrize("options", [{}, {"shard_words": 20, "min_count": 3}, {"shard_words": 200, "top": 5, "inside_percent": 80}, {"shard_words": 7, "min_count": 2, "max_words": 5, "inside_percent": 30}])
def test_phrases_equal_brute_force(spark, chatter, options):
    df = spark.createDataFrame(chatter, "lang string, text string").repartition(3)
    want = expected_phrases(chatter, options.get("min_count", 10), options.get("inside_percent", 50), options.get("top", 2000), options.get("max_words", 3))
    assert phrases(df, **options) == want


def test_phrases_of_long_texts_cross_stretches(spark, monkeypatch):
    rows = [("en", " ".join(f"w{i * i % 17}" for i in range(150_000)))]  # longer than a slice, without a break
    assert phrases(spark.createDataFrame(rows, "lang string, text string"), shard_words=10_000) == expected_phrases(rows, 10, 50, 2000)


def test_phrases_of_nothing_and_exact_products(spark, nothing):  # noqa: F811
    assert collocations.collocations(nothing).count() == 0
    big = 3_000_000_019
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 2, "a b", big - 1), ("en", 0, "", 9 * big)], "lang string, size int, phrase string, n long")
    assert collocations.scored(counts).first().score == 1000000 * (big - 1) ** 2 // (big * (big + 2))


def test_suffix_order_and_prefixes_equal_brute_force():
    rng = np.random.default_rng(1)
    words, ends = rng.integers(1, 4, 80), np.sort(rng.choice(np.arange(1, 80), 9, replace=False)).tolist() + [80]
    left = np.array([min(e for e in ends if e > i) - i for i in range(80)])
    order = collocations.suffix_order(words, left, 5)
    heads = [tuple(words[i : i + min(left[i], 5)].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(80)) and heads == sorted(heads)
    lcp = collocations.common_prefixes(words, left, order, 5)
    want = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(heads, heads[1:])]
    assert lcp.tolist() == want
