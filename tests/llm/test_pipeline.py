"""The pipeline on the smallest tables, stage by stage, against plain Python."""

from pathlib import Path
from urllib.parse import urlparse

import pytest

import corpus_pipeline
from edgeloom.llm.runtime import intermediates, shared_dir, stored

from test_operators import key_of_line, roots, shingles


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return [d.toPandas().set_index("doc_id") for d in out]


def test_stages_hand_on_documents(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "privacy", "packing"]
    for frame in steps[:-1]:
        assert [frame.index.name, *frame.columns] == corpus_pipeline.COLUMNS
    assert set(steps[1].index) == set(steps[0].index)  # all have letters


def test_lines(steps):
    before, after = steps[1].text.to_dict(), steps[2].text.to_dict()
    holders = {}
    for i, t in before.items():
        for line in t.split("\n"):
            holders.setdefault(key_of_line(line), set()).add(i)
    keep = lambda i, x: len(key_of_line(x)) < 20 or len(holders[key_of_line(x)]) < 3 or i == max(holders[key_of_line(x)])
    want = {i: [x for x in t.split("\n") if keep(i, x)] for i, t in before.items()}
    changed = {i: "\n".join(x) for i, x in want.items()}
    assert after == {i: t for i, t in changed.items() if t.split() or t == before[i]}


def test_near_duplicates(steps):
    sets = {i: shingles(t) for i, t in steps[2].text.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert set(steps[3].index) == {i for i, r in roots(sets, links).items() if i == r}


def test_privacy_and_packing(steps):
    import re

    assert not any("@mail" in t for t in steps[4].text)
    same = [i for i, t in steps[3].text.items() if not re.search(r"[\d@]|token", t)]
    assert all(steps[4].text[i] == steps[3].text[i] for i in same)
    assert set(steps[5].index) == set(steps[4].index)


def test_intermediates_of_the_stages_are_deleted(spark, sf_dir):
    """Beside the input of the last stage and what that stage stores, nothing is left; the result can be read."""
    folder = Path(urlparse(shared_dir(spark)).path)
    names = lambda: {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before and (p / "_SUCCESS").exists()}
    before = {p.name for p in folder.iterdir()}
    got = corpus_pipeline.run(spark, sf_dir)
    left = names()
    assert got.count() > 0 and "pipeline-privacy" in left
    assert not left & {"pipeline-language", "pipeline-lines", "pipeline-near_duplicates", "entities", "classes", "buckets", "sketches", "sets"}
    with pytest.raises(ZeroDivisionError), intermediates(spark):
        stored(spark.range(3), "gone")
        assert "gone" in names()
        raise ZeroDivisionError
    assert "gone" not in names()


def test_texts_without_letters_go_and_columns_stay_those_of_documents(spark):
    """Odd rows through the first four stages: null and empty texts, no letter, no id, further columns."""
    texts = [None, "", "12 34 !?", "Some plain words of prose in here", "другие слова этого языка", "mail anna.smith@example.org about it", "no id but words"]
    rows = [(None if t == texts[-1] else i, t, "en" if i % 2 else None, None, None, "k", 1) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keys string, node long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert sorted(docs.toPandas().text) == sorted(t for t in texts * 2 if t and any(c.isalpha() for c in t))
    got = docs.toPandas()
    assert set(got.doc_id.dropna()) == {3, 4, 5} and got.doc_id.isna().any()
    assert not any("anna.smith" in t for t in got.text)


def test_identical_rows_and_an_empty_table(spark, tmp_path):
    """Rows that share id and text pass all stages; of an empty table nothing comes out."""
    line = "This very line stands in many documents of the corpus."
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, f"{line}\n{words} one"), (1, f"{line}\n{words} one"), (2, f"{line}\n{words[::-1]} two"), (3, f"{line}\nthree lines of it are here"), (None, "no id but words")]
    made = [(i, t, "en", None, None) for i, t in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/some/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").toPandas()
    assert set(got.doc_id.dropna()) == {1, 2, 3}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
