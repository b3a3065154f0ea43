"""Nulls, empty and long texts, repeats, empty tables and clashing column names, for the operators without such tests elsewhere."""

from __future__ import annotations

import pytest

from palimpsest.llm.quality import robust_outliers
from palimpsest.llm.similarity import jaccard_components, one_of_each_group
from palimpsest.llm.substrings import remove_repeats
from palimpsest.llm.toxicity import score_documents

LONG = " ".join(f"w{k}" for k in range(30_000))
SOME = " ".join(f"s{k}" for k in range(60))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (5, "One TWO"), (6, LONG), (7, LONG + " x"), (None, SOME), (8, SOME), (9, SOME), (10, "x" * 100_000)]
CLASH = ["_maybe", "_x", "_bucket", "_bits", "_text", "_first", "_spans", "_blob", "bucket", "doc", "component", "key", "words", "n", "group", "id", "spans"]


@pytest.fixture(scope="module")
def docs(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(d, t, None, "s", len(t or ""), *CLASH) for d, t in ROWS], shape)


def test_components(docs):
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in jaccard_components(docs).collect()}
    want = {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 29_996), (7, 6, 29_997), (None, None, None), (8, 8, 56), (9, 8, 56), (10, 10, 1)}
    assert got == want and jaccard_components(docs).count() == len(ROWS)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_one_of_each_group(docs):
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 10]


def test_repeats(docs):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(docs).where("doc_id is not null").collect())
    assert [g for g in got if g[0] != 8 and g[0] != 9] == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, 0), (5, 2, 0), (5, 2, 0), (6, 30_000, 0), (7, 30_001, 30_000), (10, 1, 0)]
    assert got[-2] == (9, 60, 60)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_outliers_and_scores(spark, docs):
    rows = robust_outliers(docs).collect()
    assert len(rows) == len(ROWS) and all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert robust_outliers(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        rows = score_documents(docs, known).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert score_documents(docs.limit(0), labels).count() == 0
