"""Python workers of the pipeline's steps give unused Arrow memory back, and hold no batch by then."""

from __future__ import annotations

import pyarrow as pa
import pytest

import public_tokenizers
from palimpsest.llm import packing, shared, similarity, toxicity


class Pool:
    """Notes the bytes that are still in use at each release."""

    def __init__(self):
        self.held: list[int] = []

    def release_unused(self) -> None:
        self.held.append(pa.total_allocated_bytes())


def batches(n: int):
    for k in range(n):
        ids = list(range(100 * k, 100 * k + 100))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([f"word{i} and " * 500 for i in ids])})


@pytest.mark.parametrize("step", ["packing", "signatures"])
def test_nothing_is_kept(spark, monkeypatch, step):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    runs, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *args, **named: runs.append(run) or real(self, run, *args, **named))
    if step == "packing":
        packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).schema
    else:
        similarity.jaccard_components(docs)
    for _ in runs[0](batches(1)):  # what a worker keeps on purpose is loaded
        pass
    pool = Pool()
    monkeypatch.setattr(shared.pa, "default_memory_pool", lambda: pool)
    before = pa.total_allocated_bytes()
    rows = sum(x.num_rows for x in runs[0](batches(3)))
    assert rows > 300
    assert len(pool.held) == 4
    assert pool.held[-1] - before < 1 << 18 < max(pool.held) - before


def test_scores_in_batches(spark):
    lexicon = toxicity.Lexicon({" bad": 3.0})
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["bad", None, "", "a badly put word", "fine"] * 40)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in rows.repartition(3).select("doc_id", toxicity.toxicity(lexicon).alias("score")).collect()}
    assert got == {k: pytest.approx(lexicon.score(t or "")) for k, t in enumerate(["bad", None, "", "a badly put word", "fine"] * 40)}
