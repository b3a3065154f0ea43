"""op12: held-out accuracy, terms and votes against plain loops, odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from palimpsest.llm import neighbours as N
from palimpsest.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_op12(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op12_neighbour_quality(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == pq.read_metadata(f"{sf}/documents.parquet").num_rows
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in got.held_out.items())
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().set_index("doc_id").quality
    both = got[got.held_out].join(labels, how="inner")
    assert (both.predicted == both.quality).mean() >= 0.95
    assert both.predicted[both.quality == 1].mean() >= 0.98


def test_terms():
    """Word slots count every word of a text; the shares of form are those of plain loops."""
    texts = ["One two two. three", "", None, "A | b | c\n#x ABC! ABC! 12", " ".join(["w"] * 300), "é ü " * 5]
    rows = np.vstack([r for _, r in N.term_rows(pa.array(texts))])
    assert rows.shape == (len(texts), N.SLOTS + N.FORMS)
    for text, row in zip(texts, rows):
        w = WORD.findall(text or "")
        assert row[: N.SLOTS].sum() == len(w)
        assert sorted(row[: N.SLOTS][row[: N.SLOTS] > 0]) == sorted(Counter(w).values())
        shares = row[N.SLOTS + N.CLASSES**2 :]
        n = max(len(w), 1)
        want = [sum(x in "|#" for x in w), sum(x[:2].isupper() and x[:2].isascii() and x[:2].isalpha() and len(x) > 1 for x in w), sum(a == b for a, b in zip(w, w[1:]))]
        assert np.allclose(shares[:3] * n, want)
        assert row[N.SLOTS : N.SLOTS + N.CLASSES**2].sum() == (1 if w else 0)


def test_votes():
    """Blocked products give the votes of a loop over all points, ties included."""
    rng = np.random.default_rng(5)
    points = rng.standard_normal((50, 4))
    points[10:20] = points[10]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    axes = rng.standard_normal((N.SLOTS + N.FORMS, 4)).astype(np.float32)
    space = N.Space(np.ones(N.SLOTS + N.FORMS, np.float32), axes, points.astype(np.float32), rng.integers(0, 2, 50).astype(np.float32), 7, 12.0)
    counts = rng.integers(0, 3, (30, N.SLOTS + N.FORMS)).astype(np.float32)
    got = space.scores(counts)
    for place, score in zip(space.place(counts), got):
        near = sorted(((round(float(place @ p), 5), y) for p, y in zip(space.points, space.labels)), reverse=True)
        voters = [(s, y) for s, y in near if s >= near[6][0]]
        weights = [np.exp(12.0 * (s - near[0][0])) for s, _ in voters]
        assert abs(score - sum(w * y for w, (_, y) in zip(weights, voters)) / sum(weights)) < 1e-2


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "two words"), (5, "x" * 300_000), (6, "w " * 100_000)]
    docs = spark.createDataFrame([(*r, "a", 0.5, 1) for r in rows], "doc_id long, text string, terms string, score double, label int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (None, 1), (2, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = Q.score_quality(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert Q.score_quality(docs.limit(0), labels).count() == 0
