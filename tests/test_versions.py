"""Line differences (J13), projections (V23) and predictions (W05) against plain Python."""

from __future__ import annotations

import random

import numpy as np

from palimpsest.operators import diffs, multimodal, prefetch


def longest_common(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_lines():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(25))] for _ in range(2))
        found = diffs.common_lines(np.array(a, np.int64), np.array(b, np.int64))
        assert len(found) == longest_common(a, b) and all(a[i] == b[k] for i, k in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_diffs(spark):
    """Patches made by Spark give the new version again and change no more lines than they must."""
    rng = random.Random(2)
    texts = ["\n".join(f"line {rng.randrange(12)}" for _ in range(rng.randrange(30))) + rng.choice(["", "\n"]) for _ in range(60)] + ["", "a", "a\n", "a\n\nb", None]
    versions = spark.createDataFrame([(k // 5, k % 5, t) for k, t in enumerate(texts)], "memory_id long, version int, content string")
    pairs = [(m, a, b) for m in range(13) for a in range(5) for b in range(5)] + [(1, 1, 9)]
    rows = diffs.version_diffs(versions, spark.createDataFrame(pairs, "memory_id long, version_a int, version_b int")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        if r.version_b == 9:
            assert r.patch is None
            continue
        old, new = (texts[5 * r.memory_id + v] or "" for v in (r.version_a, r.version_b))
        a, b = diffs.lines_of(old), diffs.lines_of(new)
        assert diffs.patched(old, r.patch) == b
        same = longest_common(a, b)
        assert (r.n_removed, r.n_added) == (len(a) - same, len(b) - same)


def test_projections(spark):
    rng = np.random.default_rng(3)
    dims = {"image": 12, "text": 5}
    rows = [(k, m, rng.standard_normal(n).tolist()) for k, (m, n) in enumerate([("image", 12), ("text", 5), ("image", 7), ("other", 10), ("other", 3)] * 4)] + [(99, "image", None)]
    got = {r.id: r.vector for r in multimodal.align(spark.createDataFrame(rows, "id long, modality string, vector array<double>"), dims, 8).collect()}
    draw = np.random.default_rng(42)
    q = {m: np.linalg.qr(draw.standard_normal((n, 8)))[0] for m, n in dims.items()}
    for k, m, v in rows:
        if v is None:
            assert got[k] is None
            continue
        want = v @ q[m] if m in dims and len(v) == dims[m] else np.array(v)
        want = np.pad(want, (0, max(0, 8 - len(want))))[:8]
        assert np.allclose(got[k], want)
    assert np.allclose(q["image"].T @ q["image"], np.eye(8))


def test_fusion_metadata(spark):
    ranked = spark.createDataFrame([("q", "image", "a", 0.9), ("q", "image", "b", 0.8), ("q", "text", "b", 0.7)], "query_id string, modality string, id string, score double")
    about = spark.createDataFrame([("b", "image", {"x": "1", "y": "1"}), ("b", "text", {"x": "2"}), ("a", "text", {"z": "0"})], "id string, modality string, metadata map<string,string>")
    got = {r.id: (round(r.score, 6), r.modality_scores, r.metadata) for r in multimodal.fuse(ranked, metadata=about).collect()}
    top = 1 / 62 + 1 / 61
    assert got == {"a": (round(1 / 61 / top, 6), {"image": 0.9}, None), "b": (1.0, {"image": 0.8, "text": 0.7}, {"x": "2", "y": "1"})}


def test_backoff(spark):
    log = [(u, t, q) for u, qs in (("u", "a b c d a b e a b c"), ("v", "x a b f")) for t, q in enumerate(qs.split())]
    table = prefetch.context_table(spark.createDataFrame(log, "user_id string, ts int, query string"))
    recent = spark.createDataFrame([(1, [" A", "b "]), (2, ["q", "d", "a", "b"]), (3, ["zz", "b"]), (4, ["b"]), (5, ["c", "d", "a", "b"])], "query_id int, queries array<string>")
    got = {}
    for r in prefetch.predict_next(table, recent).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.next_query, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, "c", 2), (2, "f", 2), (3, "e", 2)], 2: [(1, "e", 3)], 5: [(1, "e", 4)]}
