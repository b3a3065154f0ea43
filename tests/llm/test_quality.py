"""The verdict of the robust outliers against plain numpy over each group's rows."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from palimpsest.llm import quality
from palimpsest.llm.quality import CHI2_CUT, CHI2_MEDIAN, FLOORS, robust_outliers

FLOOR = np.diag(np.square(FLOORS))


def rank(values: np.ndarray, share: float) -> float:
    return float(np.sort(values)[max(math.ceil(share * len(values)) - 1, 0)])


def distances(x: np.ndarray, center: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    gap = x - center
    return np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter), gap)


def c_step(x: np.ndarray, center: np.ndarray, scatter: np.ndarray, share: float = 0.75):
    d2 = distances(x, center, scatter)
    near = x[d2 <= rank(d2, share)]
    return near.mean(0), np.cov(near.T, bias=True) + FLOOR


def verdict(x: np.ndarray) -> np.ndarray:
    middle = np.array([rank(c, 0.5) for c in x.T])
    scale = 1.4826 * np.array([rank(abs(c - m), 0.5) for c, m in zip(x.T, middle)])
    z = (x - middle) / np.sqrt(scale**2 + np.square(FLOORS))
    signs = z / np.sqrt(np.maximum((z * z).sum(1, keepdims=True), 1e-12))
    found = []
    for y in (None, np.tanh(z), signs):
        alike = np.eye(5)
        if y is not None:
            second = y.T @ y
            size = np.sqrt(np.maximum(np.diag(second), 1e-12))
            alike = second / np.outer(size, size)
            np.fill_diagonal(alike, 1)
        estimate = middle, np.outer(scale, scale) * alike + FLOOR
        for _ in range(2):
            estimate = c_step(x, *estimate)
        found.append(estimate)
    best = min(found, key=lambda e: np.linalg.det(e[1]))
    for _ in range(3):
        best = c_step(x, *best)
    d2 = distances(x, *best)
    return d2 / max(rank(d2, 0.5) / CHI2_MEDIAN, 1.0) <= CHI2_CUT


@pytest.mark.parametrize("most_groups", [quality.BROADCAST_GROUPS, 0])
def test_verdict(spark, monkeypatch, most_groups):
    """Both ways of joining; groups of 50 rows and more, pooled ones, and one too small for any estimate."""
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", most_groups)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    few = [(-1 - k, " ".join(f"w{j}" for j in range(30 + k)), "xx", f"s{k}") for k in range(5)]
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(few, "doc_id long, text string, lang string, source string"))
    got = robust_outliers(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    groups = defaultdict(list)
    for r in got:
        if not r.base_failed:
            groups[r.lang or "", r.source or ""].append(r)
    final = defaultdict(list)
    for (lang, source), rows in groups.items():
        final[lang, source if len(rows) >= 50 else None] += rows
    tested = 0
    for rows in final.values():
        if len(rows) < 50:
            assert all(r.kept and r.distance is None for r in rows)
            continue
        n = np.array([[r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in rows], float).T
        x = np.array([np.log1p(n[0]), np.log((n[1] + 1) / n[0]), np.log1p(4 * n[2] / n[0]), np.log1p(n[3]), n[4] / n[0]]).T
        assert [r.kept for r in rows] == verdict(x).tolist()
        tested += 1
    assert tested >= 2 and len(final) > tested
