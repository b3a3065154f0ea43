"""Similar pairs over cells, and decisions in order (C01, C06, C10, J05), against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from palimpsest import queries as library
from palimpsest.operators import cells, graph, ordered, retrieval


def cosine(x, y) -> float:
    n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
    return round(sum(a * b for a, b in zip(x, y)) / n, 9) if n else -1.0


def vectors(rng: random.Random, n: int, dim: int = 4, groups: int = 6) -> list[list[float]]:
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    out = [[x + rng.gauss(0, 0.35) for x in rng.choice(centres)] for _ in range(n)]
    for _ in range(n // 8):
        out[rng.randrange(n)] = list(out[rng.randrange(n)])
    out[0] = [0.0] * dim
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id string, created_at long, vector array<double>")


def rows_of(rng: random.Random, n: int) -> list[tuple]:
    users = ["a"] * (n // 2) + ["b"] * (n // 3) + [None] * (n - n // 2 - n // 3)
    return [(k, u, rng.randrange(n), v) for k, (u, v) in enumerate(zip(users, vectors(rng, n)))]


@pytest.mark.parametrize("block", [7, 2048])
def test_pairs(spark, block):
    rows = rows_of(random.Random(block), 240) + [(900, "a", 1, None), (901, "a", 1, [1.0, 2.0]), (902, "a", 1, [2.0, 4.0])]
    for least in (0.3, 0.9):
        found = cells.Cells(frame(spark, rows), by="user_id", block=block).pairs(least).collect()
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[3] and b[3] and len(a[3]) == len(b[3]) and cosine(a[3], b[3]) >= least}
        assert len(found) == len(want) and {(r.a, r.b) for r in found} == want


def test_pruning(spark):
    """Tight clusters: few of all pairs are compared, none is lost."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.standard_normal((3000, 16))
    made = cells.Cells(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>"), block=200, per_block=4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.triu(u @ u.T >= 0.95, 1).sum()
    assert made.pairs(0.95).count() == want
    assert made.share_compared(0.95) < 0.25


def test_candidate_pairs(spark):
    rng = random.Random(9)
    rows = [(k, v, [rng.choice("xyz") for _ in range(rng.randrange(3))] if k % 9 else None, rng.choice(["s", "t"])) for k, v in enumerate(vectors(rng, 150))]
    df = spark.createDataFrame(rows, "id long, vector array<double>, tags array<string>, memory_type string")
    want = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and cosine(a[1], b[1]) >= 0.7:
                tags = [None if t is None else set(t) for t in (a[2], b[2])]
                want.append((-round(cosine(a[1], b[1]) + 0.05 * (tags[0] != tags[1]) + 0.05 * (a[3] != b[3]), 7), a[0], b[0]))
    got = [(-round(r.score, 7), r.a, r.b) for r in graph.candidate_pairs(df).collect()]
    assert [g[0] for g in got] == [w[0] for w in sorted(want)[:50]] and set(got) <= set(want)


def plain_groups(rows: list[tuple], least: float) -> dict:
    out = {}
    for user in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == user and r[3]), key=lambda r: (r[2], r[0]))
        seen: set = set()
        for i, first in enumerate(own):
            if first[0] in seen:
                continue
            group = [first]
            for r in own[i + 1 :]:
                if r[0] not in seen and r[0] != first[0] and any(cosine(r[3], g[3]) >= least for g in group):
                    group.append(r)
            for g in group:
                seen.add(g[0])
                out[g[0]] = first[0]
    return out


def plain_clusters(rows: list[tuple], least: float, largest: int, smallest: int) -> dict:
    out = {}
    for user in {r[1] for r in rows}:
        left = sorted((r for r in rows if r[1] == user and r[3]), key=lambda r: (r[2], r[0]))
        while left:
            seed, rest = left[0], []
            cluster = [seed]
            for r in left[1:]:
                if len(cluster) < largest and cosine(seed[3], r[3]) >= least:
                    cluster.append(r)
                else:
                    rest.append(r)
            left = rest
            for r in cluster:
                out[r[0]] = seed[0] if len(cluster) >= smallest else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_groups_and_clusters(spark, seed):
    """Random orders with ties, repeats and null users; several ranges, so that rows wait for other ranges."""
    rng = random.Random(seed)
    rows = rows_of(rng, 120)
    least = rng.choice([0.5, 0.8, 0.9])
    got = {r.id: r.group for r in ordered.greedy_groups(frame(spark, rows), least, parts=5).collect()}
    assert got == plain_groups(rows, least)
    got = {r.id: r.cluster for r in ordered.seed_clusters(frame(spark, rows), least, 4, 2, key="user_id", parts=5).collect()}
    assert got == plain_clusters(rows, least, 4, 2)


def test_order_decides(spark):
    """Similar to a later member only: no group of three."""
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = [(0, "u", 0, angle(0)), (1, "u", 1, angle(40)), (2, "u", 2, angle(20)), (3, "v", 0, angle(0))]
    got = {r.id: r.group for r in ordered.greedy_groups(frame(spark, rows), 0.9).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3} == plain_groups(rows, 0.9)


def test_long_chain(spark):
    """2,000 vectors along an arc, each similar only to its neighbours, in a key that holds all rows."""
    rows = [(k, "u", k, [math.cos(k * 0.003), math.sin(k * 0.003)]) for k in range(2000)]
    got = {r.group for r in ordered.greedy_groups(frame(spark, rows), math.cos(0.0035), parts=8).collect()}
    assert got == {0}


def jaccard(a: str, b: str) -> float:
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    return 1.0 if not x | y else len(x & y) / len(x | y)


def plain_merge(new: list[tuple], old: list[tuple], least: float) -> dict:
    """Rows: id, content, tags, importance, access_count, created_at, is_active."""
    entries = [dict(id=r[0], content=r[1], row=r[0], tags=set(r[2] or ()), importance=r[3], count=r[4]) for r in sorted(old, key=lambda r: (r[5], r[0])) if r[6]]
    out = {}
    for r in sorted(new, key=lambda r: (r[5], r[0])):
        hit = next((e for e in entries if jaccard(r[1], e["content"]) >= least), None)
        e = dict(id=r[0], content=r[1], row=r[0], tags=set(r[2] or ()), importance=r[3], count=r[4])
        if hit:
            own = len(r[1] or "") >= len(hit["content"] or "")
            e = dict(id=hit["id"], content=r[1] if own else hit["content"], row=r[0] if own else hit["row"], tags=e["tags"] | hit["tags"], importance=max(r[3], hit["importance"]), count=hit["count"] + 1)
        entries.append(e)
        out[r[0]] = (hit is not None, hit and hit["id"], e["row"], sorted(e["tags"]), e["importance"], e["count"])
    return out


MEMORY = "id long, content string, tags array<string>, importance double, access_count long, created_at long, is_active boolean"


def merge_result(spark, new, old, least, parts):
    found = ordered.merge_batch(spark.createDataFrame(new, MEMORY), spark.createDataFrame(old, MEMORY), least, parts)
    return {r.id: (r.merged, r.into, r.content_id, r.tags, r.importance, r.access_count) for r in found.collect()}


def planted(rng: random.Random, n: int, first: int) -> list[tuple]:
    """Families of growing and shrinking texts, repeats with other white space, empty and null texts."""
    out = []
    for k in range(first, first + n):
        f, size = rng.randrange(4), rng.randrange(6, 14)
        words = [f"{f}w{j}" for j in range(size)]
        if rng.random() < 0.3:
            words[rng.randrange(size)] = f"x{rng.randrange(3)}"
        text = rng.choice([" ", "  "]).join(words) if rng.random() < 0.93 else rng.choice(["", None, " "])
        out.append((k, text, [f"t{rng.randrange(4)}"] if rng.random() < 0.8 else None, rng.random(), rng.randrange(5), rng.randrange(n), rng.random() < 0.9))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge(spark, seed):
    rng = random.Random(seed)
    old, new = planted(rng, 12 if seed else 1, 0), planted(rng, 90, 1000)
    least = rng.choice([0.6, 0.75, 0.9])
    assert merge_result(spark, new, old, least, 5) == plain_merge(new, old, least)


def test_merge_chain(spark):
    """Each text is like the one before it only, longer and shorter in turns; exact ties of length."""
    new = [(k, " ".join(f"c{j:04d}" + ("x" * 9 if k % 3 == 1 and j == k else "") for j in range(k, k + 12)), [f"t{k % 5}"], 0.1, 0, k, True) for k in range(400)]
    assert merge_result(spark, new, [(9999, "other", [], 0.0, 0, 0, True)], 0.8, 6) == plain_merge(new, [(9999, "other", [], 0.0, 0, 0, True)], 0.8)


def test_queries(spark, sf):
    m = library.memories(spark, sf).select("id", "content", "tags", "importance", "access_count", "created_at").collect()
    new, old = ([(*r, True) for r in m if r.id % 2 == k] for k in (1, 0))
    got = {r.id: (r.merged, r.into, r.content_id, r.tags, r.importance, r.access_count) for r in library.QUERIES["c06_merge_batch"](spark, sf).collect()}
    assert got == plain_merge(new, old, 0.9)
    rows = [(r.id, r.user_id, r.created_at, list(r.vector)) for r in library._user_vectors(spark, sf).collect()]
    got = {r.id: r.cluster for r in library.QUERIES["c10_seed_clusters"](spark, sf).collect()}
    assert got == plain_clusters(rows, 0.4, 10, 2)


def test_query_blocks(spark, monkeypatch):
    """Queries in several blocks, the corpus in several slices: as in one block and as in a loop; owners and lengths apart."""
    rng = random.Random(6)
    corpus = [(k, v, rng.choice("xy")) for k, v in enumerate(vectors(rng, 150))] + [(500, [1.0, 2.0], "x"), (501, None, "x")]
    asked = [(f"q{k}", v, rng.choice(["x", None])) for k, v in enumerate(vectors(rng, 40))] + [("short", [2.0, 1.0], None), ("none", None, None)]
    q = spark.createDataFrame(asked, "query_id string, vector array<double>, owner_id string")
    c = spark.createDataFrame(corpus, "id long, vector array<double>, owner_id string")
    want = {}
    for name, x, o in asked:
        near = sorted((-(cosine(x, v) if any(x) and any(v) else 0.0), k) for k, v, w in corpus if x and v and len(x) == len(v) and o in (None, w))
        want[name] = [k for _, k in near[:5]]
    for block, size in ((2048, 200_000), (7, 20)):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        monkeypatch.setattr(retrieval, "SLICE", size)
        got = {}
        for r in retrieval.vector_matches(q, c, 5, by="owner_id").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {k: v for k, v in want.items() if v}
    assert retrieval.vector_matches(q.limit(0), c, 5).columns == ["query_id", "id", "score", "rank"]


def test_merge_reads_texts_once(spark, monkeypatch):
    """Rows are numbered, marked and merged without their texts; classes whose smallest id is not their first row."""
    kept, stored = [], ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    rng = random.Random(12)
    old, new = [(2000 - r[0], *r[1:]) for r in planted(rng, 10, 1500)], planted(rng, 60, 0)
    found = ordered.merge_batch(spark.createDataFrame(new, MEMORY), spark.createDataFrame(old, MEMORY), 0.75, 1)
    got = {r.id: (r.merged, r.into, r.content_id, r.tags, r.importance, r.access_count) for r in found.collect()}
    assert got == plain_merge(new, old, 0.75)
    assert not any({"content", "w"} & set(df.columns) for df in kept)
