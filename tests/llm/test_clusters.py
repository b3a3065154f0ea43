"""op11 against plain integer k-means, ties and odd rows included."""

from __future__ import annotations

import hashlib
import math

import oracle
import pyarrow.parquet as pq

from palimpsest.llm import queries as Q
from palimpsest.llm.centroids import cluster_vectors


def brute_force(rows: list[tuple], k: int = 40, rounds: int = 5, width: int = 64) -> list[tuple]:
    kept = []
    for i, e in rows:
        if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, tuple(math.floor(256 * float(x)) for x in e)))
    mark = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=mark)[:k]]
    square = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda v: min((square(v, c), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        members: dict[int, list] = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, vs in members.items():
            centers[n] = tuple(sum(x) // len(vs) for x in zip(*vs))
    found = [(i, *nearest(v)) for i, v in kept]
    part: dict[int, int] = {}
    for _, d, n in found:
        part[n] = part.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, n, d, part[n], sum(part.values()), sha[n]) for i, d, n in found), key=repr)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_op11(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    assert got(Q.op11_elkan_clusters(spark, sf)) == brute_force(list(zip(t["vec_id"], t["embedding"])))


def test_ties_and_odd_rows(spark):
    """Few different points on a small grid, so that most distances tie; rows to leave out; null and repeated ids."""
    rows = [(n if n % 50 else None, [float((n * 7 + j) % 3) / 256 for j in range(4)]) for n in range(1, 400)]
    rows += [(7, rows[6][1]), (1000, None), (1001, [1.0]), (1002, [1.0, None, 0.0, 0.0]), (1003, [float("nan")] * 4), (1004, [float("inf")] * 4), (1005, []), (1006, [-0.5, 1e4, -1e4, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, n int")
    for k in (1, 5, 40, 500):
        assert got(cluster_vectors(df, k=k, rounds=4, width=4)) == brute_force(rows, k, 4, 4)
    assert cluster_vectors(df.limit(0), width=4).count() == 0


def test_sql(spark, sf):
    con = oracle.connect(sf)
    assert oracle.differences(Q.op11_elkan_clusters(spark, sf), con, Q.oracle_sql()["op11_elkan_clusters"]) == ""
