"""Planted families of half-alike and growing copies against brute force (shingles of one word)."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from palimpsest.llm.similarity import Bands, jaccard_components, shingle_sets


def brute_force(families: list[list[set]]) -> dict[int, int]:
    """doc_id -> component_id; ids count through the families."""
    found, first = {}, 0
    for sets in families:
        label = list(range(first, first + len(sets)))
        for (i, a), (j, b) in combinations(enumerate(sets), 2):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
        found |= dict(enumerate(label, first))
        first += len(sets)
    return found


def check(spark, families: list[list[set]]):
    texts = [" ".join(f"{f}w{x}" if isinstance(x, int) else x for x in sorted(s, key=str)) for f, sets in enumerate(families) for s in sets]
    got = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=1).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == brute_force(families)


def own_family(rng: random.Random) -> list[set]:
    """l links with every centre, r with l alone; what l shares with the centres and r lacks is l's component's own."""
    l = set(range(100))
    centres = [l - set(rng.sample(range(88), 4)) | {1000 + 10 * k + i for i in range(6)} for k in range(3)]
    return [*centres, l, set(range(88))]


def excluded_family(rng: random.Random, small: str) -> list[set]:
    """x and y link; each of their buckets has a third document of a size that cannot be similar to theirs."""
    bands = Bands(80)
    step = int(np.searchsorted(bands.edges, 100, side="right")) - 1
    n = int(bands.edges[step]) + 2
    words = [f"{small}{k}" for k in range(20_000)]
    h = [int(shingle_sets(pa.array([w], pa.large_string()), 1)[0][0]) for w in words]
    place = lambda k, band: (((h[k] >> 32) * 3 * int(bands.groups[band])) >> 32) // 3
    more = list(range(6))  # what y has more than x
    low, high = ({place(k, b) for k in more} for b in (step - 1, step))
    rest = range(6, len(words))
    lost = [k for k in rest if place(k, step - 1) in low][: n - int(bands.edges[step - 1])]
    x = lost + [k for k in rest if place(k, step - 1) not in low][: n - len(lost)]
    y = x + more
    large = y + [k for k in rest if place(k, step) in high and k not in set(x)][: len(y) // 3]
    return [{words[k] for k in s} for s in ([k for k in x if k not in set(lost)], large, x, y)]


def test_families(spark):
    rng = random.Random(1)
    growing = [[set(range(rng.randrange(3), n)) | {2000 + rng.randrange(9) for _ in range(4)} for n in rng.sample(range(50, 140), 10)] for _ in range(10)]
    alike = [[set(range(40)) | set(rng.sample(range(100, 130), 14)) for _ in range(12)] for _ in range(10)]
    check(spark, [own_family(rng) for _ in range(20)] + growing + alike)


def test_centre_of_another_size(spark):
    check(spark, [excluded_family(random.Random(2), f"s{k}") for k in range(3)])


def merged_family(small: str) -> list[list[str]]:
    """2 and 3 link and differ in the cells of a few groups only; 1, similar to neither, differs from both just there.

    So all signatures that 2 and 3 share have the same three members, and 1 is their centre.
    """
    bands = Bands(80)
    band = int(np.searchsorted(bands.edges, 202, side="right")) - 1
    cells = 3 * int(bands.groups[band])
    words = [f"{small}{k}" for k in range(30_000)]
    h = [int(shingle_sets(pa.array([w], pa.large_string()), 1)[0][0]) for w in words]
    at = lambda k: ((h[k] >> 32) * cells) >> 32
    chosen = {3 * g for g in range(12)}
    inside = [k for k in range(len(words)) if at(k) in chosen]
    rest = [k for k in range(len(words)) if at(k) not in chosen][:162]
    tail = [next(k for k in inside if at(k) == c) for c in sorted(chosen)]
    others = [k for k in inside if k not in set(tail)]
    tail += others[:6]
    head, more = others[6:46], others[46:103]
    return [{words[k] for k in s} for s in (rest + more, head + rest + tail, head + rest)]


def test_merged_signatures(spark):
    """Signatures of equal members are one bucket, but as many signatures, when the largest are left out."""
    families = [merged_family(f"m{k}") for k in range(3)]
    assert [len(s) for s in families[0]] == [219, 220, 202]
    check(spark, families)
