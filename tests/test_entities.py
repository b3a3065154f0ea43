"""Alike names against all pairs, and the entities they resolve to."""

from __future__ import annotations

import random

import pytest

from palimpsest.operators import entities


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(before, row[j], row[j - 1])
    return row[-1]


def alike(a: str, b: str) -> bool:
    return a in b or b in a or (abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2)


def names(rng: random.Random, n: int, longest: int) -> list[str]:
    """Random names over few letters, half of them some edits away from another one; all lengths around the two methods' limits."""
    out = ["", "a", "ab", "é", "Éa", "abcabcabcabcab", "abcabcabcabcabc"]
    while len(out) < n:
        word = list(rng.choice(out)) if rng.random() < 0.6 else [rng.choice("abcdé ") for _ in range(rng.randrange(1, longest))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", "bc"])
        out.append("".join(word)[: longest + 4])
    return [x.title() if rng.random() < 0.1 else x for x in out]


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    rng = random.Random(seed)
    left, right = names(rng, 400, 20 + 10 * seed), names(rng, 500, 20 + 10 * seed)
    right += rng.sample(left, 50)
    frame = lambda x: spark.createDataFrame([(v,) for v in [*x, None]], "name string")
    got = {(r.a, r.b) for r in entities.alike_names(frame(left), frame(right)).collect()}
    want = {(a, b) for a in {x.lower() for x in left} for b in {x.lower() for x in right} if alike(a, b)}
    assert got == want


def test_resolve(spark):
    known = [("k1", "Anna Lee", [1.0, 0.0], 3, ["Ann"]), ("k2", "anna lee", [1.0, 0.0], 1, None), ("k3", "Anna Leigh", [0.9, 0.1], 2, []), ("k4", "Bert", [0.0, 1.0], 4, []), ("k5", "Anna", [0.0, 1.0], 0, [])]
    new = [("ANNA LEE", [1.0, 0.0]), ("Anna Le", [1.0, 0.1]), ("Bart", [0.0, 1.0]), ("Bart", [0.0, 1.0]), ("Bret", [1.0, 0.0]), ("Zoe", [1.0, 0.0]), (None, [1.0, 0.0])]
    k = spark.createDataFrame(known, "id string, name string, vector array<double>, position int, aliases array<string>")
    found = entities.resolve_entities(spark.createDataFrame(new, "name string, vector array<double>"), k)
    assert {r.name: (r.id, r.exact) for r in found.collect()} == {"ANNA LEE": ("k2", True), "Anna Le": ("k2", False), "Bart": ("k4", False), "Bret": (None, False), "Zoe": (None, False)}
    assert {r.id: r.aliases for r in entities.with_aliases(k, found).collect()} == {"k1": ["Ann"], "k2": ["ANNA LEE", "Anna Le"], "k3": [], "k4": ["Bart"], "k5": []}


def test_known_names_are_not_compared(spark, monkeypatch):
    """A name that is known as it is has no pairs made for it; what is found is that of all pairs."""
    rng = random.Random(5)
    known = list(dict.fromkeys(names(rng, 200, 16)))
    new = list(dict.fromkeys([*names(rng, 150, 16), *rng.sample(known, 40), "A", "b"]))
    vector = lambda x: [float(x.lower().count(c)) for c in "abcdé"]
    seen, real = [], entities._within_edits
    monkeypatch.setattr(entities, "_within_edits", lambda a, b: seen.extend(r.a for r in a.collect()) or real(a, b))
    k = spark.createDataFrame([(n, x, vector(x), n) for n, x in enumerate(known)], "id long, name string, vector array<double>, position int")
    got = {r.name: (r.id, r.exact) for r in entities.resolve_entities(spark.createDataFrame([(x, vector(x)) for x in new], "name string, vector array<double>"), k).collect()}
    low = {x.lower() for x in known}
    assert sorted(seen) == sorted({x.lower() for x in new} - low)

    def cosine(x, y):
        norm = (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
        return round(sum(p * q for p, q in zip(x, y, strict=True)) / norm, 9) if norm else 0.0

    for x in new:
        exact = [n for n, y in enumerate(known) if y.lower() == x.lower()]
        near = [n for n, y in enumerate(known) if alike(x.lower(), y.lower()) and cosine(vector(x), vector(y)) >= 0.85]
        assert got.pop(x) == (min(exact or near, default=None), bool(exact)), x
    assert not got
