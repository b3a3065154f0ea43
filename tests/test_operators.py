"""Library operators on small planted rows."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from palimpsest.operators.dedup import near_texts
from palimpsest.operators.graph import candidate_pairs, connections, running_weights
from palimpsest.operators.metrics import budget_spends, moving_success
from palimpsest.operators.retrieval import vector_matches
from palimpsest.plans.remember import statements
from palimpsest.streaming.events import token_bucket


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y)) / (math.hypot(*x) * math.hypot(*y) or 1)


def test_vectors_of_other_lengths(spark):
    """A longer vector hides none of the others; only equal lengths are compared."""
    rng = random.Random(3)
    corpus = [(k, [rng.random() for _ in range(5 if k == 7 else 3)]) for k in range(20)] + [(30, [0.0, 0.0, 0.0]), (31, None), (32, [])]
    queries = [(0, [1.0, 0.5, 0.2]), (1, [0.1] * 5), (2, [1.0, 2.0])]
    shape = "{} long, vector array<double>"
    q, c = spark.createDataFrame(queries, shape.format("query_id")), spark.createDataFrame(corpus, shape.format("id"))
    got = {(r.query_id, r.id) for r in vector_matches(q, c, 4).collect()}
    want = {(0, k) for k, _ in sorted(((k, v) for k, v in corpus if v and len(v) == 3), key=lambda r: -cosine(queries[0][1], r[1]))[:4]} | {(1, 7)}
    assert got == want
    assert {(r.query_id, r.id) for r in vector_matches(q, c, None, 0.9).collect()} == {(k, i) for k, x in queries for i, v in corpus if v and len(v) == len(x) and cosine(x, v) >= 0.9}


def test_near_texts(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.sample(words, 30)) for _ in range(4)]
    texts += [t + " more" for t in texts] + [" ".join(reversed(texts[0].split())), texts[0].upper(), "", "  ", None]
    got = near_texts(spark.createDataFrame(list(enumerate(texts)), "id long, content string"), 0.9).collect()
    sets = {k: frozenset((t or "").lower().split()) for k, t in enumerate(texts)}
    heads = {s: min(k for k in sets if sets[k] == s) for s in set(sets.values()) if s}
    want = {(heads[s], k) for k, s in sets.items() if s and heads[s] != k}
    want |= {(a, b) for a, b in itertools.combinations(sorted(heads.values()), 2) if len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_links(spark):
    """Words that very many memories hold still make a theme; a common entity comes first."""
    rows = [(k, "deep blue ocean water", [f"e{k}"], [1.0, k / 1000]) for k in range(120)] + [(200, "x y", ["e1"], [1.0, 0.0]), (201, "the of and deep blue", [], [0.0, 1.0])]
    m = spark.createDataFrame(rows, "id long, content string, entity_ids array<string>, vector array<double>")
    pairs = spark.createDataFrame([(0, 119), (1, 200), (2, 200), (3, 201)], "a long, b long")
    got = {(r.a, r.b): (r.connection_type, r.n_shared, round(r.strength, 6)) for r in connections(m, pairs).collect()}
    assert got == {(0, 119): ("thematic", 4, 0.7), (1, 200): ("compositional", 1, 0.6)}
    best = candidate_pairs(m.selectExpr("id", "vector", "entity_ids AS tags", "if(id < 60, 'a', 'b') AS memory_type"), 0.7, 5).collect()
    v, tags = {k: x for k, _, _, x in rows}, {k: set(e) for k, _, e, _ in rows}
    kind = lambda k: k < 60
    want = sorted(((round(cosine(v[a], v[b]) + 0.05 * (tags[a] != tags[b]) + 0.05 * (kind(a) != kind(b)), 9), a, b) for a, b in itertools.combinations(sorted(v), 2) if cosine(v[a], v[b]) >= 0.7), key=lambda r: (-r[0], r[1], r[2]))[:5]
    assert [(r.a, r.b) for r in best] == [(a, b) for _, a, b in want]


def test_language_of_long_turns(spark):
    """All text of all turns counts, beyond any prefix."""
    rows = [(1, 0, "user", "word " * 600 + "\u4f60\u597d" * 400), (1, 1, "user", "short turn"), (2, 0, "user", "plain words only"), (3, 0, "user", None)]
    got = {r.conv_id: r.lang for r in statements(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: "zh", 2: "en"}


def test_ordered_folds(spark):
    """Folds over many Arrow batches, a key with most rows, a null key and ties against plain Python; empty tables give no rows."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(90), k, round(rng.random() * 3, 3)) for k in range(400)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        e = spark.createDataFrame(rows, "key string, t long, id long, x double").withColumn("ts", F.timestamp_seconds("t"))
        edges = e.selectExpr("key AS source_id", "'z' AS target_id", "'r' AS relation_type", "x AS weight", "id AS seq")
        spends = e.selectExpr("key", "id AS seq", "x AS epsilon")
        ema = {r.key: r.ema for r in moving_success(e, "key").collect()}
        weights = {r.source_id: r.weight for r in running_weights(edges).collect()}
        spent = {r.seq: r.accepted for r in budget_spends(spends, 9.0).collect()}
        events = e.withColumnRenamed("id", "event_id")
        allowed = {r.event_id: r.allowed for r in token_bucket(events, 0.5, 3, "key").collect()}
        for empty in (moving_success(e.limit(0), "key"), running_weights(edges.limit(0)), budget_spends(spends.limit(0), 1.0), token_bucket(events.limit(0), 1.0, 1, "key")):
            assert empty.count() == 0
    finally:
        spark.conf.set(size, before)
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        mean, weight, used = 0.5, None, 0.0
        for _, _, k, x in sorted(own, key=lambda r: r[2]):
            weight = x if weight is None else (weight + x) / 2
            ok = used + x <= 9.0 + 1e-12
            used += x if ok else 0.0
            assert spent[k] == ok
        level, at = 3.0, None
        for _, t, k, x in sorted(own, key=lambda r: (r[1], r[2])):
            mean = 0.1 * x + 0.9 * mean
            level = min(3.0, level + (t - (t if at is None else at)) * 0.5)
            at = t
            assert allowed[k] == (level >= 1)
            level -= level >= 1
        assert math.isclose(ema[key], mean) and math.isclose(weights[key], weight)
    assert len(spent) == len(allowed) == len(rows) and len(ema) == len(weights) == 4
