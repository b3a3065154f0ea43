"""Profiles, query rewriting, writes and reruns (A19-A23, C08, C13, C14, F05, H13, T34, T35, V18, V22) against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import inference, writing
from palimpsest.plans import recall, rewriting

START = datetime(2024, 1, 1)
MEMORY = "user_id string, id string, created_at timestamp, content string"


def texts(rng: random.Random, words: list[str]) -> str | None:
    return None if rng.random() < 0.05 else " ".join(rng.choice([*words, "lorem", "ipsum?", "dolor"]) for _ in range(rng.randrange(12)))


def counted(rows: list[tuple], table: dict[str, list[str]]) -> list[tuple[str, int]]:
    """(category, hits), most frequent first, then by first meeting."""
    hits: dict[str, int] = {}
    for _, _, _, text in sorted(rows, key=lambda r: (r[2], r[1])):
        for category, words in table.items():
            if n := sum(w in (text or "").lower() for w in words):
                hits[category] = hits.get(category, 0) + n
    return sorted(hits.items(), key=lambda x: -x[1])


def near(a: float, b: float) -> bool:
    return abs(a - b) <= 0.00051  # a third place, ties of rounding either way


@pytest.fixture(scope="module")
def users():
    rng = random.Random(5)
    tables = [inference.INTENTS, *inference.PREFERENCES.values(), inference.KNOWLEDGE, inference.LEVELS, inference.STYLES]
    words = [w for t in tables for ws in t.values() for w in ws] + inference.FOLLOWING
    rows = [(f"u{u}", f"m{u}-{k}", START + timedelta(minutes=rng.randrange(5)), texts(rng, rng.sample(words, 4))) for u in range(40) for k in range(rng.randrange(1, 9))]
    return rows + [("quiet", "q1", START, None), ("quiet", "q2", START, "")]


def of_user(rows):
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return by


def test_intents_and_styles(spark, users):
    df = spark.createDataFrame(users, MEMORY)
    intents = {r.user_id: r for r in inference.intents(df).collect()}
    styles = {r.user_id: r for r in inference.interaction(df).collect()}
    levels = {r.user_id: r.level for r in inference.levels(df).collect()}
    assert set(intents) == set(styles) == set(levels) == {r[0] for r in users}
    for u, rows in of_user(users).items():
        c = counted(rows, inference.INTENTS)
        words = sorted({w for _, _, _, t in rows for ws in inference.INTENTS.values() for w in ws if w in (t or "").lower()})
        assert intents[u].category == (c[0][0] if c else "informational") and intents[u].keywords == words[:10]
        assert near(intents[u].confidence, min(0.95, c[0][1] / max(0.5 * sum(n for _, n in c), 1)) if c else 0.3)
        c = counted(rows, inference.STYLES)
        assert styles[u].communication == (c[0][0] if c else "conversational")
        assert near(styles[u].confidence, min(0.9, c[0][1] / max(0.5 * sum(n for _, n in c), 1)) if c else 0.3)
        mean = sum(len(t or "") for *_, t in rows) / len(rows)
        assert styles[u].detail_level == (0.8 if mean > 200 else 0.6 if mean > 100 else 0.4)
        assert near(styles[u].initiative, min(0.9, 0.3 + 0.3 * sum((t or "").count("?") for *_, t in rows) / len(rows)))
        assert styles[u].follow_up == (sum(w in (t or "").lower() for *_, t in rows for w in inference.FOLLOWING) >= 0.1 * len(rows))
        n = dict(counted(rows, inference.LEVELS))
        e, a, b = (n.get(k, 0) for k in ("expert", "advanced", "beginner"))
        assert levels[u] == ("expert" if e and e >= a else "advanced" if a and a >= b else "beginner" if b else "intermediate")


def test_preferences_and_knowledge(spark, users):
    df = spark.createDataFrame(users, MEMORY)
    found = {(r.user_id, r.type): r for r in inference.preferences(df).collect()}
    fields: dict[str, list] = {}
    for r in inference.knowledge(df).orderBy("rank").collect():
        fields.setdefault(r.user_id, []).append(r)
    n = 0
    for u, rows in of_user(users).items():
        for kind, table in inference.PREFERENCES.items():
            c = counted(rows, table)
            assert ((u, kind) in found) == bool(c)
            if c:
                n += 1
                r = found[u, kind]
                ids = sorted({i for _, i, _, t in rows if any(w in (t or "").lower() for ws in table.values() for w in ws)})
                strength = min(0.95, c[0][1] / max(0.6 * sum(k for _, k in c), 1))
                assert (r.value, r.evidence) == (c[0][0], ids[:5])
                assert near(r.strength, strength) and near(r.confidence, min(0.9, 0.4 + 0.5 * strength))
        c = counted(rows, inference.KNOWLEDGE)[:5]
        assert [r.domain for r in fields.get(u, [])] == [d for d, _ in c]
        assert all(near(r.confidence, min(0.85, 0.4 + 0.1 * k)) for r, (_, k) in zip(fields.get(u, []), c))
    assert len(found) == n > 40


def test_inference_of_nothing(spark):
    """No rows give no users; a null user is a user; repeated rows count as often as they occur."""
    empty = spark.createDataFrame([], MEMORY)
    for f in (inference.intents, inference.preferences, inference.knowledge, inference.levels, inference.interaction):
        assert f(empty).collect() == []
    df = spark.createDataFrame([(None, "a", START, "python json expert"), (None, "a", START, "python json expert")], MEMORY)
    assert [(r.type, r.value, r.evidence) for r in inference.preferences(df).orderBy("type").collect()] == [("format", "json", ["a"]), ("technology", "python", ["a"])]
    assert inference.levels(df).collect()[0].level == "expert"


def test_transferred(spark):
    prefs = spark.createDataFrame([("u", "technology", "go", 0.9, 0.8), ("v", "tone", "formal", 0.5, 0.9)], "user_id string, type string, value string, strength double, confidence double")
    domains = spark.createDataFrame([("u", "mobile", None), ("v", "mobile", ["security", "cooking"]), ("v", "cooking", None)], "user_id string, source_domain string, targets array<string>")
    got = {(r.user_id, r.name): r.confidence for r in inference.transferred(prefs, domains).collect()}
    assert got == {
        ("u", "transferred_web_development_technology"): 0.58, ("u", "transferred_security_technology"): 0.58,
        ("v", "transferred_security_tone"): 0.64, ("v", "transferred_cooking_tone"): 0.54,
    }


SUMMARY = "summary_id string, user_id string, content string, embedding array<double>, sources array<string>, mark timestamp"
ROWS = "id string, user_id string, content string, embedding array<double>, tags array<string>, is_active boolean, updated_at timestamp"


def grown(state: dict, rows: list[tuple], least: float, most: int, archive: int) -> dict:
    """One run without marks: every summary scans all rows."""
    out = {}
    for s, (user, text, v, sources) in state.items():
        scored = []
        for i, u, t, w, tags, active, _ in rows:
            if user is not None and v and u == user and active and "summary" not in (tags or []) and i not in sources and w:
                cos = sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in w) ** 0.5 or 1.0)
                if cos >= least:
                    scored.append((-round(cos, 9), i, t))
        new = sorted(scored)[:most]
        if new:
            text = f"{text} [Updated: {' | '.join((t or '')[:200] for _, _, t in new[:3])}]"
            text = text if len(text) <= 2000 else text[:1997] + "..."
        out[s] = (user, text, v, sources + [i for _, i, _ in new])
    return out


def test_grown_summaries(spark):
    """Runs with marks after batches of arrivals equal full scans; runs without arrivals drain what was left over."""
    rng = random.Random(7)
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    rows = [(f"m{k:03}", rng.choice(["a", "a", "b", None]), rng.choice([None, "x" * rng.randrange(400), "short"]), rng.choice([vector(), vector(), None]), rng.choice([[], ["summary"], None, ["t"]]), rng.random() < 0.9, START + timedelta(minutes=k // 4)) for k in range(160)]
    state = {f"s{k}": (rng.choice(["a", "b"]), "old " * rng.randrange(300), vector(), []) for k in range(6)} | {"s8": (None, "t", vector(), []), "s9": ("a", "t", None, []), "s7": ("a", "none near", [0.0] * 4, [])}
    df = spark.createDataFrame([(s, u, t, v, src, None) for s, (u, t, v, src) in state.items()], SUMMARY)
    for seen in (40, 41, 100, 160, 160, 160, 160, 160):
        got = writing.grown_summaries(df, spark.createDataFrame(rows[:seen], ROWS), least=0.5, most=4)
        df = spark.createDataFrame(writing.with_growth(df, got).collect(), SUMMARY)
        state = grown(state, rows[:seen], 0.5, 4, 30)
        assert {r.summary_id: (r.content, r.sources) for r in df.collect()} == {s: (t, src) for s, (_, t, _, src) in state.items()}
    assert writing.grown_summaries(df, spark.createDataFrame(rows, ROWS), least=0.5, most=4).count() == 0
    marks = {r.summary_id: r.mark for r in df.collect()}
    assert all(marks[s] == rows[-1][6] for s in state if s not in ("s8", "s9")) and marks["s8"] is None and marks["s9"] is None


def test_grown_summaries_archive(spark):
    df = spark.createDataFrame([("s", "a", "t", [1.0, 0.0], [], None)], SUMMARY)
    rows = spark.createDataFrame([(f"m{k}", "a", "c", [1.0, 0.1], [], True, START) for k in range(3)], ROWS)
    assert [r.archives for r in writing.grown_summaries(df, rows, archive=2).collect()] == [True]
    assert [r.archives for r in writing.grown_summaries(df, rows, archive=3).collect()] == [False]
    assert writing.grown_summaries(df, rows.limit(0)).count() == 0 == writing.grown_summaries(df.limit(0), rows).count()


def test_conflicts_and_merging(spark):
    table = spark.createDataFrame([("a", False, "b", []), ("b", True, None, ["a"]), ("c", True, None, None), ("d", False, "e", [])], "id string, is_active boolean, superseded_by string, supersedes array<string>")
    asked = spark.createDataFrame([("a", "reactivate"), ("a", "reactivate"), ("d", "delete"), ("d", "reactivate"), ("c", "other"), ("zz", "delete")], "id string, action string")
    assert {tuple(r[:3]) + (tuple(r[3]) if r[3] is not None else None,) for r in writing.resolved_conflicts(table, asked).collect()} == {("a", True, None, ()), ("b", True, None, ()), ("c", True, None, None)}
    schema = "id string, user_id string, content string, tags array<string>, importance double, embedding array<double>"
    old = spark.createDataFrame([("o1", "a", "old", ["x", "y"], 0.9, [1.0, 0.0]), ("o2", "b", "other", ["z"], 0.1, [0.0, 1.0])], schema)
    new = spark.createDataFrame([("n1", "a", "new", ["y", "w"], 0.5, [1.0, 0.1]), ("n2", "a", "far", None, 0.5, [0.0, 1.0]), ("n3", "a", "none", [], 0.5, None), ("o2", "b", "self", [], 0.5, [0.0, 1.0])], schema)
    got = {r.id: (r.content, r.tags, r.importance, r.supersedes) for r in writing.merged_writes(new, old).collect()}
    assert got == {"n1": ("old\nnew", ["x", "y", "w"], 0.9, ["o1"]), "n2": ("far", None, 0.5, []), "n3": ("none", [], 0.5, []), "o2": ("self", [], 0.5, [])}


def test_access_log(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    schema = "id string, content string, is_active boolean, importance double, access_count long, last_accessed timestamp"
    table = spark.createDataFrame([("a", "A", True, 0.97, 1, None), ("b", "B", False, 0.5, 1, None), ("c", "C", True, 0.5, None, None), ("d", "D", True, None, 2, None), ("e", "E", True, 0.1, 0, None)], schema)
    found = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.9, 2), (1, "c", 0.8, 3), (2, "c", 1.0, 1), (2, "d", 0.5, 2)], "query_id long, id string, score double, rank int")
    got = {r.id: (r.importance, r.access_count, r.last_accessed is not None) for r in recall.reinforced(table, found, now).collect()}
    assert got == {"a": (1.0, 2, True), "b": (0.5, 1, False), "c": (0.6, 2, True), "d": (None, 3, True), "e": (0.1, 0, False)}
    asked = spark.createDataFrame([(1, "one"), (2, None), (3, "none")], "query_id long, query string")
    log = {r.query_id: r for r in recall.retrieval_records(asked, found, table, now).collect()}
    assert [(log[k].retrieved_ids, log[k].retrieved_scores, log[k].composed_context) for k in (1, 2, 3)] == [(["a", "c"], [1.0, 0.8], "A\nC"), (["c", "d"], [1.0, 0.5], "C\nD"), ([], [], "")]
    assert len({r.record_id for r in log.values()}) == 3


def test_rewriting(spark):
    asked = [
        ("Compare A and B", ["Compare A and B", "compare a", "b"]),
        ("What is the difference between X and Y", ["What is the difference between X and Y", "what is the difference between x", "y", "what is X", "what is Y"]),
        ("pros and cons of tea", ["pros and cons of tea", "pros", "cons of tea", "advantages of tea", "disadvantages of tea"]),
        ("how to cut and sew", ["how to cut and sew", "how to cut", "sew", "how to sew"]),
        ("a vs b vs a", ["a vs b vs a", "a", "b"]), (" ", [" "]), ("plain", ["plain"]), (None, []), ("", [""]),
    ]
    df = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(asked)], "query_id long, query string")
    got: dict[int, list] = {}
    for r in rewriting.decomposed_queries(df).orderBy("query_id", "n").collect():
        got.setdefault(r.query_id, []).append(r.query)
    assert [got.get(k, []) for k in range(len(asked))] == [want for _, want in asked]
    context = spark.createDataFrame([("u", ["t1", None, "t2"], ["first", "Last"]), ("v", ["t"], ["SAME"]), ("w", None, [])], "user_id string, topics array<string>, recent_queries array<string>")
    queries = spark.createDataFrame([(1, "q", "u"), (2, "same", "v"), (3, "q", "w"), (4, "q", "nobody")], "query_id long, query string, user_id string")
    rows = rewriting.enriched_queries(queries, context).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "query"))).alias("r")).collect()
    assert {r.query_id: [x.query for x in r.r] for r in rows} == {1: ["q", "q t1", "q t2", "q (context: Last)"], 2: ["same", "same t"], 3: ["q"], 4: ["q"]}
