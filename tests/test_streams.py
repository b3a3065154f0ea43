"""Streams run as streams: in several batches, restarted, against tables and plain Python."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone

import pytest

from palimpsest import queries as library
from palimpsest.streaming import profiles, search

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def plain_updates(rows: list[tuple], half_life: float, least: float) -> list[tuple]:
    out, users = [], {r[0] for r in rows}
    for user in users:
        profile: dict = {}
        for at in sorted({r[1] for r in rows if r[0] == user}):
            new: dict = {}
            for u, t, name, value, c in rows:
                if (u, t) == (user, at) and (name not in new or (-c, value) < (-new[name][1], new[name][0])):
                    new[name] = (value, c)
            for name in list(profile):
                v, c, t = profile[name]
                if at > t:
                    c = c * math.pow(0.5, (at - t) / timedelta(days=1) / half_life)
                    if c < least:
                        del profile[name]
                        continue
                    profile[name] = (v, round(c, 4), t)
            for name, (v, c) in new.items():
                if name not in profile:
                    profile[name] = (v, c, at)
                elif c > profile[name][1] + 0.2:
                    profile[name] = (v, round(min(0.95, c + 0.05), 4), at)
                else:
                    profile[name] = (v if c > profile[name][1] else profile[name][0], round(min(0.95, max(c, profile[name][1]) + 0.02), 4), at)
            out += [(user, at, len(new), n, v, c, t) for n, (v, c, t) in profile.items()]
    return sorted(out, key=repr)


ATTRIBUTES = "user_id string, at timestamp, name string, value string, confidence double"


def found(rows) -> list[tuple]:
    utc = lambda t: t.to_pydatetime().replace(tzinfo=timezone.utc)  # noqa: E731  (the session's zone is UTC)
    return sorted(((r.user_id, utc(r.at), r.n_new, r.name, r.value, r.confidence, utc(r.changed_at)) for r in rows), key=repr)


def attributes(rng: random.Random) -> list[tuple]:
    return [(f"u{rng.randrange(4)}", BEGIN + timedelta(days=rng.randrange(90)), rng.choice(["intent", "tone", "format"]), rng.choice("abc"), round(rng.uniform(0.2, 0.9), 2)) for _ in range(150)]


def test_profile_stream(rocks, tmp_path):
    """Three micro-batches, the query stopped and started again after each, give the rows of the table and of a loop."""
    spark, rows = rocks, attributes(random.Random(1))
    want = plain_updates(rows, 10.0, 0.15)
    table = spark.createDataFrame([*rows, (None, BEGIN, "x", "y", 0.5), ("u1", None, "x", "y", 0.5)], ATTRIBUTES)
    assert found(profiles.profile_updates(table, 10.0).toArrow().to_pandas().itertuples()) == want
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k in range(3):
        part = [r for r in rows if k * 30 <= (r[1] - BEGIN).days < k * 30 + 30]
        spark.createDataFrame(part, ATTRIBUTES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ATTRIBUTES).parquet(source)
        profiles.profile_stream(stream, 10.0).writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert found(spark.read.parquet(sink).toArrow().to_pandas().itertuples()) == want


def test_profile_query(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    days: dict = {}
    for u, t, kind in zip(e.user_id, e.ts, e.event_type):
        day = days.setdefault((str(u), datetime(t.year, t.month, t.day, tzinfo=timezone.utc)), {})
        day[kind] = day.get(kind, 0) + 1
    rows = []
    for (u, at), n in days.items():
        most, kind = max((c, k) for k, c in n.items())
        rows.append((u, at, "prefers", kind, round(min(0.95, most / max(sum(n.values()) * 0.6, 1)), 3)))
    got = library.QUERIES["f02_profile_updates"](spark, sf).toArrow().to_pandas().itertuples()
    assert found(got) == plain_updates(rows, 7.0, 0.15)


def test_search_stream(spark, tmp_path):
    """Texts and queries as streams: pairs of the window once each; a row behind the watermark finds nothing."""
    docs = [(1, 0, "Alpha beta"), (2, 30, "beta gamma"), (3, 65, "GAMMA"), (4, 100, "alpha"), (5, 400, "alpha late")]
    asked = [("a", 40, "alpha gamma"), ("b", 80, "beta"), ("c", 100, "ALPHA"), ("d", 401, "alpha")]
    want = {("a", 1), ("a", 2), ("b", 2), ("c", 4), ("d", 5)}
    at = lambda s: BEGIN + timedelta(seconds=s)
    frames = {"docs": ("id long, ts timestamp, text string", [(i, at(s), t) for i, s, t in docs]), "asked": ("query_id string, ts timestamp, query string", [(i, at(s), t) for i, s, t in asked])}
    tables = {n: spark.createDataFrame(rows, shape) for n, (shape, rows) in frames.items()}
    assert {(r.query_id, r.id) for r in search.window_search(tables["docs"], tables["asked"]).collect()} == want
    assert [r.id for r in search.window_search(tables["docs"], tables["asked"], limit=1).where("query_id = 'a'").collect()] == [1]

    def more(name, rows):
        spark.createDataFrame(rows, frames[name][0]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        d, q = (spark.readStream.schema(frames[n][0]).parquet(str(tmp_path / n)) for n in ("docs", "asked"))
        out = search.window_search(d, q).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))
        out.trigger(availableNow=True).start().awaitTermination()

    for begin, end in ((0, 70), (70, 300), (300, 500)):
        for name in frames:
            more(name, [r for r in frames[name][1] if at(begin) <= r[1] < at(end)])
        run()
    more("docs", [(6, at(20), "alpha")])
    more("asked", [("late", at(21), "alpha")])
    run()
    got = [(r.query_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("rows_a_batch", [7, 10_000])
def test_first_of_windows(spark, rows_a_batch):
    """A limit takes the same first texts as all pairs, without making the pairs: ties, repeats, nulls, windows over many cells."""
    draw = random.Random(5)
    at = lambda: BEGIN + timedelta(seconds=draw.randrange(0, 2000), microseconds=draw.choice([0, 1]))
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [(draw.choice([None, *range(80)]), at() if draw.random() < 0.97 else None, " ".join(draw.sample(words, 2))) for _ in range(400)]
    texts += texts[:40]
    asked = [(draw.choice([None, *"abcdefghijklmnop"]), at(), " ".join(draw.sample([*words, "none"], 2))) for _ in range(60)]
    docs = spark.createDataFrame(texts, "id long, ts timestamp, text string")
    queries = spark.createDataFrame(asked, "query_id string, ts timestamp, query string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, rows_a_batch)
    try:
        for width, span in (("60 seconds", 60), ("1 day", 86400), ("0 seconds", 0)):
            found = search.window_search(docs, queries, width, limit=3)
            assert ("Join" in found._jdf.queryExecution().executedPlan().toString()) == (span == 0)
            want = []
            for q in {a[0] for a in asked}:
                pairs = {(i, t, s) for n, s, query in asked if n == q for i, t, text in texts if t and s - timedelta(seconds=span) <= t <= s and set(text.split()) & set(query.split())}
                want += [(q, p[0]) for p in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))[:3]]
            assert sorted(((r.query_id, r.id) for r in found.collect()), key=repr) == sorted(want, key=repr), width
    finally:
        spark.conf.unset(key)
