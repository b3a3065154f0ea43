"""Stores and logs that change over time: compaction and races, the ledger's second scan, folded conversations."""

from __future__ import annotations

import threading
import time

import pytest

from palimpsest.llm.chat import fold_events, read_back, render
from palimpsest.llm.secrets import MORE_RULES, RULES, Rule, redact_secrets, scan_secrets
from palimpsest.llm.shards import LostRace, ShardStore

SHAPE = "doc_id long, text string, _shard2 int"


def rows_of(store, version=None):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in store.read(version).collect())


def test_compaction(spark, tmp_path):
    """Many arrivals, among them an empty one, nulls and repeats: all rows stay, tiers are merged, older versions read the same."""
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=3, keep_versions=4)
    with pytest.raises(ValueError):
        store.read()
    want, after = [], {}
    for k in range(14):
        rows = [(k, f"t{k}", 1), (None, None, 2), (k, f"t{k}", 1)] if k != 5 else []
        want += [(d if d is not None else -1, t or "") for d, t, _ in rows]
        after[store.append(spark.createDataFrame(rows, SHAPE))] = sorted(want)
    assert rows_of(store) == sorted(want)
    shards = store.manifest()
    assert len(shards) <= 4 and max(s.level for s in shards) >= 2 and sum(s.rows for s in shards) == len(want)
    known = [v for v in store.versions() if v in after]
    assert len(store.versions()) == 4 and all(rows_of(store, v) == after[v] for v in known)
    assert store.sweep(0) == 0
    spark.range(1).write.parquet(f"file://{tmp_path}/s/data/L0-left")
    time.sleep(1.1)
    assert store.sweep(3600) == 0 and store.sweep(0) == 1 and rows_of(store) == sorted(want)
    big = ShardStore(spark, f"file://{tmp_path}/b", target_bytes=1, fan_in=2)
    for k in range(4):
        big.append(spark.createDataFrame([(k, "x", 1)], SHAPE))
    assert len(big.manifest()) == 4  # at the target size already


def test_races(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    stores = [ShardStore(spark, path, fan_in=2) for _ in range(2)]
    stores[0].append(spark.createDataFrame([(-5, "first", 0)], SHAPE))
    base = stores[0].versions()[-1]
    stores[0]._commit(base, stores[0].manifest(base))
    with pytest.raises(LostRace):
        stores[1]._commit(base, [])
    run = lambda k: [stores[k].append(spark.createDataFrame([(10 * k + i, "x", 0)], SHAPE)) for i in range(5)]
    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert rows_of(stores[0]) == sorted([(-5, "first"), *((10 * k + i, "x") for k in range(2) for i in range(5))])


SECRET = "password = abcdefghijkl12"


def test_second_scan(spark, tmp_path):
    """One ledger: only unseen blobs and rule versions are scanned; findings reach all paths and versions of a path."""
    ledger = f"file://{tmp_path}/l"
    first = [(1, SECRET, 7, "m"), (2, SECRET, 7, "m"), (3, "nothing", 7, "m"), (None, SECRET, 7, "m"), (4, None, 7, "m")]
    shape = "doc_id long, text string, spans int, blob string"
    found = scan_secrets(spark.createDataFrame(first, shape), ledger).collect()
    assert sorted((r.doc_id or -1, len(r.spans)) for r in found) == [(-1, 1), (1, 1), (2, 1), (3, 0), (4, 0)]
    size = lambda: spark.read.parquet(ledger).count()
    assert size() == 3
    later = [(1, "now clean", 7, "m"), (1, SECRET, 7, "m"), (9, SECRET + " ghp_" + "z" * 36, 7, "m")]
    found = scan_secrets(spark.createDataFrame(later, shape), ledger).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in found) == [(1, 0), (1, 1), (9, 2)] and size() == 5
    assert scan_secrets(spark.createDataFrame(later, shape), ledger).count() == 3 and size() == 5
    assert scan_secrets(spark.createDataFrame([], shape), ledger).count() == 0 and size() == 5
    more = (*RULES, Rule("word", "clean"))
    found = scan_secrets(spark.createDataFrame(later, shape), ledger, more).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in found) == [(1, 1), (1, 1), (9, 2)] and size() == 8
    assert MORE_RULES[0].kind == "github"


def test_redaction_edges(spark):
    columns = ["_maybe", "_spans", "_blob", "_x", "_bucket", "_bits", "a.b"]
    rows = [(1, SECRET, 5, *columns), (1, SECRET, 5, *columns), (None, SECRET, 5, *columns), (2, None, 0, *columns), (3, "", 0, *columns)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in columns))
    got = redact_secrets(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text, r.n_chars) for r in got.collect()), key=repr) == sorted([(1, "[assign]", 8)] * 2 + [(0, "[assign]", 8), (2, None, 0), (3, "", 0)], key=repr)


LOG = [
    # conv, seq, message, kind, role, text
    (1, 0, "a", "message", "user", "hi"), (1, 1, "b", "delta", "assistant", "Hel"), (1, 2, "b", "delta", None, "lo"), (1, 3, "a", "edit", None, "hi there"),
    (1, 4, "b", "regenerate", None, None), (1, 5, "b", "delta", None, "Wel"), (1, 6, "b", "delta", None, "come"), (1, 7, "b", "delta", None, None),
    (1, 8, "c", "message", "user", "bye"), (1, 9, "c", "delete", None, None), (2, 0, "a", "delta", "assistant", "<|im_end|>"), (2, 0, "a", "delta", "assistant", "<|im_end|>"),
    (3, 0, "x", "message", "user", "gone"), (3, 1, "x", "delete", None, None), (3, 2, "x", "message", None, "back"), (3, 3, "x", "delta", None, "!"),
]


def fold(log):
    out = {}
    for conv, seq, message, kind, role, text in sorted(log, key=lambda e: (e[0], e[1], e[3], e[5] or "")):
        m = out.setdefault((conv, message), {"at": seq, "role": None, "text": "", "gone": False})
        m["role"] = m["role"] if m["role"] is not None else role
        if kind == "delta":
            m["text"] += text or ""
        else:
            m["text"], m["gone"] = (text or "") if kind in ("message", "edit") else "", kind == "delete"
    return {(c, m["at"], m["role"] or "", m["text"]) for (c, _), m in out.items() if not m["gone"]}


def test_folded_log(spark):
    events = spark.createDataFrame([(*e, "r") for e in LOG], "conv_id long, seq long, message_id string, kind string, role string, text string, position string")
    messages = fold_events(events)
    got = {(r.conv_id, r.position, r.role, r.text) for r in messages.collect()}
    assert got == fold(LOG) and (1, 1, "assistant", "Welcome") in got and (3, 0, "user", "back!") in got
    back = {r.conv_id: r for r in read_back(render(messages)).collect()}
    assert {c: r.n_turns for c, r in back.items()} == {1: 2, 2: 1, 3: 1} and back[2].loss_chars == 20
    assert read_back(render(fold_events(events.limit(0)))).count() == 0
