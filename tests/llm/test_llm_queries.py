"""The ten operators' queries on a whole small table against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_op1(spark, sf, docs):
    got = Q.op1_sharding(spark, sf).toPandas().sort_values("doc_id")
    want = docs.sort_values("doc_id")
    assert got.doc_id.tolist() == want.doc_id.tolist()
    assert got.text_sha256.tolist() == [sha(t or "") for t in want.text]


def base_statistics(text: str) -> tuple:
    w = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_op2(spark, sf, docs):
    got = Q.op2_robust_outliers(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for d, t in zip(docs.doc_id, docs.text):
        want, r = base_statistics(t), got.loc[d]
        assert tuple(r[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert got.kept.sum() > 0.5 * (~got.base_failed).sum()


def components(docs) -> dict[int, tuple[int, int]]:
    sets = {}
    for d, t in zip(docs.doc_id, docs.text):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    where, parent = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            where[x].append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets.items():
        common = Counter(b for x in s for b in where[x] if b > a)
        for b, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_op3(spark, sf, docs):
    got = Q.op3_ngram_jaccard(spark, sf).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == components(docs)


def test_op4(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op4_toxicity(spark, sf).toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in got.held_out.items())
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().set_index("doc_id").toxic
    both = got[got.held_out].join(labels, how="inner")
    assert (both.predicted == both.toxic).mean() >= 0.9


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
BASE = [("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def test_op5(spark, sf, docs):
    got = Q.op5_secret_scan(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for d, t in zip(docs.doc_id, docs.text):
        spans = [(m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(BASE) for m in p.finditer(t or "") if len(m[g]) >= n]
        r = got.loc[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        joined = [f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(spans)]
        assert r.base_sha256 == sha(",".join(joined))
        assert set(joined) <= set(r.spans.split(",")) | {""}


def cut(docs, width=20) -> dict:
    first, out = {}, {}
    rows = sorted(zip(docs.doc_id, docs.text), key=lambda x: x[0])
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), (d, i)) != (d, i):
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_op6(spark, sf, docs):
    got = Q.op6_substring_dedup(spark, sf).toPandas()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()} == cut(docs)


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check_pieces(got: pd.DataFrame, texts: dict):
    encode = tokenizer("byte_bpe_50k.json")
    assert (got.offset == 0).all() and got.sequence_id.is_unique
    assert all(n & (n - 1) == 0 and n <= 1024 for n in got.length)
    groups = dict(list(got.sort_values("start").groupby("doc_id")))
    assert set(groups) == set(texts)
    for d, t in texts.items():
        ids, at = encode(t or "") + [0], 0
        for r in groups[d].itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


def test_op7(spark, sf, docs):
    check_pieces(Q.op7_packing(spark, sf).toPandas(), dict(zip(docs.doc_id, docs.text)))


def test_op8(spark, sf):
    got = Q.op8_chat_format(spark, sf).toPandas().set_index("conv_id")
    rows = pq.read_table(f"{sf}/conversations.parquet").to_pandas().sort_values(["conv_id", "turn"])
    chats = {c: list(zip(g.role, g.text.fillna(""))) for c, g in rows.groupby("conv_id")}
    chats[-1] = [("user", Q.FORGED), ("assistant", Q.FORGED)]
    assert set(got.index) == set(chats)
    for c, turns in chats.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got.loc[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{t}\n" for a, t in turns))
        assert r.loss_chars == len(loss) and r.loss_sha256 == sha(loss)


def test_op9(spark, sf, docs):
    got = Q.op9_token_files(spark, sf).toPandas().sort_values("doc_id")
    encode, at = tokenizer("word_bpe_49k.json"), 0
    for r, t in zip(got.itertuples(), docs.sort_values("doc_id").text, strict=True):
        ids = encode(t or "") + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op10(spark, sf, docs):
    """Documents that hold a whole item are found; documents without a shared phrase are not."""
    got = set(Q.op10_template_decontamination(spark, sf).toPandas().doc_id)
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pandas()
    low = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    texts = {d: f" {low(t)} " for d, t in zip(docs.doc_id, docs.text)}
    asked = [low(t) for t in items.text]
    holds = {d for d, t in texts.items() if any(f" {a} " in t for a in asked)}
    runs = {" ".join(w[i : i + 8]) for w in map(str.split, asked) for i in range(len(w) - 7)}
    near = {d for d, t in texts.items() if any(f" {x} " in t for x in runs)}
    assert holds <= got
    assert len(got - near) <= 0.01 * len(docs)


def test_pipeline(spark, sf, docs):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline as P

    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        after = P.written(stage(spark, now, sf), name)
        assert after.columns == now.columns
        seen.append((now, after))
        now = after
    before, after = (f.toPandas() for f in seen[1])
    assert set(after.doc_id) == {c for _, c in components(before).values()}
    before, after = (f.toPandas() for f in seen[2])
    assert len(before) > len(after) > 0.8 * len(before)
    after = seen[3][1].toPandas()
    assert set(after.doc_id) == set(seen[3][0].toPandas().doc_id)
    for t in after.text:
        assert not any(len(m[g]) >= n for _, p, g, n in BASE for m in p.finditer(t or ""))
    assert [len(t) for t in after.text.fillna("")] == after.n_chars.tolist()
    check_pieces(P.run(spark, sf).toPandas(), dict(zip(after.doc_id, after.text)))
