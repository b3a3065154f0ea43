"""Piecewise encoding against the plain tokenizer, packing's decomposition and the token files' layout."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm.packing import bucketed, pack, piece_lengths, write_buckets
from palimpsest.llm.tokenfiles import read_tokens, token_digest, write_tokens
from palimpsest.llm.tokens import PieceEncoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
MADE = {n: (PieceEncoder(public_tokenizers.path(n), 50), Tokenizer.from_file(public_tokenizers.path(n))) for n in NAMES}
ODD = [
    "", " ", "\n", "a", "<|endoftext|> hi", "x<|startoftext|>y <|ENDOFTEXT|>", "two  spaces", " lead", "trail ", "a\nb c\n\nd", "tab\there", "don't can't, 'tis 'S",
    "caf\u00e9 cafe\u0301 \u0301x", "\u03a3\u03a3 \u03a3.", "12,345.67%), end!", "\u4f60\u597d\u3000\u4e16\u754c", "a\u00a0b", "\U0001f600.\U0001f600", "x" * 5000, "word, " * 2000 + "end",
]


def equal(name: str, texts: list[str]):
    fast, plain = MADE[name]
    ids, sizes = fast.encode(pa.array(texts, pa.large_string()))
    parts = np.split(ids, np.cumsum(sizes)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(name):
    equal(name, ODD)
    equal(name, ["plain words only\nand a line", *ODD[::-1]])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aB1'. ,\n\u00e9\u0301<|>st"), max_size=30), min_size=1, max_size=4))
def test_any_texts(name, texts):
    equal(name, texts)


def test_piece_lengths():
    for longest in (1, 2, 8, 1024):
        totals = np.array([0, 1, 2, 7, 8, 9, 1023, 1024, 1025, 5000])
        owner, length = piece_lengths(totals, longest)
        assert np.bincount(owner, length, minlength=len(totals)).tolist() == totals.tolist()
        for k, n in enumerate(totals.tolist()):
            mine = length[owner == k].tolist()
            assert mine == [longest] * (n // longest) + [1 << b for b in range(20, -1, -1) if (n % longest) >> b & 1]


EDGE = [(2, None), (1, ""), (3, "one two three"), (3, "one two three"), (None, "no id"), (9, "w " * 60_000), (-5, "  <|endoftext|>\n")]


def edge_docs(spark):
    rows = [(d, t, "l", 1, 2, 3) for d, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, start int, ids int, tokens int")


def test_pack_edges(spark):
    got = pack(edge_docs(spark), public_tokenizers.path(NAMES[0]), 1024, 0).toPandas()
    plain = MADE[NAMES[0]][1]
    want = {}
    for d, t in EDGE:
        want.setdefault(d, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    got["doc_id"] = got.doc_id.astype(object).where(got.doc_id.notna(), None)
    for d, lists in want.items():
        mine = got[got.doc_id.isna()] if d is None else got[got.doc_id == d]
        ids = [np.frombuffer(b"".join(x), "<u4").tolist() for _, x in mine.sort_values("start", kind="stable").groupby("start").ids]
        assert sorted(map(len, mine.ids)) == sorted(4 * n for x in lists for n in piece_lengths(np.array([len(x)]), 1024)[1])
        if len(lists) == 1:
            assert [i for x in ids for i in x] == lists[0]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none, public_tokenizers.path(NAMES[0])).count() == 0
    with pytest.raises(ValueError):
        pack(none, public_tokenizers.path(NAMES[0]), 1000)


def test_buckets(spark, tmp_path):
    pieces = pack(edge_docs(spark), public_tokenizers.path(NAMES[0]), 64, 0)
    lengths = bucketed(pieces).mapInArrow(lambda bs: (b.select(["length"]) for b in bs), "length long")
    assert sorted(r.length for r in lengths.collect()) == sorted(r.length for r in pieces.collect())
    write_buckets(pieces, f"file://{tmp_path}/b")
    for folder in tmp_path.glob("b/length=*"):
        n = int(folder.name[7:])
        assert n & (n - 1) == 0 and all(len(x.as_py()) == 4 * n for x in pq.read_table(folder)["ids"])


def test_files(spark, tmp_path):
    """Edge rows, encodings, page index and a read of a few documents."""
    path = f"file://{tmp_path}/t"
    write_tokens(edge_docs(spark), path, public_tokenizers.path(NAMES[1]), 2, row_group_bytes=1 << 16, page_bytes=1 << 12)
    got = sorted(token_digest(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -5, 1, 2, 3, 3, 9]
    plain = MADE[NAMES[1]][1]
    sizes = {d: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in EDGE}
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, sizes[r.doc_id])
        at += r.n_tokens
    words = [f"w{k}" for k in range(3000)]
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(words, k=50))) for k in range(4000)]
    path = f"file://{tmp_path}/u"
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.path(NAMES[1]), 2, row_group_bytes=1 << 17, page_bytes=1 << 13)
    groups = 0
    for f in Path(f"{tmp_path}/u").glob("part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema.split(".")[0]: c for c in (meta.row_group(g).column(k) for k in range(meta.num_columns))}
            assert all(c.has_column_index or name == "tokens" for name, c in columns.items()) and all(c.has_offset_index for c in columns.values())
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
            assert any("DICTIONARY" in e for e in columns["tokens"].encodings)
            groups += 1
    some = read_tokens(spark, path, 100, 109)
    assert groups >= 2 and [r.doc_id for r in some.orderBy("doc_id").collect()] == list(range(100, 110))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100), LessThanOrEqual(doc_id,109)]" in some._jdf.queryExecution().toString()
    empty = f"file://{tmp_path}/e"
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, public_tokenizers.path(NAMES[1]))
    assert token_digest(spark, empty).count() == 0


def test_many_files(spark, tmp_path):
    """Files from part-99999 on are counted in the order of their numbers."""
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 7)) for k in range(300)], "doc_id long, text string")
    path = tmp_path / "tokens"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    write_tokens(docs, str(path), public_tokenizers.path("word_bpe_49k.json"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = sorted(map(tuple, token_digest(spark, str(path)).collect()))
    parts = sorted(path.glob("part-*"))
    assert len(parts) > 2
    for k, part in enumerate(parts):
        part.rename(path / part.name.replace(f"part-{part.name[5:10]}", f"part-{99_998 + k}"))
    for crc in path.glob(".part-*"):
        crc.unlink()
    assert sorted(map(tuple, token_digest(spark, str(path)).collect())) == want
    assert [s for _, s, _, _ in want] == list(np.cumsum([0, *(n for _, _, n, _ in want[:-1])]))
