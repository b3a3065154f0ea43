"""Quality by the votes of labelled neighbours in a latent-semantic space.

A text's terms are its words, hashed into a fixed number of slots, and terms of its form:
how words begin and end, repeat, and are cased.  Term weights come from document counts
over all documents.  A bounded sample of labelled documents gives the latent axes (leading
right singular vectors of their weighted term rows) and the labelled points; both are of
bounded size and broadcast.  Every document is projected block by block, its cosines with
all labelled points are exact matrix products, and the nearest points vote with their
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.quality import _line_duplicates, _repeated_words
from palimpsest.llm.shared import written
from palimpsest.llm.wordhash import mix64, text_slices, words

#: Slots of hashed words.
SLOTS = 1536
#: Byte classes at a word's ends: lower, upper, digit, letter beyond ASCII, ., comma-like, !?, table and markup signs, other.
CLASSES = 9
#: Terms of form: first and last class of a word, and the shares named in ``_form``.
FORMS = CLASSES * CLASSES + 8
#: Texts that are weighed and compared at a time.
BLOCK = 256

_CLASS = np.full(256, 8, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _sign, _kind in ((".", 4), (",;:'\"()-", 5), ("!?", 6), ("#*$%&|<>=+~^_/\\{}[]@", 7)):
    _CLASS[[ord(c) for c in _sign]] = _kind


def term_rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts and shares by term) of blocks of a string column; whole texts."""
    for first, piece in text_slices(texts):
        w = words(piece)
        n = np.diff(w.bounds)
        doc = np.repeat(np.arange(len(n)), n)
        offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
        slot = (mix64(w.hashes) % np.uint64(SLOTS)).astype(np.int64)
        begins, ends = _CLASS[w.data[w.starts]], _CLASS[w.data[w.ends - 1]]
        lone = (w.ends - w.starts == 1) & (begins == 7)
        capital = (begins == 1) & (w.ends - w.starts > 1) & (_CLASS[w.data[np.minimum(w.starts + 1, w.ends - 1)]] == 1)
        again = np.zeros(len(doc), bool)
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((w.hashes, doc))
        seen = np.zeros(len(doc), bool)
        seen[order[1:]] = (w.hashes[order][1:] == w.hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        many = np.maximum(n, 1)
        share = lambda mask: np.bincount(doc[mask], minlength=len(n)) / many
        windows = _repeated_words(w.hashes, w.bounds, 8) / many
        lines = np.minimum(_line_duplicates(w.data, offsets[1:] - offsets[0], w.starts) / many * 8, 1)
        shares = np.stack([share(lone), share(capital), share(again), np.maximum(share(seen) - 0.5, 0) * 0.5, windows, lines, np.exp(-n / 20.0), np.ones(len(n))], axis=1)
        form = begins * CLASSES + ends
        for at in range(0, len(n), BLOCK):
            to = min(at + BLOCK, len(n))
            rows = slice(w.bounds[at], w.bounds[to])
            out = np.zeros((to - at, SLOTS + FORMS), np.float32)
            inside = doc[rows] - at
            out[:, :SLOTS] = np.bincount(inside * SLOTS + slot[rows], minlength=(to - at) * SLOTS).reshape(to - at, SLOTS)
            kinds = np.bincount(inside * CLASSES**2 + form[rows], minlength=(to - at) * CLASSES**2).reshape(to - at, -1)
            out[:, SLOTS : SLOTS + CLASSES**2] = kinds / many[at:to, None]
            out[:, SLOTS + CLASSES**2 :] = shares[at:to]
            yield first + at, out


@dataclass
class Space:
    """Term weights, latent axes, and labelled points (unit rows) with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    points: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Weighted term rows: the words of length 1/4, the terms of form (square roots of shares) beside them."""
        out = np.log1p(counts)
        out[:, SLOTS:] = np.sqrt(counts[:, SLOTS:])
        out *= self.weights
        length = np.linalg.norm(out[:, :SLOTS], axis=1, keepdims=True)
        out[:, :SLOTS] /= np.maximum(length, 1e-12) * 4
        return out

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit rows in the latent space."""
        z = self.weigh(counts) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The nearest points' labels weighted by similarity; all points as near as the last one vote."""
        near = np.round(self.place(counts) @ self.points.T, 5)
        k = min(self.neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
        vote = np.where(near >= last, np.exp(self.sharpness * (near - near.max(axis=1, keepdims=True))), 0)
        return np.clip((vote @ self.labels).astype(float) / vote.sum(axis=1), 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _document_counts(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents with each term, over all of texts (text); one row of sums a task reaches Spark's aggregation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS + FORMS, np.int64), 0
        for batch in batches:
            for _, rows in term_rows(batch.column(0)):
                total += (rows > 0).sum(axis=0)
                n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1, dtype=np.int32)), pa.array(np.append(total, n))], names=["term", "n"])

    sums = texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    if not len(sums):
        return 0, np.zeros(SLOTS + FORMS)
    by_term = sums.sort_values("term")["n"].to_numpy()
    return int(by_term[-1]), by_term[:-1]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows in term_rows(batch.column(0)):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(first, len(rows))], names=["terms", "label"])


def _leading_axes(rows: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    rank = min(rank, *rows.shape)
    q = np.random.default_rng(11).standard_normal((rows.shape[1], min(rank + 16, *rows.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, right = np.linalg.svd(rows @ q, full_matrices=False)
    return (q @ right[:rank].T).astype(np.float32)


def learn_space(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000, rank: int = 64, neighbours: int = 15, sharpness: float = 12.0) -> Space | None:
    """A space from labelled documents (labels: doc_id, quality) that are not held out; None without labels.

    Bounded sample: about ``max_rows`` labelled rows by a hash of doc_id, so the term rows
    that reach the driver (some 6 KB each) and the broadcast points do not grow with the
    input.  Document counts are those of all documents.  Null labels are left out; of
    several labels of a doc_id the lowest counts.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    marked = marked.where(~held_out())
    share = min(1.0, max_rows / max(marked.count(), 1))
    ids = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1_000_000)) < int(1_000_000 * share))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = written(thin.join(F.broadcast(ids), "doc_id").select("text", F.expr("int(label > 0)").alias("label")), "labelled")
    known = sample.mapInArrow(_terms, "terms array<float>, label int").toArrow()
    if not known.num_rows:
        return None
    terms = known["terms"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(known.num_rows, -1)
    marks = known["label"].to_numpy().astype(np.float32)
    del known
    n, counts = _document_counts(thin.select("text"))
    weights = np.log((n + 1.0) / (counts + 1.0)) + 0.05
    weights[SLOTS:] = 1.0
    space = Space(weights.astype(np.float32), np.empty(0), np.empty(0), marks, neighbours, sharpness)
    space.axes = _leading_axes(space.weigh(terms), rank)
    space.points = np.concatenate([space.place(terms[at : at + BLOCK]) for at in range(0, len(terms), BLOCK)]).astype(np.float32)
    return space


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``least``) of every whole text.

    Only texts enter a score.  A null text is an empty one; a text without words is near
    other short ones.  Null and repeated doc_ids are ordinary rows (a null one is not held
    out); other columns are ignored; an empty table gives an empty result.  Without any
    labelled document every score is 1/2.
    """
    space = learn_space(docs, labels, **how)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if space is None:
        rows = thin.select("doc_id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(space)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, counts in term_rows(batch.column(1)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(shared.value.scores(counts))], names=["doc_id", "score"])

        rows = thin.mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
