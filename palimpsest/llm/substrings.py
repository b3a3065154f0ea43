"""Removal of repeated passages: Rabin-Karp hashes of every fixed-length token window.

Two windows can be equal only if their *anchors* are: a window's anchor is the smallest
hash among its short sub-windows.  A first, thin exchange (one row for each slice and
distinct anchor, about one for eight words) finds anchors that occur more than once;
only windows of such anchors go on to be counted, by anchor and full Rabin-Karp hash, so
no repeated window is lost and unrepeated text is never shuffled as windows.  Spark sorts
the rows of both exchanges, and tasks stream them.

Hot passages: each task first settles repeats inside its own slice, where the first
occurrence stands for the others.  One row for each slice and window at most leaves a
task, so a passage that a third of all documents hold meets in as many rows as there are
slices, not documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.wordhash import Words, mix64, text_slices, window_starts, windows, words

ANCHOR = 5


def _anchors(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, positions of their anchors, hashes of all sub-windows)."""
    short = mix64(windows(w.hashes, min(ANCHOR, width)))
    span = width - min(ANCHOR, width) + 1
    at = np.flatnonzero(window_starts(w.bounds, width, len(w.hashes)))
    if not len(at):
        return at, at, short
    value, place, done = short, np.arange(len(short)), 1
    while done < span:
        step = min(done, span - done)
        ahead = value[step:] < value[: len(value) - step]
        place = np.where(ahead, place[step:], place[: len(place) - step])
        value = np.where(ahead, value[step:], value[: len(value) - step])
        done += step
    return at, place[at], short


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge windows at consecutive starts: (doc, first start, number of windows)."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] - start[first] + 1


def _emit_anchors(width: int):
    """(doc_id, text) -> (key, doc, mark): mark 0/1 one row of a slice's anchor (1: repeated there), 2 an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, piece in text_slices(batch.column(1)):
                w = words(piece)
                _, place, short = _anchors(w, width)
                place = np.unique(place)
                doc = ids[first + np.searchsorted(w.bounds, place, side="right") - 1]
                key, at, back, count = np.unique(short[place], return_index=True, return_inverse=True, return_counts=True)
                again = count[back] > 1
                cols = [
                    np.concatenate([key, short[place][again]]).view(np.int64),
                    np.concatenate([doc[at], doc[again]]).astype(np.int64),
                    np.concatenate([count > 1, np.full(int(again.sum()), 2)]).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "doc", "mark"])

    return run


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, anchor) of marks 2 at once, and of marks 0 whose anchor was met in more than one slice.

    The rows come sorted by key; one row is held back, so memory is that of a batch.
    """
    key, doc, mark = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    more = False
    for batch in batches:
        k, d, m = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        told = m == 2
        if told.any():
            yield pa.RecordBatch.from_arrays([pa.array(d[told]), pa.array(k[told])], names=["doc_id", "anchor"])
        if told.all():
            continue
        key, doc, mark = np.append(key, k[~told]), np.append(doc, d[~told]), np.append(mark, m[~told])
        same = key[1:] == key[:-1]
        met = np.append(more, same) | np.append(same, False)
        keep = met[:-1] & (mark[:-1] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[:-1][keep]), pa.array(key[:-1][keep])], names=["doc_id", "anchor"])
        key, doc, mark, more = key[-1:], doc[-1:], mark[-1:], bool(met[-1])
    if more and mark[0] == 0:
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key)], names=["doc_id", "anchor"])


def _emit_windows(width: int):
    """(doc_id, text, anchors) -> rows by anchor.

    mask >= 0: the windows of one anchor occurrence (bit o: the window that starts o words
    before ``pos``) with their hashes in ``hashes``; mask < 0: a run of -mask windows from
    word ``pos`` that are repeats of windows of the same slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, piece in text_slices(batch.column(1)):
                w = words(piece)
                at, place, short = _anchors(w, width)
                asked = batch.column(2).slice(first, len(piece)).flatten().to_numpy(zero_copy_only=False)
                some = np.isin(short[place].view(np.int64), asked)
                at, place = at[some], place[some]
                if not len(at):
                    continue
                h = mix64(windows(w.hashes, width)[at])
                local = np.searchsorted(w.bounds, at, side="right") - 1
                doc = ids[first + local].astype(np.int64)
                start = at - w.bounds[local]
                order = np.lexsort((start, doc, h))
                lead = np.ones(len(h), bool)
                lead[1:] = h[order][1:] != h[order][:-1]
                # equal (doc, start) under one hash can only be rows that repeat a doc_id: none is earlier
                same = ~lead
                same[1:] &= (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])
                known = order[same]
                head = np.sort(order[lead])
                k_doc, k_start, k_count = _runs(doc[known], start[known])
                anchor, pos = place[head], place[head] - w.bounds[local[head]]
                new = np.ones(len(head), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                group = np.flatnonzero(new)
                bits = np.left_shift(1, (anchor - at[head]).astype(np.int64))
                mask = np.add.reduceat(bits, group) if len(group) else np.empty(0, np.int64)
                size = np.diff(np.append(group, len(head))) * 8
                payload = pa.Array.from_buffers(
                    pa.binary(), len(group), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(h[head])]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(short[anchor[group]].view(np.int64)), pa.array(doc[head][group]), pa.array(pos[group].astype(np.int32)), pa.array(mask.astype(np.int32)), payload],
                    names=["key", "doc", "pos", "mask", "hashes"],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix64(k_doc.astype(np.uint64)).view(np.int64)), pa.array(k_doc), pa.array(k_start.astype(np.int32)), pa.array((-k_count).astype(np.int32)), pa.nulls(len(k_doc), pa.binary())],
                    names=["key", "doc", "pos", "mask", "hashes"],
                )

    return run


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows of which an earlier (doc, start) exists; equal are those of one anchor and one hash.

    The rows come sorted by key, doc and pos.  Of the anchor that may go on in the next
    batch only the first occurrence of each different window is kept in memory.
    """
    key, h, doc, start = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.arange(31, -1, -1)
    for batch in batches:
        own, at, pos, mask = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
        known = mask < 0
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(at[known]), pa.array(pos[known].astype(np.int32)), pa.array((-mask[known]).astype(np.int32))], names=["doc_id", "start", "n"])
        if known.all():
            continue
        own, at, pos, mask = own[~known], at[~known], pos[~known], mask[~known]
        payload = batch.column(4).filter(pa.array(~known))
        row, col = np.nonzero((mask[:, None] >> offsets) & 1)
        key, doc, start = np.append(key, own[row]), np.append(doc, at[row]), np.append(start, pos[row] - offsets[col])
        h = np.append(h, np.frombuffer(b"".join(payload.to_pylist()), np.uint64))
        order = np.lexsort((start, doc, h, key))
        key, h, doc, start = key[order], h[order], doc[order], start[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = (doc != doc[first]) | (start != start[first])
        d, s, n = _runs(doc[later], start[later])
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "start", "n"])
        open_ = new & (key == own[-1])
        key, h, doc, start = key[open_], h[open_], doc[open_], start[open_]


def repeated_runs(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, start, n: runs of n windows of ``width`` words that also start earlier.

    Earlier: in a smaller doc_id, or in the same document before.  docs: doc_id, text.
    Runs of one document may touch or overlap; ``cut_repeats`` merges them.
    """
    if not ANCHOR <= width <= ANCHOR + 30:
        raise ValueError(f"width must be {ANCHOR} to {ANCHOR + 30}")
    real = _texts(docs).where("doc_id is not null")
    met = real.mapInArrow(_emit_anchors(width), "key long, doc long, mark int")
    # an anchor repeated inside a slice is asked for by each of its documents without a count, so these rows go by document
    met = met.repartition(F.when(F.col("mark") == 2, F.col("doc")).otherwise(F.col("key"))).sortWithinPartitions("key")
    found = met.mapInArrow(_repeated_anchors, "doc_id long, anchor long")
    asked = found.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    rows = real.join(asked, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_emit_windows(width), "key long, doc long, pos int, mask int, hashes binary")
    return rows.repartition("key").sortWithinPartitions("key", "doc", "pos").mapInArrow(_repeated_windows, "doc_id long, start int, n int")


def _cut(width: int):
    """(doc_id, text, runs) -> doc_id, n_words, n_removed, kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, piece in text_slices(batch.column(1)):
                w = words(piece)
                counts = np.diff(w.bounds)
                runs = batch.column(2).slice(first, len(piece))
                flat = runs.flatten()
                owner = np.repeat(np.arange(len(piece)), np.nan_to_num(runs.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                start = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + w.bounds[owner]
                stop = start + flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64) + width - 1
                total = len(w.hashes)
                edge = np.bincount(start, minlength=total + 1)[: total + 1] - np.bincount(stop, minlength=total + 1)[: total + 1]
                kept = np.cumsum(edge)[:total] == 0
                n_kept = np.add.reduceat(np.append(kept, 0).astype(np.int64), w.bounds[:-1]) if len(counts) else counts
                n_kept = np.where(counts > 0, n_kept, 0)
                at = np.flatnonzero(kept)
                length = w.ends[at] - w.starts[at]
                last = np.zeros(len(at), bool)
                last[np.cumsum(n_kept)[n_kept > 0] - 1] = True
                grown = length + ~last
                base = np.cumsum(grown) - grown
                source = np.arange(int(grown.sum())) - np.repeat(base - w.starts[at], grown)
                out = w.data[np.minimum(source, max(len(w.data) - 1, 0))]
                out[(base + length)[~last]] = 0x20
                ends = np.append(0, np.cumsum(grown))
                offsets = ends[np.append(0, np.cumsum(n_kept))]
                text = pa.Array.from_buffers(pa.string(), len(piece), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(piece)), pa.array(counts.astype(np.int64)), pa.array((counts - n_kept).astype(np.int64)), text],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: every word of a window that also starts earlier is cut.

    Words are runs outside \\x20 and \\x09-\\x0D; windows are judged on the input.  Kept words
    are joined by one space.  Null or empty texts have no words; texts shorter than ``width``
    lose nothing; rows with a null doc_id are kept whole and take no part; rows that repeat
    a doc_id count as one document, whose equal windows at one start are no repeats of each
    other (each row is returned).  Other columns of ``docs`` are ignored.
    """
    thin = _texts(docs)
    runs = repeated_runs(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    rows = thin.join(runs, "doc_id", "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_text string")
