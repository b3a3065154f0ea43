"""Packing by power-of-two decomposition.

Each document's ids (with the end id) are cut into pieces of ``max_tokens`` and then the
binary digits of what is left, longest first.  Pieces of one length form a bucket; a
sequence is one piece of a power-of-two length, so it never crosses documents and needs no
padding.  The work is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import frugal
from palimpsest.llm.tokens import SLICE_BYTES, encoder
from palimpsest.llm.wordhash import text_slices

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def piece_lengths(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, length) of the pieces of sets of ``totals`` tokens in order: full ones, then binary digits, largest first."""
    digits = longest >> np.arange(1, longest.bit_length())
    rest, digit = np.nonzero((totals % longest)[:, None] & digits)
    full = np.repeat(np.arange(len(totals)), totals // longest)
    owner, length = np.concatenate([full, rest]), np.concatenate([np.full(len(full), longest), digits[digit]])
    order = np.argsort(owner, kind="stable")
    return owner[order], length[order]


def _emit(path: str, longest: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for first, texts in text_slices(batch.column(1), SLICE_BYTES):
                ids, totals = own.encode_with_end(texts, end_id)
                owner, length = piece_lengths(totals, longest)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(totals) - totals)[owner]
                pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + owner)), *(pa.array(x.astype(np.int64)) for x in (start, length, totals[owner])), pieces.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset: one row for each piece.

    ids: the piece's ids, little-endian uint32.  sequence_id is unique; its sequence is this
    piece alone (offset 0), of a power-of-two length up to ``max_tokens`` (a power of two),
    so nothing is padded.  ``length`` names the bucket.  A null or empty text is the end id
    alone; null and repeated doc_ids are packed like any other; other columns are ignored;
    an empty table gives no piece.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = thin.mapInArrow(frugal(_emit(tokenizer_path, max_tokens, end_id)), PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def bucketed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with those of one length together: partitions sorted by length, so that a batch of rows is a matrix without padding.

    The rows are dealt by length and a hash of the piece, so that a frequent length fills many partitions.
    """
    n = pieces.sparkSession.sparkContext.defaultParallelism
    dealt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(2, n)))
    return pieces.repartition("length", dealt).sortWithinPartitions(F.desc("length"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces as Parquet, one folder for each length (``length=1024/`` ...)."""
    bucketed(pieces).write.partitionBy("length").parquet(path)
