"""Token ids as Parquet list columns, in doc_id order, for selective reads.

A file holds one range of doc_ids in order.  ``tokens`` is a list column with dictionary
encoding (ids are far fewer than 2**16 distinct values, so they are bit-packed); doc_id and
n_tokens are delta-encoded (no dictionary, format v2).  Row groups and pages are kept small
and the page index is written, so a reader of some documents skips row groups and pages,
and a reader of lengths never touches the tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tokens import SLICE_BYTES, encoder
from palimpsest.llm.wordhash import text_slices

SCHEMA = "doc_id long, n_tokens int, tokens array<int>"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for first, texts in text_slices(batch.column(1), SLICE_BYTES):
                ids, sizes = own.encode_with_end(texts, end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sizes.astype(np.int32)), lists], names=["doc_id", "n_tokens", "tokens"])

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, row_group_bytes: int = 8 << 20, page_bytes: int = 256 << 10
) -> None:
    """Encode whole texts, append ``end_id`` to each, write in ascending doc_id order to ``path``.

    Null or empty texts are the end id alone.  Null doc_ids come first; rows that repeat a
    doc_id are ordered by a hash of their text (and may lie in neighbouring files).  Other
    columns are ignored.  The texts are range-partitioned before they are encoded.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = thin.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ordered.mapInArrow(_encode(tokenizer_path, end_id), SCHEMA)
    (
        rows.write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, n_tokens, tokens, file_name, row_index; the range is pushed to row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "n_tokens", "tokens", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        lists = lists.slice(0)
        offsets = lists.offsets.to_numpy()
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        raw = memoryview(values).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)],
            names=["doc_id", "n_tokens", "ids_crc32", "file_name", "row_index"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: start counts the ids of all rows before.

    Null doc_ids come first and repeated ones follow one another, as they were written; no
    file, or files without rows, give no row.
    Only lengths (no tokens) are read for the files' bases: one row a file meets in one
    task; within a file the running sum follows the rows' order.
    """
    rows = read_tokens(spark, path).select("doc_id", "tokens", "file_name", "row_index")
    rows = rows.mapInArrow(_digest, "doc_id long, n_tokens long, ids_crc32 long, file_name string, row_index long")
    files = read_tokens(spark, path).groupBy("file_name").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    # by number: names of more than 100,000 parts do not sort so
    number = F.regexp_extract("file_name", r"part-(\d+)", 1).try_cast("long")
    before = Window.orderBy(number, "file_name").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_name", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file_name").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(files, "file_name").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
