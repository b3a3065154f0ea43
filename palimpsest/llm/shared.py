"""Folders and tables that all executors share, and small helpers of the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one with a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = found or "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        if not found:
            spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back, and its path, for ``delete``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there."""
    return stored(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of a shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Memory that Arrow and the C library keep though it is unused goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc only
        trim(0)


def freed(batches: Iterator) -> Iterator:
    """The batches; unused memory is given back before each further one and at the end."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker keeps no unused memory: it waits beside the JVM and the workers of later steps."""

    def frugally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(freed(batches))
        give_back()

    return frugally


def fresh_name() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Bits of the bitmap of ids that is broadcast: 4 MB, whatever the input.
FILTER_BITS = 1 << 25


def flag_ids(docs: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """docs with a boolean column: true for every doc_id in ids (id), and for a few others.

    The ids' hashes make a bitmap of fixed size, which is broadcast; no row is shuffled.
    Where the ids outgrow the bitmap it only lets more rows through.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bucket, bit, bits = (fresh_name() for _ in range(3))
    marks = (
        ids.select(spot("id").alias(bit))
        .groupBy(F.bitmap_bucket_number(bit).alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(bits))
    )
    at = docs.withColumns({bucket: F.bitmap_bucket_number(spot("doc_id")), bit: F.bitmap_bit_position(spot("doc_id"))})
    byte = F.expr(f"cast(conv(hex(substring({bits}, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({bit} % 8 as int))")) != 0, F.lit(False)) & F.col("doc_id").isNotNull()
    return at.join(F.broadcast(marks), bucket, "left").select(*(F.col(f"`{c}`") for c in docs.columns), hit.alias(flag))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids (id); only rows that may be are shuffled, if any."""
    maybe = fresh_name()
    flagged = flag_ids(docs, ids, maybe)
    sure = flagged.where(~F.col(maybe)).drop(maybe)
    unsure = flagged.where(F.col(maybe)).drop(maybe).join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    return sure.unionByName(unsure.select(*(F.col(f"`{c}`") for c in docs.columns)))
