"""A corpus pipeline of five stages over ``documents``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what
the next stage gets as docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.decontam import contaminated
from palimpsest.llm.packing import pack
from palimpsest.llm.secrets import redact_secrets
from palimpsest.llm.shared import without_ids, written
from palimpsest.llm.similarity import one_of_each_group
from palimpsest.llm.toxicity import learn_lexicon, toxicity

#: SQL cannot express the learned lexicon, the groups or the ids; see tests/llm.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go."""
    lexicon = learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity(lexicon) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays."""
    return one_of_each_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised, go."""
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, leaks.select(F.col("doc_id").alias("id")).distinct())


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark of their kind; n_chars follows the text."""
    return redact_secrets(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with a checksum of their ids."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secret_scan", redact),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
