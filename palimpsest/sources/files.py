"""File sources and the reader registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import clean_html

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    """Register a named reader (spark, **options) -> DataFrame."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"unknown reader {name!r}; known: {sorted(READERS)}")
    return READERS[name](spark, **options)


@reader("directory")
def directory(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 10 << 20) -> DataFrame:
    """Path, modified, bytes, text of the files below a directory or bucket prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.where(F.col("length") <= max_bytes).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), F.col("content").cast("string").alias("text"))


@reader("jdbc")
def jdbc(spark: SparkSession, **options) -> DataFrame:
    """A table of a database that speaks JDBC."""
    return spark.read.format("jdbc").options(**options).load()


@reader("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def watch(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """S27 live: a stream of new files below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def pack_paragraphs(text: str, most: int = 4096) -> list[str]:
    """Paragraphs joined while they fit ``most`` characters; a longer one is cut at its last space."""
    out: list[str] = []
    now = ""
    for part in (p.strip() for p in text.split("\n\n")):
        while len(part) > most:
            if now:
                out.append(now)
                now = ""
            cut = part.rfind(" ", 1, most)
            cut = cut if cut > 0 else most
            out.append(part[:cut])
            part = part[cut:].lstrip()
        if not part:
            continue
        if now and len(now) + 2 + len(part) > most:
            out.append(now)
            now = part
        else:
            now = f"{now}\n\n{part}" if now else part
    return out + [now] if now else out


def chunks(df: DataFrame, id: str, text: str, most: int = 4096) -> DataFrame:
    """(id, chunk, text) rows of packed paragraphs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b[id], b[text], strict=True) for k, c in enumerate(pack_paragraphs(t or "", most))]
            yield pd.DataFrame(rows, columns=[id, "chunk", "text"])

    return df.select(id, text).mapInPandas(run, f"{id} {df.schema[id].dataType.simpleString()}, chunk int, text string")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of raw HTML pages."""
    return pages.select("page_id", "url", clean_html(F.coalesce("html", F.lit(""))).alias("text"))


def file_language(path: Column, text: Column) -> Column:
    """By extension, then by tell-tale words."""
    out = F.lit(None).cast("string")
    for name, ends in {"python": ("py",), "javascript": ("js", "jsx", "mjs"), "typescript": ("ts", "tsx"), "java": ("java",), "go": ("go",), "rust": ("rs",), "markdown": ("md",)}.items():
        out = F.when(F.lower(path).rlike(r"\.(" + "|".join(ends) + ")$"), name).otherwise(out)
    guess = F.when(text.rlike(r"(?m)^\s*(def|class)\s+\w+.*:\s*$"), "python").when(text.rlike(r"(?m)^\s*(function|const|let|var)\s"), "javascript").otherwise("text")
    return F.coalesce(out, guess)
