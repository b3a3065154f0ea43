"""Import and export of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("id", "content", "memory_type", "scope", "user_id", "tags", "source", "importance", "is_active", "created_at", "last_accessed", "access_count")
TYPES = ("fact", "preference", "episodic", "semantic", "procedural", "working")


def json_rows(memories: DataFrame, embedding: bool = False) -> DataFrame:
    """One JSON object a row, in column ``value``."""
    fields = [c for c in FIELDS if c in memories.columns] + (["embedding"] if embedding else [])
    return memories.select(F.to_json(F.struct(*fields)).alias("value"))


def csv_rows(memories: DataFrame) -> DataFrame:
    """Flat columns; tags joined by ``;`` and is_active as 0 or 1."""
    rows = memories.select(*(c for c in FIELDS if c in memories.columns))
    return rows.withColumns({"tags": F.concat_ws(";", "tags"), "is_active": F.col("is_active").cast("int")})


def markdown(memories: DataFrame) -> DataFrame:
    """Id and a section ``## [type] content`` with a bullet for each field."""
    head = F.concat(F.lit("## ["), F.col("memory_type"), F.lit("] "), F.substring("content", 1, 80))
    bullets = [
        F.format_string("- importance: %.2f", F.col("importance")),
        F.concat(F.lit("- tags: "), F.concat_ws(", ", "tags")),
        F.concat(F.lit("- id: "), F.col("id").cast("string")),
    ]
    return memories.select("id", F.concat_ws("\n", head, *bullets).alias("value"))


def parse_markdown(lines: DataFrame, order: str = "line") -> DataFrame:
    """Sections of a Markdown dump: lines (file, line, value) -> file, section, memory_type, content, importance, tags."""
    within = Window.partitionBy("file").orderBy(order)
    is_head = F.col("value").rlike(r"^## \[")
    rows = lines.withColumn("section", F.sum(is_head.cast("int")).over(within)).where("section > 0")
    pick = lambda p: F.max(F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1)))
    return rows.groupBy("file", "section").agg(
        pick(r"^## \[([^\]]*)\]").alias("memory_type"),
        pick(r"^## \[[^\]]*\] (.*)$").alias("content"),
        pick(r"^- importance: ([0-9.]+)").cast("double").alias("importance"),
        F.filter(F.split(pick(r"^- tags: (.*)$"), ", *"), lambda x: x != "").alias("tags"),
    )


def write(memories: DataFrame, path: str, kind: str) -> None:
    """Write as json, csv, markdown or parquet."""
    if kind == "json":
        json_rows(memories).write.text(path)
    elif kind == "csv":
        csv_rows(memories).write.csv(path, header=True)
    elif kind == "markdown":
        markdown(memories).select("value").write.text(path, lineSep="\n\n")
    elif kind == "parquet":
        memories.write.parquet(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Content, memory_type, tags, importance, user_id from json or csv rows."""
    schema = "content string, memory_type string, user_id string, importance double"
    if kind == "json":
        return spark.read.schema(schema + ", tags array<string>").json(path)
    if kind == "csv":
        rows = spark.read.csv(path, header=True)
        wanted = [F.col(c).cast("double" if c == "importance" else "string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("content", "memory_type", "user_id", "importance")]
        return rows.select(*wanted, F.filter(F.split("tags", ";"), lambda x: x != "").alias("tags"))
    raise ValueError(f"unknown format {kind!r}")


def new_rows(arrivals: DataFrame, memories: DataFrame) -> DataFrame:
    """Arrivals with content that the same user has not stored yet, in any case; the first of equals."""
    key = F.lower(F.trim("content"))
    rows = arrivals.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("_key", key)
    known = memories.select(F.col("user_id").alias("_user"), key.alias("_key")).distinct()
    fresh = rows.join(known, (rows["_key"] == known["_key"]) & rows["user_id"].eqNullSafe(known["_user"]), "left_anti")
    return fresh.dropDuplicates(["user_id", "_key"]).drop("_key")


def errors() -> Column:
    """Messages for what is wrong with a row; an empty array if nothing is."""
    return F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("content", F.lit(""))) == "", F.lit("content is empty")),
            F.when(~F.coalesce(F.col("memory_type").isin(*TYPES), F.lit(False)), F.lit("unknown memory_type")),
            F.when(F.col("importance").isNull() | ~F.col("importance").between(0.0, 1.0), F.lit("importance is not within 0 and 1")),
        )
    )


def interchange(memories: DataFrame) -> DataFrame:
    """Nested JSON with provenance and validity parts."""
    provenance = F.struct("source", "user_id", "created_at")
    validity = F.struct("is_active", "expires_at")
    return memories.select(F.to_json(F.struct(F.lit("0.2").alias("version"), "id", "content", "memory_type", provenance.alias("provenance"), validity.alias("validity"))).alias("value"))
