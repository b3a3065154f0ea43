"""Rule extraction of memories and conversations, and consolidation (T10-T14, W14, §3.2, §3.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import entities, extracted_importance, language_of, letter_counts, memory_type, sentences, tags
from palimpsest.operators.dedup import merge_groups
from palimpsest.operators.ordered import greedy_groups
from palimpsest.operators.lifecycle import decayed


def extract(texts: DataFrame, least_chars: int = 5) -> DataFrame:
    """Texts (id, text) -> (id, n, content, memory_type, entities, tags, importance), a row for each sentence.

    Sentences under ``least_chars`` are skipped; a text of which none is left gives itself.
    """
    long = F.filter(sentences(F.col("text")), lambda s: F.length(s) >= least_chars)
    rows = texts.withColumn("_s", F.when(F.size(long) > 0, long).otherwise(F.array("text")))
    rows = rows.select("id", F.posexplode("_s").alias("n", "content"))
    rows = rows.withColumn("entities", entities(F.col("content")))
    return rows.select("id", "n", "content", memory_type(F.col("content")).alias("memory_type"), "entities", tags(F.col("content")).alias("tags"), extracted_importance(F.col("content"), F.size("entities")).alias("importance"))


def statements(conversations: DataFrame, least_chars: int = 5) -> DataFrame:
    """(conv_id, turn, n, content, role, lang, memory_type, confidence) of all turns."""
    # the language is that of all turns' texts with a space between them
    c = letter_counts(F.col("text"))
    counts = conversations.where("text <> ''").select("conv_id", c.alias("c")).groupBy("conv_id").agg(*(F.sum(f"c.{x}").alias(x) for x in ("n", "zh", "ru", "ar")), F.count("*").alias("turns"))
    known = counts.select("conv_id", language_of(F.col("n") + F.col("turns") - 1, F.col("zh"), F.col("ru"), F.col("ar")).alias("lang"))
    lang = conversations.select("conv_id").distinct().join(known, "conv_id", "left").select("conv_id", F.coalesce("lang", F.lit("en")).alias("lang"))
    rows = conversations.join(lang, "conv_id").select("conv_id", "turn", "role", "lang", F.posexplode(F.filter(sentences(F.col("text")), lambda s: F.length(s) >= least_chars)).alias("n", "content"))
    low = F.lower("content")
    kind = F.when(low.rlike("prefer|like|love|hate|want"), "preference").when(low.rlike("how to|step|first|then"), "procedural").when(low.rlike("yesterday|today|ago|last"), "episodic").when(low.rlike(r"\bis\b|\bare\b|\bwas\b"), "fact").otherwise("semantic")
    sure = F.least(F.lit(1.0), 0.7 + F.when(F.col("role") == "user", 0.1).otherwise(0.0) + F.when(kind == "preference", 0.1).otherwise(0.0) + F.when(F.length("content") > 30, 0.05).otherwise(0.0))
    return rows.withColumns({"memory_type": kind, "confidence": sure})


def paired(rows: DataFrame, least: int = 30) -> DataFrame:
    """Consecutive short statements of one role and type are joined in pairs, first with second, third with fourth.

    A run's rows are numbered with windows; nothing is folded in Python.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "n")
    short = F.length("content") < least
    rows = rows.withColumn("_k", F.when(short, F.concat_ws("|", "role", "memory_type")))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_k").isNotNull() & F.col("_k").eqNullSafe(F.lag("_k").over(order)), 0).otherwise(1)).over(order))
    inside = Window.partitionBy("conv_id", "_run").orderBy("turn", "n")
    rows = rows.withColumn("_pair", F.floor((F.row_number().over(inside) - 1) / 2))
    made = rows.groupBy("conv_id", "_run", "_pair").agg(F.array_sort(F.collect_list(F.struct("turn", "n", "content"))).alias("r"), F.first("role").alias("role"), F.first("memory_type").alias("memory_type"))
    return made.select("conv_id", F.col("r")[0]["turn"].alias("turn"), F.col("r")[0]["n"].alias("n"), "role", "memory_type", F.array_join(F.transform("r", lambda x: x["content"]), " ").alias("content"))


def consolidate(memories: DataFrame, now: Column, least: float = 0.05, similar: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Decay, forget, merge: (memories that are left with decayed importance, merged rows).  memories has ``vector``."""
    left = decayed(memories, now).withColumn("importance", F.col("new_importance")).drop("retention", "new_importance")
    left = left.where(F.col("importance") >= least)
    merged = merge_groups(left.where("is_active"), greedy_groups(left.where("is_active"), similar))
    return left, merged
