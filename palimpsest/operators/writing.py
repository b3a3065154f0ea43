"""What a write or a rerun does to rows that are there: conflicts, merging, growing summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.retrieval import first_n, vector_matches


def resolved_conflicts(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """The table after requests (id, action): "reactivate" or "delete"; unknown ids and actions do nothing.

    A reactivated row is active and superseded by none, and the row that had superseded it
    supersedes none.  Both actions on one id delete it.  Repeated requests count once.
    """
    asked = requests.where(F.col("action").isin("reactivate", "delete")).groupBy("id").agg(F.min("action").alias("_action"))
    rows = memories.join(asked, "id", "left").where("_action is null or _action != 'delete'")
    again = F.col("_action") == "reactivate"
    freed = memories.join(asked.where("_action = 'reactivate'"), "id").where("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.lit(True).alias("_freed")).distinct()
    rows = rows.join(freed, "id", "left")
    made = {
        "is_active": F.when(again, True).otherwise(F.col("is_active")),
        "superseded_by": F.when(again, None).otherwise(F.col("superseded_by")),
        "supersedes": F.when(F.col("_freed"), F.array().cast("array<string>")).otherwise(F.col("supersedes")),
    }
    return rows.withColumns(made).select(*memories.columns)


def merged_writes(new: DataFrame, memories: DataFrame, least: float = 0.9, by: str | None = "user_id") -> DataFrame:
    """C14: new rows (id, content, tags, importance, embedding), each joined to the stored row most like it.

    From a cosine of ``least`` on, content is the stored text, a line break and the new one, tags
    are united in order, importance is the larger one and ``supersedes`` names the stored row.
    Without such a row, without a vector, or where the best is the row itself, it stays as it
    is, superseding none.  Of equal cosines (to nine places) the smallest id is taken.
    """
    owner = [by] if by else []
    found = vector_matches(new.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), *owner), memories.select("id", F.col("embedding").alias("vector"), *owner), 1, by=by)
    old = memories.select(F.col("id").alias("_best"), F.col("content").alias("_content"), F.col("tags").alias("_tags"), F.col("importance").alias("_importance"))
    best = found.where((F.round("score", 9) >= least) & (F.col("query_id") != F.col("id"))).select(F.col("query_id").alias("_id"), F.col("id").alias("_best"))
    rows = new.join(best.join(old, "_best"), F.col("id") == F.col("_id"), "left")
    hit = F.col("_best").isNotNull()
    none = F.array().cast("array<string>")
    made = {
        "content": F.when(hit, F.concat(F.coalesce("_content", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))).otherwise(F.col("content")),
        "tags": F.when(hit, F.array_distinct(F.concat(F.coalesce("_tags", none), F.coalesce("tags", none)))).otherwise(F.col("tags")),
        "importance": F.greatest("importance", "_importance"),
        "supersedes": F.when(hit, F.array(F.col("_best").cast("string"))).otherwise(none),
    }
    return rows.withColumns(made).select(*new.columns, *(c for c in ["supersedes"] if c not in new.columns))


def grown_summaries(summaries: DataFrame, memories: DataFrame, least: float = 0.75, most: int = 20, archive: int = 30) -> DataFrame:
    """Each summary that gains sources, with its new text, sources and high-water mark.

    summaries: summary_id, user_id, content, embedding, sources (array of ids), mark (timestamp or
    null).  memories: id, user_id, content, embedding, tags, is_active, updated_at.  Returns
    summary_id, content, sources, added, archives, mark for every summary whose sources or
    mark change; apply it with ``with_growth``.

    A summary looks at its user's active rows without the tag "summary" that are no sources yet
    and were written after its mark (all rows while it is null), so a run after a small batch
    reads that batch.  The ``most`` of highest cosine from ``least`` on are taken (equal
    ones to nine places by id).  The mark moves to the last row of the table only when nothing
    was left over; otherwise the next run looks from the old mark on, without what it took.
    So runs in turn give what a scan of all rows in each run gives, and runs without
    arrivals end when every fitting row is a source.  Precondition: whatever changes a row
    also raises its updated_at above all earlier ones.

    The text is the old one and " [Updated: a | b | c]" of the first 200 characters of the
    first three; beyond 2,000 characters it is cut to 1,997 and "...".  archives: the old
    row should be superseded, as its text was cut or it has more than ``archive`` sources.
    A null user_id owns nothing; no vector, or one of another length, gains nothing.
    """
    last = memories.agg(F.max("updated_at").alias("_last"))  # one row
    known = summaries.select("summary_id", "user_id", "embedding", "mark").where("user_id is not null")
    # the oldest mark of all bounds the scan; each summary's own is applied to its matches below
    low = known.agg(F.when(F.count("*") == F.count("mark"), F.min("mark")).alias("low")).head()["low"]
    rows = memories.where("is_active").where(~F.coalesce(F.array_contains("tags", "summary"), F.lit(False)))
    if low is not None:
        rows = rows.where(F.col("updated_at") > F.lit(low))
    # one more than is taken tells whether something is left over; sources may stand before them
    wide = most + 1 + (summaries.agg(F.max(F.size("sources"))).head()[0] or 0)
    asked = known.select(F.col("summary_id").alias("query_id"), F.col("embedding").alias("vector"), "user_id", F.col("mark").alias("updated_at"))
    found = vector_matches(asked, rows.select("id", F.col("embedding").alias("vector"), "user_id", "updated_at"), wide, least, by="user_id", at="updated_at").withColumnRenamed("query_id", "summary_id")
    taken = summaries.select("summary_id", F.explode("sources").alias("id"))
    new = found.where(F.col("score") >= least).join(taken, ["summary_id", "id"], "left_anti").select("summary_id", "id", F.round("score", 9).alias("score"))
    few = first_n(new, most + 1, ["summary_id"], F.desc("score"), F.col("id")).join(rows.select("id", F.substring("content", 1, 200).alias("text")), "id")
    row = F.struct("rank", "id", "text")
    gains = few.groupBy("summary_id").agg(F.array_sort(F.collect_list(row)).alias("_all")).withColumn("_new", F.slice("_all", 1, most))
    joined = summaries.join(gains, "summary_id", "left").crossJoin(F.broadcast(last))
    gained = F.col("_new").isNotNull()
    texts = F.array_join(F.transform(F.slice("_new", 1, 3), lambda r: F.coalesce(r["text"], F.lit(""))), " | ")
    text = F.concat("content", F.lit(" [Updated: "), texts, F.lit("]"))
    added = F.transform("_new", lambda r: r["id"])
    sources = F.when(gained, F.concat("sources", added)).otherwise(F.col("sources"))
    cut = F.coalesce(F.length(text) > 2000, F.lit(False))
    mark = F.when(gained & (F.size("_all") > most), F.col("mark")).otherwise(F.col("_last"))
    out = joined.where("user_id is not null and embedding is not null").select(
        "summary_id",
        F.when(~gained, F.col("content")).when(cut, F.concat(F.substring(text, 1, 1997), F.lit("..."))).otherwise(text).alias("content"),
        sources.alias("sources"),
        F.coalesce(added, F.slice("sources", 1, 0)).alias("added"),
        (gained & (cut | (F.size(sources) > archive))).alias("archives"),
        mark.alias("mark"),
        (gained | ~mark.eqNullSafe(F.col("mark"))).alias("_changed"),
    )
    return out.where("_changed").drop("_changed")


def with_growth(summaries: DataFrame, grown: DataFrame) -> DataFrame:
    """Summaries after a run: text, sources and mark of those that changed."""
    new = grown.select("summary_id", F.struct("content", "sources", "mark").alias("_g"))
    rows = summaries.join(new, "summary_id", "left")
    made = {c: F.when(F.col("_g").isNotNull(), F.col("_g")[c]).otherwise(F.col(c)) for c in ("content", "sources", "mark")}
    return rows.withColumns(made).select(*summaries.columns)
