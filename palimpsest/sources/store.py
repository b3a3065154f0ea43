"""The storage contract as functions from tables to tables.

A table is immutable; an upsert is an appended row with a higher version, and the latest
row of each key is the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEMORY_SCHEMA = (
    "id string, content string, memory_type string, scope string, user_id string, agent_id string, session_id string, "
    "tags array<string>, source string, importance double, entity_ids array<string>, is_active boolean, superseded_by string, "
    "supersedes array<string>, created_at timestamp, updated_at timestamp, last_accessed timestamp, access_count bigint, "
    "embedding array<float>, expires_at timestamp, session_layer string, conversation_id string"
)
DEFAULTS = {"memory_type": "semantic", "scope": "user", "importance": 0.5, "is_active": True, "access_count": 0, "session_layer": "long_term"}


def with_defaults(df: DataFrame) -> DataFrame:
    """Nulls become defaults; list columns become empty lists."""
    made = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns}
    made |= {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("tags", "entity_ids", "supersedes") if c in df.columns}
    return df.withColumns(made)


def alive(now: Column) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def scan(memories: DataFrame, now: Column, user_id: str | None = None, active_only: bool = False) -> DataFrame:
    """Rows that have not expired, of one user or all."""
    rows = memories.where(alive(now))
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    return rows.where("is_active") if active_only else rows


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookups, expired rows included.  ids: id."""
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def latest(log: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The latest row of each key of an append log."""
    last = Window.partitionBy(*keys).orderBy(F.desc(version))
    return log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def patch(memories: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Columns of changes (id, ...) replace those of memories where not null."""
    columns = [c for c in changes.columns if c != "id"]
    unknown = set(columns) - set(memories.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    new = changes.select("id", F.struct(*columns).alias("_new"))
    joined = memories.join(new, "id", "left")
    made = {c: F.coalesce(F.col("_new")[c], F.col(c)) for c in columns}
    if "updated_at" in memories.columns and "updated_at" not in columns:
        made["updated_at"] = F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at"))
    return joined.withColumns(made).select(*memories.columns)


def delete_where(memories: DataFrame, condition: Column) -> DataFrame:
    """What is left; a null condition keeps the row."""
    return memories.where(~F.coalesce(condition, F.lit(False)))


def touch(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One more access for each time an id occurs in ids."""
    hits = ids.groupBy("id").agg(F.count("*").alias("_hits"))
    joined = memories.join(hits, "id", "left")
    return joined.withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("_hits", F.lit(0)),
            "last_accessed": F.when(F.col("_hits").isNotNull(), now).otherwise(F.col("last_accessed")),
        }
    ).select(*memories.columns)


def history_row(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """CREATE, UPDATE and DELETE rows that lead from one state to the next."""
    old = before.select("id", F.col("content").alias("old_content"), F.lit(True).alias("_old"))
    new = after.select("id", F.col("content").alias("new_content"), F.lit(True).alias("_new"))
    both = old.join(new, "id", "full_outer")
    event = F.when(F.col("_old").isNull(), "CREATE").when(F.col("_new").isNull(), "DELETE").otherwise("UPDATE")
    changed = F.col("_old").isNull() | F.col("_new").isNull() | ~F.col("old_content").eqNullSafe(F.col("new_content"))
    return both.where(changed).select(F.col("id").alias("memory_id"), "old_content", "new_content", event.alias("event"), now.alias("changed_at"))


def versions(history: DataFrame) -> DataFrame:
    """Version numbers in order of change, and the parent version."""
    order = Window.partitionBy("memory_id").orderBy("changed_at", "event", "new_content")
    return history.withColumns({"version": F.row_number().over(order), "parent": F.lag(F.lit(1)).over(order)}).withColumn("parent", F.when(F.col("parent") == 1, F.col("version") - 1))


def rollback(history: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """A new history row with the content of version (memory_id, version); unknown versions give none."""
    rows = versions(history)
    old = rows.join(wanted, ["memory_id", "version"]).select("memory_id", F.col("new_content"))
    current = rows.groupBy("memory_id").agg(F.max_by("new_content", "version").alias("old_content"))
    return old.join(current, "memory_id").select("memory_id", "old_content", "new_content", F.lit("ROLLBACK").alias("event"), now.alias("changed_at"))


def purge_ids(memories: DataFrame, ids: list[str] = (), user_id: str | None = None, tags: list[str] = ()) -> DataFrame:
    """Ids to delete: listed ones, a user's, and those with any tag; sorted."""
    none = memories.where("1 = 0")
    picked = memories.where(F.col("id").isin(list(ids))) if ids else none
    if user_id is not None:
        picked = picked.unionByName(memories.where(F.col("user_id") == user_id))
    if tags:
        picked = picked.unionByName(memories.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in tags)))))
    return picked.select("id").distinct().orderBy("id")


def newest(events: DataFrame, conditions: dict[str, object], limit: int, time: str = "timestamp", since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Equality filters and an inclusive time range, newest first."""
    for c, v in conditions.items():
        events = events.where(F.col(c) == F.lit(v))
    if since is not None:
        events = events.where(F.col(time) >= since)
    if until is not None:
        events = events.where(F.col(time) <= until)
    return events.orderBy(F.desc(time), *(c for c in ("id", "event_id") if c in events.columns)).limit(limit)


def rarely_used(memories: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Rows of ``low`` to ``high`` accesses, least used first."""
    return memories.where(F.col("access_count").between(low, high)).orderBy("access_count", "id").limit(limit)


def visible_entities(entities: DataFrame, user_id: str) -> DataFrame:
    """Shared entities and the user's own."""
    owner = F.col("attributes")["user_id"]
    return entities.where(owner.isNull() | (owner == user_id))


def embed_changed(memories: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows whose content hash differs from the known one (id, content_hash)."""
    now = memories.withColumn("_hash", F.sha2("content", 256))
    return now.join(hashes, "id", "left").where(~F.col("_hash").eqNullSafe(F.col("content_hash"))).drop("content_hash").withColumnRenamed("_hash", "content_hash")
