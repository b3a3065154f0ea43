"""Hybrid recall over batches of queries.

queries: query_id, query, and optionally vector, user_id.  One plan answers all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scoring import result_confidence
from palimpsest.operators.graph import linked_memories, within_hops
from palimpsest.operators.retrieval import best_of, bm25, explanation, first_n, owned_rows, reciprocal_rank_fusion, recency_weighted, vector_matches

# Synonyms of query words.
SYNONYMS = {
    "python": ["py", "python3", "cpython"], "javascript": ["js", "node", "nodejs", "ecmascript"], "database": ["db", "datastore", "storage", "sql"],
    "api": ["endpoint", "interface", "rest", "graphql"], "error": ["exception", "bug", "fault", "issue", "failure"],
    "fix": ["repair", "resolve", "patch", "workaround", "solution"], "deploy": ["release", "ship", "publish", "launch"],
    "test": ["unit test", "integration test", "qa", "validation"], "performance": ["speed", "latency", "throughput", "optimization"],
    "security": ["auth", "authentication", "encryption", "vulnerability"], "config": ["configuration", "settings", "env", "parameters"],
    "log": ["logging", "trace", "audit", "record"], "user": ["customer", "client", "account", "person"],
    "memory": ["recall", "retention", "storage", "cache"], "search": ["query", "retrieve", "find", "lookup"],
    "update": ["modify", "change", "edit", "refresh"], "delete": ["remove", "drop", "purge", "clear"],
    "create": ["add", "insert", "new", "generate"], "list": ["enumerate", "show", "display", "all"], "help": ["assist", "support", "guide", "documentation"],
}


def candidates(queries: DataFrame, memories: DataFrame, now: Column, limit: int, edges: DataFrame | None = None, seeds: DataFrame | None = None, links: DataFrame | None = None, weight: float = 0.3) -> DataFrame:
    """(query_id, method, id, score): three times ``limit`` rows of each strategy that its inputs allow.

    A query with a user_id sees that user's rows only, in every strategy and before its cut.
    """
    wide = 3 * limit
    by = "user_id" if "user_id" in queries.columns else None
    own = [by] if by else []
    rows = bm25(queries, memories.select("id", F.col("content").alias("text"), *own), wide, by=by).select("query_id", F.lit("keyword").alias("method"), "id", "score")
    if "vector" in queries.columns and "embedding" in memories.columns:
        semantic = vector_matches(queries.select("query_id", "vector", *own), memories.select("id", F.col("embedding").alias("vector"), *own), wide, by=by).drop("rank")
        temporal = recency_weighted(semantic, memories.select("id", "created_at"), now, weight, wide)
        for name, part in (("semantic", semantic), ("temporal", temporal)):
            rows = rows.unionByName(part.select("query_id", F.lit(name).alias("method"), "id", "score"))
    if edges is not None and seeds is not None and links is not None:
        near = linked_memories(edges, seeds, links).join(memories.select("id"), "id", "left_semi")
        near = owned_rows(near, queries, memories, by) if by else near
        near = first_n(near, wide, ["query_id"], F.desc("score"), F.col("id"))
        rows = rows.unionByName(near.select("query_id", F.lit("graph").alias("method"), "id", "score"))
    return rows


def recall(
    queries: DataFrame,
    memories: DataFrame,
    now: Column,
    limit: int = 10,
    least: float = 0.3,
    weights: DataFrame | None = None,
    memory_types: list[str] | None = None,
    tags: list[str] | None = None,
    since: Column | None = None,
    until: Column | None = None,
    **graph,
) -> DataFrame:
    """query_id, id, score, rank, explanation.

    Expired and inactive rows go first, and those of other types, without any of the tags or
    created outside [since, until]; then each strategy ranks, ranks are fused, and rows below
    ``least`` of the query's best are dropped.  A query with a user_id sees that user's rows.
    """
    alive = memories.where("is_active").where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if memory_types is not None:
        alive = alive.where(F.col("memory_type").isin(memory_types))
    if tags is not None:
        alive = alive.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)).cast("array<string>")))
    if since is not None:
        alive = alive.where(F.col("created_at") >= since)
    if until is not None:
        alive = alive.where(F.col("created_at") <= until)
    fused = reciprocal_rank_fusion(candidates(queries, alive, now, limit, **graph), weights=weights)
    rows = fused.join(alive.select("id", "importance", "access_count"), "id")
    rows = first_n(rows.where(F.col("score") >= least), limit, ["query_id"], F.desc(F.round("score", 9)), F.col("id"))
    return rows.select("query_id", "id", "score", "rank", explanation(F.col("score"), F.col("methods"), F.col("importance"), F.col("access_count")).alias("explanation"))


def reinforced(memories: DataFrame, recalled: DataFrame, now: Column, boost: float = 0.05) -> DataFrame:
    """The table after a recall (query_id, id): each result counts as an access and adds ``boost`` to importance.

    Rows that are inactive by now were superseded since they were ranked and are left alone.  A row found
    by several queries gains from each; importance stays within 1, and one beyond it is kept.
    ``boost`` 0 counts accesses alone; a null importance stays null.
    """
    hits = recalled.groupBy("id").agg(F.count("*").alias("_hits"))
    rows = memories.join(hits, "id", "left")
    hit = F.col("_hits").isNotNull() & F.col("is_active")
    made = {
        "access_count": F.when(hit, F.coalesce("access_count", F.lit(0)) + F.col("_hits")).otherwise(F.col("access_count")),
        "last_accessed": F.when(hit, now).otherwise(F.col("last_accessed")),
        "importance": F.when(hit & F.col("importance").isNotNull(), F.greatest(F.col("importance"), F.least(F.lit(1.0), F.col("importance") + boost * F.col("_hits")))).otherwise(F.col("importance")),
    }
    return rows.withColumns(made).select(*memories.columns)


def retrieval_records(queries: DataFrame, recalled: DataFrame, memories: DataFrame, now: Column, separator: str = "\n") -> DataFrame:
    """One row of the access log for each query: record_id, timestamp, query_id, query, retrieved_ids, retrieved_scores, composed_context, feedback.

    Ids, scores and texts are in the order of the ranks; rows that are inactive by now are not
    recorded.  A query that found nothing has empty lists.  record_id is a hash of query and
    time, so a replayed append can be told.  A query has ``limit`` of recall rows at most.
    """
    rows = recalled.join(memories.where("is_active").select("id", "content"), "id")
    found = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "content"))).alias("r"))
    each = lambda c, kind: F.coalesce(F.transform("r", lambda x: x[c].cast(kind)), F.array().cast(f"array<{kind}>"))
    return queries.select("query_id", "query").join(found, "query_id", "left").select(
        F.sha2(F.concat_ws("\n", F.col("query_id").cast("string"), F.coalesce("query", F.lit("")), F.unix_micros(now).cast("string")), 256).alias("record_id"),
        now.alias("timestamp"), "query_id", "query", each("id", "string").alias("retrieved_ids"), each("score", "double").alias("retrieved_scores"),
        F.array_join(each("content", "string"), separator).alias("composed_context"), F.lit("none").alias("feedback"),
    )


def expanded_queries(queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, n, query): the query itself first, then it with words replaced by synonyms, sorted."""
    rows = F.array(*(F.struct(F.lit(w).alias("word"), F.array(*map(F.lit, s)).alias("by")) for w, s in SYNONYMS.items()))
    low = F.lower("query")
    hits = F.filter(rows, lambda r: low.contains(r["word"]))
    made = F.flatten(F.transform(hits, lambda r: F.transform(r["by"], lambda s: F.replace(low, r["word"], s))))
    others = F.array_sort(F.array_except(F.array_distinct(made), F.array(low)))
    return queries.select("query_id", F.posexplode(F.slice(F.concat(F.array("query"), others), 1, most)).alias("n", "query"))


def query_profile(query: Column) -> Column:
    """Length class, capitalised words, temporal and factual marks."""
    n = F.size(F.regexp_extract_all(query, F.lit(r"\b([A-Z][a-zA-Z]+)\b"), F.lit(1)))
    return F.struct(
        F.when(F.length(query) < 50, "short").when(F.length(query) <= 200, "medium").otherwise("long").alias("size"),
        n.alias("n_entities"),
        F.lower(query).rlike(r"\b(when|yesterday|today|last|recent|before|after|ago)\b").alias("temporal"),
        F.lower(query).rlike(r"\b(what|who|where|which|how many|define)\b").alias("factual"),
    )


def strategy_weights(queries: DataFrame) -> DataFrame:
    """(query_id, method, weight) by the first rule that fits the query's profile."""
    p = query_profile(F.col("query"))
    q = queries.select("query_id", p.alias("p"))
    w = lambda **k: F.map_from_arrays(F.array(*map(F.lit, k)), F.array(*(F.lit(float(v)) for v in k.values())))
    chosen = (
        F.when((F.col("p.size") == "short") & F.col("p.factual"), w(semantic=0.6, keyword=0.4, temporal=0, graph=0))
        .when(F.col("p.size") == "long", w(semantic=0.4, keyword=0, temporal=0.3, graph=0.3))
        .when(F.col("p.n_entities") >= 2, w(semantic=0.3, keyword=0.2, temporal=0, graph=0.5))
        .when(F.col("p.temporal"), w(semantic=0.4, keyword=0.1, temporal=0.5, graph=0))
        .when(F.col("p.factual"), w(semantic=0.5, keyword=0.3, temporal=0, graph=0.2))
        .otherwise(w(semantic=0.4, keyword=0.3, temporal=0.1, graph=0.2))
    )
    return q.select("query_id", F.explode(chosen).alias("method", "weight"))


def reason(queries: DataFrame, memories: DataFrame, now: Column, edges: DataFrame, seeds: DataFrame, names: DataFrame, links: DataFrame, limit: int = 10, least: float = 0.2) -> DataFrame:
    """Recall, recall of the query with the names of near entities added, best score of each id, times confidence."""
    first = recall(queries, memories, now, limit, edges=edges, seeds=seeds, links=links)
    near = within_hops(edges, seeds, 2).where("hops > 0").join(names, "id")
    near = first_n(near, 10, ["query_id"], F.col("hops"), F.col("name")).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("more"))
    wider = queries.join(near, "query_id").withColumn("query", F.concat_ws(" ", "query", "more")).drop("more")
    second = recall(wider, memories, now, limit, edges=edges, seeds=seeds, links=links)
    rows = best_of([first.select("query_id", "id", "score"), second.select("query_id", "id", "score")], limit).drop("rank")
    rows = rows.join(first.select("query_id", "id", F.lit(True).alias("initial")), ["query_id", "id"], "left").join(memories.select("id", "importance", "created_at", "entity_ids"), "id")
    hours = (F.unix_micros(now) - F.unix_micros("created_at")) / F.lit(3600e6)
    sure = result_confidence(F.coalesce("initial", F.lit(False)), F.col("importance"), hours, F.size("entity_ids"))
    rows = rows.withColumn("confidence", sure).withColumn("score", F.col("score") * F.col("confidence"))
    return first_n(rows.where(F.col("score") >= least).select("query_id", "id", "score", "confidence"), limit, ["query_id"], F.desc("score"), F.col("id"))


def report(recalled: DataFrame, memories: DataFrame) -> DataFrame:
    """A Markdown report of each query's first five memories."""
    rows = recalled.where("rank <= 5").join(memories.select("id", "content"), "id")
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.substring("content", 1, 80)).alias("line"))))
    return rows.groupBy("query_id").agg(F.concat(F.lit("## Memories\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("report"))
