"""Graph operators over edge tables (G01-G16, J05).  edges: source_id, target_id, relation_type, weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import space_tokens
from palimpsest.functions.vector import cosine
from palimpsest.operators.cells import Cells, cells_a_block
from palimpsest.operators.folds import fold_sorted
from palimpsest.operators.retrieval import first_n


def symmetric(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), *(c for c in edges.columns if c not in ("source_id", "target_id")))
    return edges.unionByName(back)


def within_hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, hops) of all nodes up to ``depth`` hops from seeds (query_id, id), seeds at 0.

    One join a hop, on the frontier only; a node keeps its smallest distance.  Unknown seeds
    have no neighbours.
    """
    links = edges.select("source_id", "target_id").distinct()
    seen = seeds.select("query_id", "id").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier["id"] == links["source_id"]).select("query_id", F.col("target_id").alias("id")).distinct()
        frontier = step.join(seen, ["query_id", "id"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def linked_memories(edges: DataFrame, seeds: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """Memories of near entities (links: entity_id, memory_id), scored 1, .9, .6, then .3 by hops."""
    near = within_hops(edges, seeds, depth).join(links, F.col("id") == F.col("entity_id"))
    score = F.when(F.col("hops") == 0, 1.0).when(F.col("hops") == 1, 0.9).when(F.col("hops") == 2, 0.6).otherwise(0.3)
    return near.groupBy("query_id", F.col("memory_id").alias("id")).agg(F.max(score).alias("score"))


def merged_entities(events: DataFrame) -> DataFrame:
    """One row for each entity: first and last time seen, the latest name and type, all memories."""
    return events.groupBy("id").agg(
        F.max_by("name", "seen").alias("name"), F.max_by("entity_type", "seen").alias("entity_type"),
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.array_sort(F.collect_set("memory_id")).alias("memory_ids"),
    )


def running_weights(events: DataFrame) -> DataFrame:
    """Edges from weight events (source_id, target_id, relation_type, weight, seq).

    The first event sets the weight, each later one averages it with its own, in order; null weights change nothing.
    """

    def step(weight: float | None, v: tuple) -> tuple:
        return (weight if v[1] is None else v[1] if weight is None else (weight + v[1]) / 2), None

    return fold_sorted(events, ["source_id", "target_id", "relation_type"], {"seq": F.col("seq"), "weight": F.col("weight").cast("double")}, None, step, {"weight": "double"}, each=False)


def boosted_search(vectors: DataFrame, edges: DataFrame, seeds: DataFrame, query: Column, depth: int = 2, boost: float = 0.15) -> DataFrame:
    """Cosine clipped to [0, 1] plus boost / (hops + 1) of nodes with a vector near the seeds."""
    near = within_hops(symmetric(edges), seeds, depth)
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(F.col("vector"), query)))
    return near.join(vectors, "id").select("query_id", "id", "hops", (base + boost / (F.col("hops") + 1)).alias("score"))


def mixed_search(vectors: DataFrame, edges: DataFrame, seeds: DataFrame, query: Column, depth: int = 2) -> DataFrame:
    """.6 * cosine + .4 / (hops + 1); a node without a vector has cosine 0."""
    near = within_hops(symmetric(edges), seeds, depth).join(vectors, "id", "left")
    return near.select("query_id", "id", (0.6 * F.coalesce(cosine(F.col("vector"), query), F.lit(0.0)) + 0.4 / (F.col("hops") + 1)).alias("score"))


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "both", relation_type: str | None = None) -> DataFrame:
    """(id, neighbour, relation_type) by direction out, in or both."""
    if relation_type is not None:
        edges = edges.where(F.col("relation_type") == relation_type)
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour"), "relation_type")
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour"), "relation_type")
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return rows.join(ids.select("id").distinct(), "id", "left_semi").distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id").distinct()
    inner = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return inner.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def allowed_edges(edges: DataFrame, types: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges with ``valid``: their (source type, relation, target type) is a rule; no rules allow all."""
    a = types.select(F.col("id").alias("source_id"), F.col("entity_type").alias("source_type"))
    b = types.select(F.col("id").alias("target_id"), F.col("entity_type").alias("target_type"))
    rules = rules.select("source_type", "relation_type", "target_type").distinct().withColumn("_rule", F.lit(True))
    open_ = rules.agg((F.count("*") == 0).alias("_open"))
    typed = edges.join(a, "source_id", "left").join(b, "target_id", "left").join(rules, ["source_type", "relation_type", "target_type"], "left").crossJoin(F.broadcast(open_))  # one row
    return typed.select(*edges.columns, (F.col("_open") | F.col("_rule").isNotNull()).alias("valid"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges left after their nodes (id) are deleted."""
    ids = gone.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*edges.columns)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes and n_edges."""
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each


def co_occurrence(lists: DataFrame, entities: str = "entity_ids") -> DataFrame:
    """Edges of weight .5 between consecutive entities of each list."""
    shifted = F.slice(entities, 2, F.greatest(F.size(entities) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(F.col(entities), F.lit(1), F.size(shifted)).alias("a"), shifted.alias("b"))
    rows = lists.select(F.explode(pairs).alias("p"))
    return rows.select(F.col("p.a").alias("source_id"), F.col("p.b").alias("target_id"), F.lit("co_occurs").alias("relation_type"), F.lit(0.5).alias("weight"))


def candidate_pairs(memories: DataFrame, least: float = 0.7, most: int = 50) -> DataFrame:
    """The ``most`` best pairs (a, b, score) of memories (id, vector, tags, memory_type) with cosine >= least.

    score: cosine, and .05 more each for other tags (as sets) and another type.  Pairs are
    compared cell by cell (see ``Cells``), and each task sends only its best ``most``.
    """
    rows = memories.select("id", "vector", F.array_sort(F.array_distinct("tags")).alias("tags"), "memory_type")
    pairs = Cells(rows, more=("tags", "memory_type"), per_block=cells_a_block(least)).pairs(least, most, 0.05)
    return pairs.orderBy(F.desc(F.round("score", 9)), "a", "b").limit(most)


# Words that make no theme.
STOP_WORDS = "the a an is are was were be been being to of and in on at for with as by it this that".split()


def connections(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, connection_type, n_shared, strength) of the candidate pairs (a, b) that are connected.

    A common entity makes a compositional link of .6; else three or more common words
    (lower case, between white space, no stop words) a thematic one of min(.9, .5 + .05 n).
    memories: id, content, entity_ids.  Words are compared for the candidates alone.
    """
    m = memories.select("id", space_tokens(F.coalesce("content", F.lit(""))).alias("w"), F.coalesce("entity_ids", F.array().cast("array<string>")).alias("e"))
    both = pairs.select("a", "b").distinct().join(m.toDF("a", "wa", "ea"), "a").join(m.toDF("b", "wb", "eb"), "b")
    words = F.size(F.array_except(F.array_intersect("wa", "wb"), F.array(*map(F.lit, STOP_WORDS))))
    common = F.size(F.array_intersect("ea", "eb"))
    kind = F.when(common > 0, "compositional").when(words >= 3, "thematic")
    shared = F.when(common > 0, common).otherwise(words)
    strength = F.when(common > 0, 0.6).otherwise(F.least(F.lit(0.9), 0.5 + 0.05 * words))
    return both.select("a", "b", kind.alias("connection_type"), shared.cast("long").alias("n_shared"), strength.alias("strength")).where("connection_type is not null")


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each source."""
    return first_n(edges, k, ["source_id"], F.desc("weight"), F.col("target_id"))
