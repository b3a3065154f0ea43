"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges: (u, v) with v < u.  Each node's neighbours move to its smallest one.

    The minimum is a partial aggregate and joined back, so a node with very many neighbours
    is neither collected nor held in one task (AQE splits the join's skewed side).
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every id in an edge: component is the smallest id reachable.

    edges: columns (a, b), any order and repeats.  Each round is written to the shared
    folder, so lineage stays short and lost executors cost one round at most.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    last = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        last = mark
        if not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        now = written(_star(_star(now, large=True), large=False), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
