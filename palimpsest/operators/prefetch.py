"""Prediction of the next query from contexts of several lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Between the queries of a context.
GAP = "\x1f"


def _normal(c):
    return F.lower(F.trim(c))


def context_table(log: DataFrame, shortest: int = 2, longest: int = 4, by: str = "user_id") -> DataFrame:
    """(context, length, next_query, n, first): what followed each run of ``shortest`` to ``longest`` queries of one user.

    log: user_id, ts, query.  Queries are compared in lower case without outer blanks; n
    counts, ``first`` is the time and user of the first occurrence.  A window slides over
    each user's queries, so a user's rows are sorted but never held.
    """
    w = Window.partitionBy(by).orderBy("ts", "query")
    rows = log.select(by, "ts", _normal(F.col("query")).alias("query"))
    before = [F.lag("query", k).over(w) for k in range(longest - 1, -1, -1)]
    rows = rows.select(by, "ts", *(c.alias(f"q{k}") for k, c in enumerate(before)), F.lead("query").over(w).alias("next_query")).where("next_query is not null")
    contexts = F.array(*(F.struct(F.lit(n).alias("length"), F.array(*(f"q{k}" for k in range(longest - n, longest))).alias("queries")) for n in range(shortest, longest + 1)))
    each = rows.select(by, "ts", "next_query", F.explode(contexts).alias("c")).where(~F.exists("c.queries", lambda q: q.isNull()))
    key = F.array_join("c.queries", GAP)
    return each.groupBy(key.alias("context"), F.col("c.length").alias("length"), "next_query").agg(F.count("*").alias("n"), F.min(F.struct("ts", by)).alias("first"))


def predict_next(table: DataFrame, recent: DataFrame, shortest: int = 2, longest: int = 4, k: int = 3) -> DataFrame:
    """(query_id, next_query, length, rank): of the longest known run that ends ``queries``, the k first seen successors.

    recent: query_id, queries (an array, oldest first).  Shorter runs are used only where no
    longer one is known.  Ties of the first occurrence go by the query.
    """
    size = F.size("queries")
    runs = F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), size)), lambda n: F.struct(n.alias("length"), F.array_join(F.slice(F.transform("queries", _normal), size - n + 1, n), GAP).alias("context")))
    asked = recent.where(size >= shortest).select("query_id", F.explode(runs).alias("r")).select("query_id", "r.length", "r.context")
    hits = asked.join(table, ["context", "length"])
    best = hits.withColumn("_most", F.max("length").over(Window.partitionBy("query_id"))).where("length = _most")
    order = Window.partitionBy("query_id").orderBy("first", "next_query")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "next_query", "length", "rank")
