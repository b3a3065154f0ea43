"""Queries made from queries and profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A query is split at the first of these that it contains.
SPLITS = [" and ", " vs ", " versus ", " compared to ", " difference between ", " pros and cons of ", " how to ", " what is ", " explain "]


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _distinct(texts: Column, most: int) -> Column:
    """The first of texts that are equal but for case and outer space, at most ``most``."""
    norms = F.transform(texts, lambda t: F.lower(_stripped(t)))
    firsts = F.filter(F.arrays_zip(texts.alias("t"), norms.alias("n"), F.sequence(F.lit(1), F.size(texts)).alias("i")), lambda r: F.array_position(norms, r["n"]) == r["i"])
    return F.slice(F.transform(firsts, lambda r: r["t"]), 1, most)


def enriched_queries(queries: DataFrame, context: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, n, query): the query, with each of its user's topics, and with the last query as context.

    queries: query_id, query, user_id; context: user_id, topics, recent_queries (arrays in order,
    one row a user).  Up to most - 1 topics; a last query equal but for case adds nothing;
    a user without context keeps the query alone.
    """
    rows = queries.join(context.select("user_id", "topics", "recent_queries"), "user_id", "left")
    none = F.array().cast("array<string>")
    topics = F.transform(F.slice(F.filter(F.coalesce("topics", none), lambda t: t.isNotNull()), 1, most - 1), lambda t: F.concat_ws(" ", "query", t))
    recent = F.try_element_at(F.col("recent_queries"), F.lit(-1))
    seen = F.when(F.lower(recent) != F.lower("query"), F.array(F.concat(F.col("query"), F.lit(" (context: "), recent, F.lit(")")))).otherwise(none)
    return rows.select("query_id", F.posexplode(F.slice(F.array_distinct(F.concat(F.array("query"), topics, seen)), 1, most)).alias("n", "query"))


def decomposed_queries(queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, n, query): the query, its lower-cased parts, and what its form asks for.

    "what is the difference between a and b" adds "what is a" and "what is b"; "pros and cons
    of x" its advantages and disadvantages; "how to a and b" a "how to" for each.  Equal ones
    but for case and outer space count once; a null query gives no row.
    """
    q = F.col("query")
    low = F.lower(q)
    none = F.array().cast("array<string>")
    parts = none
    for token in reversed(SPLITS):
        parts = F.when(F.contains(low, F.lit(token)), F.split(low, re.escape(token))).otherwise(parts)
    parts = F.filter(F.transform(parts, _stripped), lambda p: (p != "") & (p != q))
    after = lambda start: F.substr(q, F.lit(len(start) + 1))
    items = lambda start: F.transform(F.split(after(start), " and "), _stripped)
    between, sides, steps = "what is the difference between ", "pros and cons of ", "how to "
    topic = _stripped(after(sides))
    form = (
        F.when(low.startswith(between), F.transform(F.filter(items(between), lambda i: i != ""), lambda i: F.concat(F.lit("what is "), i)))
        .when(low.startswith(sides), F.array(F.concat(F.lit("advantages of "), topic), F.concat(F.lit("disadvantages of "), topic)))
        .when(low.startswith(steps) & F.contains(low, F.lit(" and ")), F.transform(F.slice(items(steps), 1, most), lambda i: F.concat(F.lit("how to "), i)))
        .otherwise(none)
    )
    rows = queries.where(q.isNotNull()).select("query_id", F.concat(F.array(q), F.array_distinct(parts), form).alias("all"))
    return rows.select("query_id", F.posexplode(_distinct(F.col("all"), most)).alias("n", "query"))


def predicted_queries(intents: DataFrame, preferences: DataFrame, knowledge: DataFrame, least: float = 0.5, types: tuple[str, ...] = ("technology", "format", "tone", "depth", "language")) -> DataFrame:
    """(user_id, n, query) that a user's attributes of confidence ``least`` or more suggest.

    The intent's topics come first, then a tutorial and a guide for each preference in the order of
    ``types``, then best practices of each field by rank; equal queries but for case once.
    """
    kind = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
    row = lambda a, b, c, text: F.struct(F.lit(a).alias("a"), b.cast("int").alias("b"), F.lit(c).alias("c"), text.alias("query"))
    guide = F.concat_ws(" ", "value", "type", F.lit("guide"))
    parts = [
        intents.where(F.col("confidence") >= least).select("user_id", row(0, F.lit(0), 0, F.concat("category", F.lit(" related topics"))).alias("r")),
        preferences.where(F.col("confidence") >= least).select("user_id", F.explode(F.array(row(1, kind, 0, F.concat("value", F.lit(" tutorial"))), row(1, kind, 1, guide))).alias("r")),
        knowledge.where(F.col("confidence") >= least).select("user_id", row(2, F.col("rank"), 0, F.concat("domain", F.lit(" best practices"))).alias("r")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = rows.groupBy("user_id", F.lower(F.trim("r.query"))).agg(F.min("r").alias("r"))
    return once.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("r")) - 1).alias("n"), "r.query")  # a dozen rows a user
