"""Search over the trailing window of a stream of texts.

The inverted index is the state of a stream-stream join on the term: texts and queries meet
by term, and the watermark evicts every entry that no query can reach any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import space_tokens
from palimpsest.operators.retrieval import first_n


def indexed(docs: DataFrame, late: str = "60 seconds") -> DataFrame:
    """(term, id, ts): an entry for each distinct lower-case token of docs (id, ts, text, further strings or string arrays).

    All string columns but ``id`` are indexed, arrays by their items.  Of a stream, rows
    later than ``late`` behind the newest one are dropped.  Rows without a time are left out.
    """
    texts = [F.array_join(F.col(c), " ") if kind == "array<string>" else F.col(c) for c, kind in docs.dtypes if kind in ("string", "array<string>") and c != "id"]
    rows = docs.withWatermark("ts", late) if docs.isStreaming else docs
    words = space_tokens(F.concat_ws(" ", *texts))
    return rows.where("ts is not null").select(F.explode(words).alias("term"), "id", "ts")


def window_search(docs: DataFrame, queries: DataFrame, width: str = "60 seconds", late: str = "60 seconds", limit: int | None = None) -> DataFrame:
    """(query_id, id, ts, asked_at): texts with any term of a query that are at most ``width`` older than it.

    docs: see ``indexed``; queries: query_id, ts, query.  Both are tables, or both streams:
    then a row is kept as state until the watermark has passed the last query that could
    reach it, and each pair comes once.  ``limit`` (tables only) keeps the first ids of each
    query; ids, not an arbitrary order, decide (of equal ones the earlier text), and pairs
    beyond it are not made, see ``_first_in_windows``.
    """
    entries = indexed(docs, late)
    asked = queries.withWatermark("ts", late) if queries.isStreaming else queries
    terms = asked.where("ts is not null").select("query_id", F.col("ts").alias("asked_at"), F.explode(space_tokens(F.col("query"))).alias("asked"))
    span = F.expr(f"interval {width}")
    if limit is not None and not docs.isStreaming and (cell := _cell(docs, span)):
        return _first_in_windows(entries, terms, span, cell, limit)
    near = (F.col("term") == F.col("asked")) & (F.col("ts") <= F.col("asked_at")) & (F.col("ts") >= F.col("asked_at") - span)
    found = entries.join(terms, near).select("query_id", "id", "ts", "asked_at")
    if docs.isStreaming:
        # one event time is left: that of the query
        found = found.select("query_id", "id", F.timestamp_micros(F.unix_micros("ts")).alias("ts"), "asked_at")
        return found.dropDuplicatesWithinWatermark(["query_id", "id"])
    found = found.distinct()
    return found if limit is None else first_n(found, limit, ["query_id"], F.col("id")).drop("rank")


def _cell(docs: DataFrame, span: Column) -> int:
    """Microseconds that no window is shorter than: its width, or half of it where days and months vary; 0 if there are none."""
    at = F.lit("2024-01-31 12:00:00").cast("timestamp")
    width = docs.sparkSession.range(1).select(F.unix_micros(at) - F.unix_micros(at - span)).head()[0]
    return max(0, width if width < 86_400_000_000 else width // 2)


def _running_least(k: int):
    """Rows sorted by (term, cell, back, pos, asks) -> for each asking row the k least (id, ts) of the rows before it in its cell.

    A cell is streamed: what passes from batch to batch is its k least rows so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("term", "cell", "back")]
            marks = [c.dictionary_encode().indices.to_numpy() for c in keys]
            first, last = (tuple(c[i].as_py() for c in keys) for i in (0, batch.num_rows - 1))
            rows = pa.table({"id": batch.column("id"), "ts": batch.column("ts")})
            held = rows.slice(0, 0) if first != now else held
            both, old = pa.concat_tables([held, rows]).combine_chunks(), held.num_rows
            n = both.num_rows
            segment = np.append(np.zeros(old + 1, np.int64), np.cumsum(np.any([m[1:] != m[:-1] for m in marks], axis=0)))
            asking = np.append(np.zeros(old, bool), batch.column("asks").to_numpy(zero_copy_only=False))
            # places in the order of (id, ts); equal rows of a cell count once
            order = pc.sort_indices(both, [("id", "ascending"), ("ts", "ascending")], null_placement="at_start").to_numpy()
            ordered = both.take(pa.array(order))
            codes = [ordered[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ("id", "ts")]
            value, place = np.empty(n, np.int64), np.empty(n, np.int64)
            value[order] = np.append(0, np.cumsum((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])))
            place[order] = np.arange(n)
            texts = np.flatnonzero(~asking)
            once = texts[np.unique(segment[texts] * n + value[texts], return_index=True)[1]]
            # later cells have smaller numbers throughout, so a running least begins anew with each cell; the largest of a cell's numbers is none
            floor = (segment[-1] - segment) * (n + 1)
            none, carried = floor + n, floor + n
            carried[once] = floor[once] + place[once]
            begins = np.append(True, segment[1:] != segment[:-1])
            asked, least, table = np.flatnonzero(asking), [], np.empty((k, int(asking.sum())), np.int64)
            for j in range(k):
                # the j-th least so far; what it displaces goes on to the next place
                best = np.minimum.accumulate(carried)
                carried = np.maximum(carried, np.where(begins, none, np.append(none[0], best[:-1])))
                table[j] = (best - floor)[asked]
                least.append(best[-1] - floor[-1])
            if len(asked):
                flat = table.T
                full = flat < n
                taken = ordered.take(pa.array(flat[full]))
                ends = pa.array(np.append(0, full.sum(axis=1).cumsum()).astype(np.int32))
                found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([taken[c].combine_chunks() for c in ("id", "ts")], ["id", "ts"]))
                at = pa.array(asked - old)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("asked_at").take(at), found], names=["query_id", "asked_at", "found"])
            now, held = last, ordered.take(pa.array([x for x in least if x < n], pa.int64()))

    return run


def _first_in_windows(entries: DataFrame, terms: DataFrame, span: Column, cell: int, limit: int) -> DataFrame:
    """window_search with a limit over tables, without a join of texts and queries.

    Time is cut into cells that are no longer than a window, so a window is the end of one
    cell, the begin of a later one and the whole cells between.  Each cell of a term is
    sorted once forwards and once backwards; a query standing among its texts takes the
    first ids so far.  Work and memory grow with rows and results, not with pairs.
    """
    at, cell_of = F.unix_micros("ts"), lambda c: ((c - F.pmod(c, F.lit(cell))) / F.lit(cell)).cast("long")
    id_, query = entries.schema["id"].dataType, terms.schema["query_id"].dataType
    none = [F.lit(None).cast(query).alias("query_id"), F.lit(None).cast("timestamp").alias("asked_at")]
    texts = entries.select("term", cell_of(at).alias("cell"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), at.alias("pos"), F.lit(False).alias("asks"), "id", "ts", *none)
    texts = texts.withColumn("pos", F.when(F.col("back"), -F.col("pos")).otherwise(F.col("pos")))
    end, begin = F.unix_micros("asked_at"), F.unix_micros(F.col("asked_at") - span)
    parts = F.concat(
        F.array(F.struct(cell_of(end).alias("cell"), F.lit(False).alias("back"), end.alias("pos")), F.struct(cell_of(begin).alias("cell"), F.lit(True).alias("back"), (-begin).alias("pos"))),
        F.transform(F.filter(F.sequence(cell_of(begin), cell_of(end)), lambda c: (c > cell_of(begin)) & (c < cell_of(end))), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("back"), F.lit(2**63 - 1).alias("pos"))),
    )
    asked = terms.distinct().select(F.col("asked").alias("term"), F.inline(parts), F.lit(True).alias("asks"), F.lit(None).cast(id_).alias("id"), F.lit(None).cast("timestamp").alias("ts"), "query_id", "asked_at")
    columns = ["term", "cell", "back", "pos", "asks", "id", "ts", "query_id", "asked_at"]
    cells = texts.select(columns).unionByName(asked.select(columns)).repartition("term", "cell", "back").sortWithinPartitions("term", "cell", "back", "pos", "asks")
    shape = f"query_id {query.simpleString()}, asked_at timestamp, found array<struct<id:{id_.simpleString()},ts:timestamp>>"
    found = cells.mapInArrow(_running_least(limit), shape).where(F.size("found") > 0).repartition("query_id")
    rows = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, limit)
    found = found.groupBy("query_id", "asked_at").agg(rows.alias("found")).select("query_id", "asked_at", F.inline("found"))
    return first_n(found, limit, ["query_id"], F.col("id"), F.col("ts")).select("query_id", "id", "ts", "asked_at")
