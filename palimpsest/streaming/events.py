"""Streams of events (R01-R13): windows with watermarks, search over recent text, rate limits, micro-batch state.

Every transformation takes a batch or a streaming DataFrame with an event-time column ``ts``.
Late rows beyond the watermark are dropped, which a processing-time design has no word for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.folds import fold_sorted


def window_counts(events: DataFrame, width: str = "60 seconds", slide: str | None = None, late: str = "60 seconds", by: list[str] = ()) -> DataFrame:
    """window_start, window_end, n and total of ``value`` for each window and key."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of each user: session_start, session_end, user_id, n."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once; a stream keeps ids for the watermark's span only."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def recent_matches(docs: DataFrame, terms: list[str], now: Column, width: str = "60 seconds") -> DataFrame:
    """Rows (id, ts, text) of the trailing window with any term as a word, by id."""
    words = F.split(F.lower("text"), r"\s+")
    rows = docs.where((F.col("ts") <= now) & (F.col("ts") >= now - F.expr(f"interval {width}")))
    return rows.where(F.arrays_overlap(words, F.array(*(F.lit(t.lower()) for t in terms))))


def survivors(events: DataFrame, capacity: int, policy: str = "drop_oldest") -> DataFrame:
    """What a bounded buffer of a batch keeps: the last or the first ``capacity`` rows by (ts, event_id)."""
    order = [F.desc("ts"), F.desc("event_id")] if policy == "drop_oldest" else [F.asc("ts"), F.asc("event_id")]
    return events.orderBy(*order).limit(capacity)


def batches(events: DataFrame, size: int = 100, by: str = "user_id") -> DataFrame:
    """Batch number and first and last sequence number of runs of ``size`` events of each key."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    rows = events.withColumn("seq", F.row_number().over(w))
    return rows.groupBy(by, F.floor((F.col("seq") - 1) / size).alias("batch")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def token_bucket(events: DataFrame, rate: float, capacity: float, by: str = "user_id") -> DataFrame:
    """R13 over a batch: events with ``allowed``: a bucket of ``capacity`` refilled by ``rate`` a second for each key; a null ts refills nothing."""

    def step(state: tuple | None, v: tuple) -> tuple:
        level, at = state or (float(capacity), None)
        if v[0] is not None and at is not None:
            level = min(float(capacity), level + (v[0] - at) / 1e6 * rate)
        ok = level >= 1.0
        return (level - float(ok), at if v[0] is None else v[0]), (v[1], ok)

    values = {"ts": F.unix_micros("ts"), "event_id": F.col("event_id").cast("long")}
    return fold_sorted(events, [by], values, None, step, {"event_id": "long", "allowed": "boolean"})


def token_bucket_stream(events: DataFrame, rate: float, capacity: float) -> DataFrame:
    """R13 as a stream: (user_id, event_id, allowed) with the bucket of each user kept as state."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, at = state.get if state.exists else (float(capacity), None)
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "event_id"])
            allowed = []
            for t in pdf["ts"]:
                now = t.timestamp()
                level = min(capacity, level + max(0.0, now - (at if at is not None else now)) * rate)
                at = now
                allowed.append(level >= 1.0)
                level -= float(level >= 1.0)
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "allowed": allowed})
        state.update((level, at))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "level double, at double", "append", "NoTimeout")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there, in micro-batches handed to ``sink``; a restart goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows and rates of the last micro-batch."""
    last = query.lastProgress or {}
    return {k: last.get(k, 0) or 0 for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")}


def upsert_sink(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each micro-batch once as ``batch=<id>``; a replayed batch overwrites itself."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sink
