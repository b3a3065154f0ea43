"""Profiles that are updated as attributes arrive (F02, F03): decay, merge and history of each user, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000
OUT = "user_id string, at timestamp, n_new int, name string, value string, confidence double, changed_at timestamp"
Profile = dict[str, tuple[str, float, int]]


def decayed(profile: Profile, now: int, half_life: float, least: float) -> Profile:
    """Confidence halves every ``half_life`` days (four places); what falls below ``least`` goes.  Times are microseconds."""
    out = {}
    for name, (value, confidence, at) in profile.items():
        if now > at:
            faded = confidence * 0.5 ** ((now - at) / DAY / half_life)
            if faded >= least:
                out[name] = (value, round(faded, 4), at)
        else:
            out[name] = (value, confidence, at)
    return out


def merged(profile: Profile, new: dict[str, tuple[str, float]], now: int) -> Profile:
    """A new attribute wins if it is surer by more than .2 (then .05 surer still), else the surer value stays (.02 surer), up to .95."""
    out = dict(profile)
    for name, (value, confidence) in sorted(new.items()):
        if name not in out:
            out[name] = (value, confidence, now)
            continue
        old, before, _ = out[name]
        if confidence > before + 0.2:
            out[name] = (value, round(min(0.95, confidence + 0.05), 4), now)
        else:
            out[name] = (value if confidence > before else old, round(min(0.95, max(before, confidence) + 0.02), 4), now)
    return out


def _surest(rows: list[tuple]) -> dict[str, tuple[str, float]]:
    """Of one update: each name's surest value (ties: the smaller one)."""
    best: dict[str, tuple[str, float]] = {}
    for name, value, confidence in rows:
        if name not in best or (-confidence, value) < (-best[name][1], best[name][0]):
            best[name] = (value, confidence)
    return best


def _thin(attributes: DataFrame) -> DataFrame:
    return attributes.where("user_id is not null and at is not null and name is not null and confidence is not null").select(F.col("user_id").cast("string").alias("user_id"), "at", "name", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), F.col("confidence").cast("double").alias("confidence"))


def profile_updates(attributes: DataFrame, half_life: float = 30.0, least: float = 0.15) -> DataFrame:
    """F02, F03 over a table: the whole profile after each update: user_id, at, n_new, name, value, confidence, changed_at.

    attributes: user_id, at, name, value, confidence; all of one user and time are one
    update.  Rows with a null user, time, name or confidence are left out.  A user's rows
    are sorted by Spark and streamed; only the profile is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, at, profile, rows, out = None, None, {}, [], []

        def close() -> None:
            nonlocal profile
            new = _surest(rows)
            profile = merged(decayed(profile, at, half_life, least), new, at)
            out.extend((user, at, len(new), n, v, c, t) for n, (v, c, t) in sorted(profile.items()))

        def made() -> pa.RecordBatch:
            kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.timestamp("us", "UTC")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in OUT.split(", ")])

        for batch in batches:
            for u, t, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (u, t) != (user, at):
                    if user is not None:
                        close()
                    if u != user:
                        profile = {}
                    user, at, rows = u, t, []
                rows.append(tuple(rest))
            if out:
                yield made()
                out = []
        if user is not None:
            close()
            yield made()

    rows = _thin(attributes).repartition("user_id").sortWithinPartitions("user_id", "at", "name", "value").withColumn("at", F.unix_micros("at"))
    return rows.mapInArrow(run, OUT)


class _Updates(StatefulProcessor):
    def __init__(self, half_life: float, least: float):
        self.half_life, self.least = half_life, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attributes = handle.getMapState("attributes", "name string", "value string, confidence double, at long")

    def _profile(self) -> Profile:
        return {k[0]: tuple(v) for k, v in self.attributes.iterator()} if self.attributes.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        profile, out = self._profile(), []
        frame["micros"] = frame["at"].astype("datetime64[us]").astype("int64")
        for at, part in frame.groupby("micros", sort=True):
            new = _surest(list(part[["name", "value", "confidence"]].itertuples(index=False, name=None)))
            profile = merged(decayed(profile, int(at), self.half_life, self.least), new, int(at))
            out += [(key[0], pd.Timestamp(int(at), unit="us"), len(new), n, v, c, pd.Timestamp(t, unit="us")) for n, (v, c, t) in sorted(profile.items())]
        self.attributes.clear()
        for n, v in profile.items():
            self.attributes.updateValue((n,), v)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # by then the surest attribute has faded, whatever its age was
        last = max(t for _, _, t in profile.values()) / 1000 + 86_400_000 * self.half_life * 8
        self.handle.registerTimer(int(last))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")]).astype({"n_new": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.attributes.clear()
        return iter([])

    def close(self) -> None: ...


def profile_stream(attributes: DataFrame, half_life: float = 30.0, least: float = 0.15, late: str = "1 day") -> DataFrame:
    """F02, F03 as a stream: the rows of ``profile_updates`` as they come to be, with each user's profile as state.

    A user's updates must come in order, an update within one micro-batch.  A timer drops
    the profile of a user who was silent for eight half-lives (no confidence lasts so long).
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = _thin(attributes).withWatermark("at", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_Updates(half_life, least), OUT, "append", "EventTime")
