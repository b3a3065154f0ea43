"""User profiles and drift (A24, F02-F09, J11, J12, W13); inference from texts is in ``inference``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actions(log: DataFrame) -> DataFrame:
    """Each user's actions as shares, and the most frequent one."""
    n = log.groupBy("user_id", "action").agg(F.count("*").alias("n"))
    total = n.groupBy("user_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", "action"))["action"].alias("most"))
    return n.join(total, "user_id").select("user_id", "action", (F.col("n") / F.col("total")).alias("share"), "most")


def merge(old: DataFrame, new: DataFrame, boost: float = 0.05) -> DataFrame:
    """Attributes (user_id, name, value, confidence): the same value is confirmed, another one wins if surer."""
    o = old.select("user_id", "name", F.col("value").alias("ov"), F.col("confidence").alias("oc"))
    n = new.select("user_id", "name", F.col("value").alias("nv"), F.col("confidence").alias("nc"))
    j = o.join(n, ["user_id", "name"], "full_outer")
    same = F.col("ov") == F.col("nv")
    newer = F.col("oc").isNull() | (F.coalesce("nc", F.lit(-1.0)) > F.col("oc"))
    return j.select("user_id", "name", F.when(same | ~newer, F.col("ov")).otherwise(F.col("nv")).alias("value"), F.when(same, F.least(F.lit(0.95), F.greatest("oc", "nc") + boost)).when(newer, F.col("nc")).otherwise(F.col("oc")).alias("confidence"))


def drift(recent: DataFrame, past: DataFrame, least: float = 0.2) -> DataFrame:
    """Attributes that emerged, faded, changed value, or changed confidence by more than ``least``."""
    r = recent.select("user_id", "name", F.col("value").alias("rv"), F.col("confidence").alias("rc"))
    p = past.select("user_id", "name", F.col("value").alias("pv"), F.col("confidence").alias("pc"))
    j = r.join(p, ["user_id", "name"], "full_outer")
    kind = (
        F.when(F.col("pv").isNull(), "emerged").when(F.col("rv").isNull(), "faded").when(F.col("rv") != F.col("pv"), "value_shift")
        .when(F.abs(F.col("rc") - F.col("pc")) > least, "confidence_shift")
    )
    return j.withColumn("kind", kind).where("kind is not null").select("user_id", "name", "kind")


def feedback(attributes: DataFrame, signals: DataFrame, rate: float = 0.1) -> DataFrame:
    """confidence moved by rate * the sum of a user's signals, within [0, 1]."""
    s = signals.groupBy("user_id", "name").agg(F.sum("signal").alias("s"))
    return attributes.join(s, ["user_id", "name"], "left").withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + rate * F.coalesce("s", F.lit(0.0))))).drop("s")


def shares(parts: DataFrame, by: list[str], value: str) -> DataFrame:
    """each row's share of its group's total, rounded to two places."""
    from pyspark.sql import Window

    return parts.withColumn("share", F.round(F.col(value) / F.sum(value).over(Window.partitionBy(*by)), 2))
